"""Queries over text, vectors, fusion and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutlight.functions import text as tx
from cutlight.functions import vectors as vx
from cutlight.operators import evaluation as ev
from cutlight.operators import fusion as fu
from cutlight.operators import text_search as ts
from cutlight.operators import vector_search as vs
from cutlight.sources import load

TERMS = ["camera", "river", "guitarra", "noche"]


def _rows(spark, d):
    return ts.text_rows(load(spark, d, "documents"), "doc_id", "text")


_INDEXES: dict[tuple, ts.TextIndex] = {}


def _index(spark, d) -> ts.TextIndex:
    """The stored index of a folder's documents, built when it is first asked for in a session."""
    key = (spark.sparkContext.applicationId, tuple(sorted(load(spark, d, "documents").inputFiles())))
    if key not in _INDEXES:
        _INDEXES[key] = ts.build_index(_rows(spark, d))
    return _INDEXES[key]


def _scored(spark, d, patterns):
    return ts.search_index(_index(spark, d), patterns)


def _round(c, n=6):
    return F.round(c, n)


# SQL pieces. The words of a text: marks off, lower case, runs of a-z and 0-9.
_FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
_W = f"w as (select doc_id, text, source, kind, list_filter(string_split({_FOLD.format('text')}, ' '), lambda x: x <> '') ws from documents where text is not null and trim(text, ' ') <> '')"
_STATS = "st as (select count(*) n, avg(len(ws)) a from w)"


def _bm25_sql(counts: list[str]) -> str:
    tf = ", ".join(f"({c}) t{k}" for k, c in enumerate(counts))
    n = ", ".join(f"count_if(t{k} > 0) n{k}" for k in range(len(counts)))
    part = " + ".join(
        f"case when t{k} > 0 then (case when ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 then 1e-6 else ln((n - n{k} + 0.5) / (n{k} + 0.5)) end)"
        f" * (t{k} * 10.0) * 2.2 / (t{k} * 10.0 + 1.2 * (0.25 + 0.75 * len(ws) / a)) else 0.0 end"
        for k in range(len(counts))
    )
    some = " or ".join(f"t{k} > 0" for k in range(len(counts)))
    return f"with {_W}, {_STATS}, tf as (select *, {tf} from w), nn as (select {n} from tf), sc as (select doc_id, source, kind, text, {part} score from tf, nn, st where {some})"


def _word(t):
    return f"len(list_filter(ws, lambda x: x = '{t}'))"


def _prefix(t):
    return f"len(list_filter(ws, lambda x: starts_with(x, '{t}')))"


def _phrase(a, b):
    return f"len(list_filter(range(1, len(ws)), lambda i: ws[i] = '{a}' and ws[i + 1] = '{b}'))"


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """R2, K4: the 20 best documents for a query of several words."""
    return ts.top_k(_scored(spark, d, TERMS), 20).select(F.col("row_id").alias("doc_id"), "rank_no", _round("score").alias("score"))


def bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Prefix terms; a document counts once for a prefix."""
    return _scored(spark, d, ["cam*", "fri*"]).select(F.col("row_id").alias("doc_id"), _round("score").alias("score"))


def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """A phrase of consecutive words."""
    return _scored(spark, d, ["red car", "coche rojo"]).select(F.col("row_id").alias("doc_id"), _round("score").alias("score"))


def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    """The index built anew: terms, postings and words."""
    index = ts.build_index(_rows(spark, d))
    sums = index.postings.agg(F.count_distinct("term").alias("n_terms"), F.count("*").alias("n_postings"), F.sum(F.size("positions")).alias("n_words"))
    return sums.join(F.broadcast(index.statistics)).select("n_terms", "n_postings", "n_words", "n_all", _round("avgdl").alias("mean_words"))


def bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """Words, a prefix and a phrase at once, by one scan of the texts without an index."""
    return ts.bm25(_rows(spark, d), ["guitarra", "cam*", "red car"]).select(F.col("row_id").alias("doc_id"), _round("score").alias("score"))


def mixed_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The same from the index."""
    return _scored(spark, d, ["guitarra", "cam*", "red car"]).select(F.col("row_id").alias("doc_id"), _round("score").alias("score"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The words around the first camera of each text."""
    docs = load(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("t"))
    return docs.select("doc_id", ts.snippet(F.col("t"), "Cámara").alias("snippet")).where("snippet is not null")


def postings(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index, summed up by term."""
    return ts.postings(_rows(spark, d)).groupBy("term").agg(F.count("*").alias("n_rows"), F.sum("tf").alias("n"), F.max("dl").alias("longest"))


def grouped_text_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best of each kind, with statistics over all kinds."""
    full = _scored(spark, d, TERMS).join(load(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "kind"), "row_id")
    return ts.grouped_top_k(full, "kind", 5).select("kind", F.col("row_id").alias("doc_id"), "rank_no", _round("score").alias("score"))


def prefix_breadth(spark: SparkSession, d: str) -> DataFrame:
    """A5: how many rows the expansions of prefixes reach."""
    v = _index(spark, d).vocabulary
    parts = [ts.prefix_breadth(v, p).select(F.lit(p).alias("prefix"), "breadth") for p in ("ca", "man", "zzz")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def text_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the terms and confidence by rank of the best 50."""
    best = ts.top_k(_scored(spark, d, TERMS), 50).join(load(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text"), "row_id")
    cover = tx.term_coverage(F.col("text"), TERMS)
    return best.select(F.col("row_id").alias("doc_id"), cover.alias("coverage"), _round(tx.text_confidence(cover, F.col("rank_no") - 1)).alias("confidence"))


def label_rarity(spark: SparkSession, d: str) -> DataFrame:
    """How many sources have documents of a kind, and how rare that is."""
    return ts.label_frequency(load(spark, d, "documents"), "kind", "asset_id").select("identifier", "n_assets", _round("rarity").alias("rarity"))


def fold_names(spark: SparkSession, d: str) -> DataFrame:
    """Folded names of people."""
    return load(spark, d, "people").where("display_name is not null").select("person_id", tx.fold("display_name").alias("folded")).distinct()


def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """People whose name resembles a query."""
    q = F.lit("rosario dolores")
    n = load(spark, d, "people").where("display_name is not null").select("person_id", "display_name").distinct()
    return n.select(
        "person_id", _round(tx.name_overlap(q, F.col("display_name"))).alias("overlap"), _round(tx.word_distance(tx.fold(q), tx.fold("display_name"))).alias("distance")
    )


def trigram_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by the number of trigrams that they share with a query."""
    n = load(spark, d, "people").where("display_name is not null").select("person_id", "display_name").distinct()
    shared = F.size(F.array_intersect(tx.trigrams("display_name"), tx.trigrams(F.lit("montserrat"))))
    return n.select("person_id", shared.alias("shared")).where("shared > 0")


def timecodes(spark: SparkSession, d: str) -> DataFrame:
    """Times as people read them."""
    return load(spark, d, "evaluated_hits").select("hit_id", tx.timecode(F.col("start_seconds")).alias("shown")).distinct()


_TRI = "select distinct person_id, display_name, {0} f from people where display_name is not null".format(_FOLD.format("display_name"))


def _query_vector(spark, d):
    e = load(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return F.array(*(F.lit(float(x)) for x in e[0])) if e else F.array().cast("array<double>")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 25 vectors nearest to the first."""
    best = vs.exact_top_k(load(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 25)
    return best.select(F.col("row_id").alias("vec_id"), "rank_no", _round("similarity").alias("similarity"))


def library_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Hits that are surprising against a sample of the library."""
    e = load(spark, d, "embeddings")
    q = _query_vector(spark, d)
    stats = vs.library_statistics(vs.stride_sample(e, "vec_id", 256), "embedding", q)
    z = vx.z_score(vx.dot(F.col("embedding"), q), F.col("mean"), F.col("deviation"))
    return e.join(F.broadcast(stats)).select("vec_id", _round(z, 4).alias("z"), _round(vx.visual_confidence(z, 1.0, 3.0), 4).alias("confidence")).where("z >= 1")


def centroid_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The centroid of each label, as its cosine to the label's vectors."""
    e = load(spark, d, "embeddings")
    c = vs.centroids(e, "label", "embedding")
    near = e.join(c, "label").groupBy("label").agg(F.max("n").alias("n"), F.avg(vx.dot(F.col("embedding"), F.col("centroid"))).alias("cohesion"))
    return near.select("label", "n", _round("cohesion", 5).alias("cohesion"))


def ensemble_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to the mean of three."""
    e = load(spark, d, "embeddings")
    q = vs.ensemble(e.where("vec_id in (1, 2, 3)"), "embedding")
    scored = e.join(F.broadcast(q)).select("vec_id", vx.dot(F.col("embedding"), F.col("vector")).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", _round("s").alias("similarity"))


def int8_codec(spark: SparkSession, d: str) -> DataFrame:
    """Cosine between vectors and what their int8 form gives back."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    v = F.col("embedding")
    back = vx.int8_decode(vx.int8_values(v), vx.int8_scale(v))
    return e.select("vec_id", _round(vx.int8_scale(v), 8).alias("scale"), _round(vx.cosine(v, back), 5).alias("cosine"))


def dimension_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Models whose tables disagree on the number of dimensions."""
    s = load(spark, d, "voice_segments")
    return vs.dimension_conflicts((s, "model_id", "dimensions"), (s.where("embedding is not null").withColumn("k", F.size("embedding")), "model_id", "k"))


def hamming_hash(spark: SparkSession, d: str) -> DataFrame:
    """Bits in which neighbouring events differ."""
    e = load(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select("event_id", vx.hamming(F.col("event_id"), F.lag("event_id").over(w)).alias("bits")).where("bits is not null")


def _candidates(spark, d):
    """Hits of an evaluation as candidates of channels."""
    h = load(spark, d, "evaluated_hits").where("start_seconds is not null").distinct()
    channel = F.element_at(F.array(*(F.lit(c) for c in ("visual", "transcript", "ocr", "label"))), (F.col("hit_id") % 4 + 1).cast("int"))
    return h.select(
        F.xxhash64(F.lower("asset_name")).alias("asset_id"), F.lower("asset_name").alias("file"), F.col("hit_id").alias("moment_id"), F.col("start_seconds").alias("seconds"),
        F.greatest("end_seconds", "start_seconds").alias("end_seconds"), channel.alias("channel"), "rank_no", F.coalesce("score", F.lit(0.0)).alias("confidence"),
    )


def temporal_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of evidence per file (a fold in order of time, so without SQL)."""
    f = fu.ordering(fu.fuse(_candidates(spark, d).drop("file")))
    return f.groupBy("asset_id").agg(F.count("*").alias("n"), _round(F.max("confidence")).alias("best"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Rank fusion of the best rank per file and channel."""
    best = _candidates(spark, d).groupBy("file", "channel").agg(F.min("rank_no").alias("r"))
    m = best.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("channel", "r"))).alias("ranks"))
    return m.select("file", _round(fu.rank_fusion(F.col("ranks")), 8).alias("score"))


def noisy_or_rank(spark: SparkSession, d: str) -> DataFrame:
    """Noisy-or of the best confidence per file and channel; the first 100."""
    best = _candidates(spark, d).groupBy("file", "channel").agg(F.max("confidence").alias("c"))
    m = best.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("channel", "c"))).alias("conf"))
    return m.select("file", _round(fu.noisy_or(F.col("conf")), 8).alias("confidence")).orderBy(F.desc("confidence"), "file").limit(100)


def trim_results(spark: SparkSession, d: str) -> DataFrame:
    """Three times the limit, at most three of a file, then the limit."""
    c = _candidates(spark, d).select("asset_id", "moment_id", F.col("seconds").alias("start_seconds"), "confidence", F.col("confidence").alias("score"))
    w = Window.orderBy(F.desc("score"), "moment_id")
    return fu.trim(c.withColumn("asset_id", F.pmod("moment_id", F.lit(7))), 20, 0.1).select("moment_id", "position")


def graded_hits(spark: SparkSession, d: str) -> DataFrame:
    """The grade of each hit."""
    g = ev.graded_hits(load(spark, d, "evaluated_hits").distinct(), load(spark, d, "relevant_moments").distinct())
    return g.select("hit_id", "judgement_id", "grade")


def _cases(spark, d):
    j = load(spark, d, "relevant_moments").distinct()
    return ev.case_metrics(ev.graded_hits(load(spark, d, "evaluated_hits").distinct(), j), j)


def ndcg_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each case."""
    c = _cases(spark, d)
    return c.select("case_id", "first_rank", *(_round(x).alias(x) for x in ("recall10", "recall50", "reciprocal_rank", "ndcg10")), "n_hits")


def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means over all cases."""
    s = ev.summary(_cases(spark, d).withColumn("is_positive", F.col("n_hits").isNotNull() & ~F.col("false_positive")))
    return s.select("n_cases", *(_round(x).alias(x) for x in ("recall10", "recall50", "mrr", "ndcg10")), "false_positives")


def calibration_buckets(spark: SparkSession, d: str) -> DataFrame:
    """How often hits of a score are relevant."""
    h = load(spark, d, "evaluated_hits").distinct()
    g = ev.graded_hits(h, load(spark, d, "relevant_moments").distinct()).select("hit_id", "grade").join(h.select("hit_id", "score"), "hit_id").where("score is not null")
    return ev.calibration(g.withColumn("ok", F.col("grade") > 0), "score", "ok")


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and f1 of thresholds from 0.05 to 0.40."""
    h = load(spark, d, "evaluated_hits").distinct()
    g = ev.graded_hits(h, load(spark, d, "relevant_moments").distinct()).select("hit_id", "grade").join(h.select("hit_id", "score"), "hit_id").where("score is not null")
    s = ev.threshold_sweep(g.withColumn("ok", F.col("grade") > 0), "score", "ok")
    return s.select(_round("threshold", 4).alias("threshold"), *(_round(c).alias(c) for c in ("precision", "recall", "f1")))


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    """The upper median of the values of events."""
    return ev.upper_median(load(spark, d, "events"), "value")


def rank_changes(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose first relevant rank differs if only confident hits count."""
    h, j = load(spark, d, "evaluated_hits").distinct(), load(spark, d, "relevant_moments").distinct()
    first = lambda x: ev.graded_hits(x, j).groupBy("case_id").agg(F.min(F.when(F.col("grade") > 0, F.col("rank_no"))).alias("first_rank"))
    return ev.changed_cases(first(h), first(h.where("score >= 0.5")))


_J12 = """
h as (select distinct * from evaluated_hits), j as (select distinct * from relevant_moments),
m as (select h.hit_id, h.case_id, j.judgement_id, coalesce(j.grade, 1) grade, row_number() over (partition by h.case_id, h.hit_id order by coalesce(j.grade, 1) desc, j.judgement_id) r
  from h join j on h.case_id = j.case_id and lower(regexp_extract(h.asset_name, '[^/]*$')) = lower(regexp_extract(j.asset, '[^/]*$'))
  where j.at_seconds is null or j.at_seconds between h.start_seconds and h.end_seconds or abs(h.start_seconds - j.at_seconds) <= coalesce(j.tolerance_seconds, 30)),
g as (select h.hit_id, h.case_id, h.rank_no, h.score, m.judgement_id, coalesce(m.grade, 0) grade from h left join m on m.hit_id = h.hit_id and m.case_id = h.case_id and m.r = 1)
"""
_CASE = f"""with {_J12},
f as (select case_id, judgement_id, min(rank_no) r from g where judgement_id is not null group by 1, 2),
rc as (select case_id, count_if(r <= 10) a, count_if(r <= 50) b from f group by 1),
dc as (select case_id, sum(case when rank_no <= 10 and grade > 0 then (2 ** grade - 1) / log2(rank_no + 1) else 0 end) dcg, min(case when grade > 0 then rank_no end) first_rank, count(*) n_hits from g group by 1),
io as (select case_id, coalesce(grade, 1) g0, row_number() over (partition by case_id order by coalesce(grade, 1) desc, judgement_id) i from j),
idl as (select case_id, sum(case when i <= 10 and g0 > 0 then (2 ** g0 - 1) / log2(i + 1) else 0 end) ideal, count(*) nj from io group by 1),
cs as (select case_id, first_rank, coalesce(coalesce(a, 0) / nj, 0) recall10, coalesce(coalesce(b, 0) / nj, 0) recall50, coalesce(1 / first_rank, 0) reciprocal_rank,
  case when ideal > 0 then coalesce(dcg, 0) / ideal else 0 end ndcg10, coalesce(n_hits, 0) n_hits, nj is null and n_hits > 0 fp
  from dc full join idl using (case_id) left join rc using (case_id))"""
_CAND = """c as (select lower(asset_name) file, hit_id, rank_no, coalesce(score, 0) confidence, ['visual', 'transcript', 'ocr', 'label'][hit_id % 4 + 1] channel,
  start_seconds from (select distinct * from evaluated_hits) where start_seconds is not null)"""
_TF = [_word(t) for t in TERMS]
_Q = "q as (select cast(embedding as double[]) v from embeddings where vec_id = 0)"

SQL = {
    "bm25_topk": _bm25_sql(_TF) + " select doc_id, row_number() over (order by score desc, doc_id) rank_no, round(score, 6) score from sc order by 2 limit 20",
    "bm25_prefix": _bm25_sql([_prefix("cam"), _prefix("fri")]) + " select doc_id, round(score, 6) score from sc",
    "phrase_match": _bm25_sql([_phrase("red", "car"), _phrase("coche", "rojo")]) + " select doc_id, round(score, 6) score from sc",
    "bm25_index": f"with {_W}, {_STATS}, p as (select doc_id, unnest(ws) t from w) select count(distinct t) n_terms, (select count(*) from (select distinct doc_id, t from p)) n_postings, count(*) n_words, any_value(n) n_all, round(any_value(a), 6) mean_words from p, st",
    "bm25_scan": _bm25_sql([_word("guitarra"), _prefix("cam"), _phrase("red", "car")]) + " select doc_id, round(score, 6) score from sc",
    "mixed_patterns": _bm25_sql([_word("guitarra"), _prefix("cam"), _phrase("red", "car")]) + " select doc_id, round(score, 6) score from sc",
    "snippets": "with t as (select doc_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') p from documents where text is not null),"
    " f as (select *, list_transform(p, lambda x: trim(regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', ' ', 'g'))) g from t), a as (select *, list_position(g, 'camara') i from f)"
    " select doc_id, array_to_string(list_transform(range(greatest(1, i - 6), least(len(p), greatest(1, i - 6) + 11) + 1), lambda k: case when g[k] = 'camara' then '«' || p[k] || '»' else p[k] end), ' ') snippet from a where i > 0",
    "postings": f"with {_W}, p as (select doc_id, len(ws) dl, unnest(ws) term from w) select term, count(distinct doc_id) n_rows, count(*) n, max(dl) longest from p group by 1",
    "grouped_text_topk": _bm25_sql(_TF) + " select * from (select kind, doc_id, row_number() over (partition by kind order by score desc, doc_id) rank_no, round(score, 6) score from sc) where rank_no <= 5",
    "prefix_breadth": f"with {_W}, v as (select t, count(*) n from (select doc_id, unnest(list_distinct(ws)) t from w) group by 1)"
    " select p prefix, cast(coalesce(sum(n), 0) as bigint) breadth from (values ('ca'), ('man'), ('zzz')) x(p) left join v on starts_with(t, p) group by 1",
    "text_confidence": _bm25_sql(_TF) + ", b as (select *, row_number() over (order by score desc, doc_id) r from sc), k as (select *, ("
    + " + ".join(f"case when contains({_FOLD.format('text')}, '{t}') then 1 else 0 end" for t in TERMS)
    + ") / 4.0 coverage from b where r <= 50) select doc_id, coverage, round(coverage / (1 + (r - 1) / 10.0), 6) confidence from k",
    "label_rarity": "with t as (select count(distinct asset_id) n from documents), c as (select kind identifier, count(distinct asset_id) c from documents group by 1)"
    " select identifier, c n_assets, round(case when n <= 1 then 1 when c >= n then 0 else ln(n / c) / ln(n) end, 6) rarity from c, t",
    "fold_names": f"select distinct person_id, {_FOLD.format('display_name')} folded from people where display_name is not null",
    "name_similarity": f"with n as ({_TRI}), s as (select person_id, f, list_filter(string_split(f, ' '), lambda x: x <> '') ws from n)"
    " select person_id, round(case when len(ws) = 0 then 0 else len(list_filter(ws, lambda x: x in ('rosario', 'dolores'))) / len(ws) end, 6) overlap,"
    " round(case when f = '' then 1 else levenshtein('rosario dolores', f) / greatest(length(f), 15) end, 6) distance from s",
    "trigram_names": f"with n as ({_TRI}), t as (select person_id, list_distinct(list_transform(range(1, length(f) - 1), lambda i: substring(f, i, 3))) g from n where length(f) >= 3)"
    " select person_id, len(list_intersect(g, list_transform(range(1, 9), lambda i: substring('montserrat', i, 3)))) shared from t where shared > 0",
    "timecodes": "with t as (select distinct hit_id, cast(case when isfinite(start_seconds) and start_seconds >= 0 then round(start_seconds) else 0 end as bigint) s from evaluated_hits)"
    " select hit_id, case when s >= 3600 then printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) else printf('%02d:%02d', s // 60, s % 60) end shown from t",
    "vector_topk": f"with {_Q}, s as (select vec_id, list_dot_product(cast(embedding as double[]), v) s from embeddings, q)"
    " select * from (select vec_id, row_number() over (order by s desc, vec_id) rank_no, round(s, 6) similarity from s) where rank_no <= 25",
    "library_zscore": f"with {_Q}, n as (select greatest(1, count(*) // 256) k from embeddings), s as (select vec_id, list_dot_product(cast(embedding as double[]), v) s from embeddings, q),"
    " sm as (select s from s, n where vec_id % k = 0 order by vec_id limit 256), st as (select avg(s) m, stddev_pop(s) d from sm)"
    " select vec_id, round((s - m) / greatest(d, 1e-6), 4) z, round(least(1, greatest(0, ((s - m) / greatest(d, 1e-6) - 1) / 2)), 4) confidence from s, st where z >= 1",
    "centroid_refresh": "with e as (select label, cast(embedding as double[]) v from embeddings), u as (select label, generate_subscripts(v, 1) p, unnest(v) x from e),"
    " c as (select label, p, sum(x) x from u group by 1, 2), l as (select label, list(x order by p) v from c group by 1),"
    " n as (select label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) c from l)"
    " select label, count(*) n, round(avg(list_dot_product(v, c)), 5) cohesion from e join n using (label) group by 1",
    "ensemble_topk": "with u as (select generate_subscripts(v, 1) p, unnest(v) x from (select cast(embedding as double[]) v from embeddings where vec_id in (1, 2, 3))),"
    " s as (select list(x order by p) v from (select p, sum(x) x from u group by 1)), q as (select list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v from s),"
    " r as (select vec_id, list_dot_product(cast(embedding as double[]), v) s from embeddings, q) select vec_id, round(s, 6) similarity from r order by s desc, vec_id limit 10",
    "int8_codec": "with e as (select vec_id, cast(embedding as double[]) v from embeddings), s as (select *, list_max(list_transform(v, lambda x: abs(x))) / 127 sc from e),"
    " b as (select *, list_transform(v, lambda x: round(x / sc) * sc) w from s)"
    " select vec_id, round(sc, 8) as scale, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 5) cosine from b",
    "dimension_conflict": "with u as (select model_id, dimensions k from voice_segments union all select model_id, len(embedding) from voice_segments where embedding is not null)"
    " select model_id, cast(min(k) as int) least, cast(max(k) as int) most from u group by 1 having min(k) <> max(k)",
    "hamming_hash": "with l as (select event_id, lag(event_id) over (partition by user_id order by event_id) p from events) select event_id, bit_count(xor(event_id, p)) bits from l where p is not null",
    "rrf_fusion": f"with {_CAND}, b as (select file, channel, min(rank_no) r from c group by 1, 2)"
    " select file, round(sum(case channel when 'visual' then 0.45 when 'transcript' then 0.35 when 'ocr' then 0.12 else 0.2 end / (60 + r)), 8) score from b group by 1",
    "noisy_or_rank": f"with {_CAND}, b as (select file, channel, max(confidence) c from c group by 1, 2)"
    " select file, round(1 - product(1 - case channel when 'visual' then 1.0 when 'label' then 0.85 else 0.95 end * c), 8) confidence from b group by 1 order by 2 desc, 1 limit 100",
    "trim_results": f"with {_CAND}, a as (select hit_id % 7 asset, hit_id, start_seconds, confidence from c where confidence >= 0.1 order by confidence desc, asset, start_seconds, hit_id limit 60),"
    " k as (select *, row_number() over (partition by asset order by confidence desc, start_seconds, hit_id) n from a)"
    " select hit_id moment_id, row_number() over (order by confidence desc, asset, start_seconds, hit_id) position from k where n <= 3 order by 2 limit 20",
    "graded_hits": f"with {_J12} select hit_id, judgement_id, grade from g",
    "ndcg_recall_mrr": _CASE + " select case_id, first_rank, round(recall10, 6) recall10, round(recall50, 6) recall50, round(reciprocal_rank, 6) reciprocal_rank, round(ndcg10, 6) ndcg10, n_hits from cs",
    "quality_summary": _CASE + " select count(*) n_cases, round(avg(recall10) filter (not coalesce(fp, false)), 6) recall10, round(avg(recall50) filter (not coalesce(fp, false)), 6) recall50,"
    " round(avg(reciprocal_rank) filter (not coalesce(fp, false)), 6) mrr, round(avg(ndcg10) filter (not coalesce(fp, false)), 6) ndcg10, count_if(coalesce(fp, false)) false_positives from cs",
    "calibration_buckets": f"with {_J12} select least(9, greatest(0, cast(floor(score * 10) as int))) / 10 lower_bound, count(*) hits, count_if(grade > 0) relevant from g where score is not null group by 1",
    "threshold_sweep": f"with {_J12}, s as (select floor(score / 0.005 + 1e-9) b, grade > 0 ok from g where score is not null), t as (select count_if(ok) p from s),"
    " x as (select i, count(b) n, count_if(ok) tp from range(10, 81) r(i) left join s on b >= i group by 1),"
    " y as (select i * 0.005 threshold, case when n > 0 then tp / n else 0 end pr, case when p > 0 then tp / p else 0 end rc from x, t)"
    " select round(threshold, 4) threshold, round(pr, 6) as \"precision\", round(rc, 6) recall, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end, 6) f1 from y",
    "upper_median": "with n as (select count(value) n from events), r as (select value, row_number() over (order by value) - 1 i from events where value is not null) select value upper_median from r, n where i = n // 2",
    "rank_changes": f"with {_J12}, a as (select case_id, min(case when grade > 0 then rank_no end) x from g group by 1), b as (select case_id, min(case when grade > 0 then rank_no end) y from g where score >= 0.5 group by 1)"
    " select case_id, x rank_before, y rank_now from a join b using (case_id) where x is distinct from y",
}

QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_prefix, phrase_match, bm25_index, bm25_scan, mixed_patterns, snippets, postings, grouped_text_topk, prefix_breadth, text_confidence, label_rarity, fold_names, name_similarity,
        trigram_names, timecodes, vector_topk, library_zscore, centroid_refresh, ensemble_topk, int8_codec, dimension_conflict, hamming_hash, temporal_fusion, rrf_fusion,
        noisy_or_rank, trim_results, graded_hits, ndcg_recall_mrr, quality_summary, calibration_buckets, threshold_sweep, upper_median, rank_changes,
    )
}
