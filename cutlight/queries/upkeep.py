"""Queries over jobs, gates, pages, dates, plans and approximate search, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutlight.functions import text as tx
from cutlight.functions import vectors as vx
from cutlight.operators import catalogue as ca
from cutlight.operators import jobs as jb
from cutlight.operators import people as pe
from cutlight.operators import usage as us
from cutlight.operators import vector_index as vi
from cutlight.operators import vector_search as vs
from cutlight.plans import planner as pl
from cutlight.sources import evaluation_sets as es
from cutlight.sources import load

NOW = datetime(2026, 9, 5, 12)


def _jobs(spark, d):
    """Three jobs for each asset, in states that depend on their number."""
    a = load(spark, d, "assets").select("asset_id").distinct()
    rows = a.select("asset_id", F.posexplode(F.array(*map(F.lit, ("metadata", "visual", "ocr")))).alias("k", "task"))
    number = F.col("asset_id") * 3 + F.col("k")
    state = F.element_at(F.array(*map(F.lit, ("pending", "done", "pending", "running", "pending", "failed", "pending"))), (F.pmod(number, F.lit(7)) + 1).cast("int"))
    return rows.select(number.alias("job_id"), "asset_id", "task", state.alias("state"), F.pmod(number, F.lit(5)).cast("int").alias("priority"), F.pmod(number, F.lit(4)).cast("int").alias("attempts"), F.lit(None).cast("string").alias("last_error"))


def job_queue(spark: SparkSession, d: str) -> DataFrame:
    """The job that each idle asset is to have next."""
    return jb.claimable(_jobs(spark, d), ["metadata", "visual"]).select("job_id", "asset_id", "task", "priority")


def job_wave(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by state and attempts after a wave: claimed, those of odd assets failed, the others done, the rest requeued."""
    jobs = _jobs(spark, d)
    heads = jb.claimable(jobs, ["metadata", "visual"])
    running = jb.claim(jobs, heads)
    after = jb.fail(jb.complete(running, heads.where("asset_id % 2 = 0")), heads.where("asset_id % 2 = 1").select("job_id", F.lit("no sound").alias("error")))
    return jb.requeue_stale(after).groupBy("task", "state", "attempts").agg(F.count("*").alias("n"), F.count("last_error").alias("n_errors"))


def job_backfill(spark: SparkSession, d: str) -> DataFrame:
    """T4, T5: jobs by task and state after a new version of OCR wants all assets with visual analysis again, and speech is wanted for what has no segment."""
    jobs = _jobs(spark, d)
    a = load(spark, d, "assets").select("asset_id", "indexed_levels", "media_type").distinct()
    seen = a.where(F.col("indexed_levels").bitwiseAND(2) != 0).select("asset_id", F.lit("ocr").alias("task"), F.lit(1).alias("priority"))
    after, _ = jb.backfill(jobs, {"ocr": "1"}, "ocr", "2", seen)
    silent = ca.orphans(a.where("media_type <> 'image'"), "asset_id", load(spark, d, "voice_segments"), "asset_id")
    after = jb.enqueue(after, silent.select("asset_id", F.lit("speech").alias("task"), F.lit(4).alias("priority")))
    return after.groupBy("task", "state", "priority").agg(F.count("*").alias("n"), F.max("attempts").alias("most_attempts"))


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of vectors of a model that follows an id."""
    rows = load(spark, d, "voice_segments").where("model_id = 'voiceprint-offline-v2' and embedding is not null").select("segment_id", F.size("embedding").alias("size")).distinct()
    return ca.page_after(rows, "segment_id", 1000)


def moment_previews(spark: SparkSession, d: str) -> DataFrame:
    """Moments with a preview, in order, at most five thousand; every third hit has one."""
    h = load(spark, d, "evaluated_hits").where("start_seconds is not null").select(F.col("hit_id").alias("moment_id"), F.col("rank_no").alias("asset_id"), "start_seconds").distinct()
    previews = h.where("moment_id % 3 = 0").select("moment_id", F.format_string("previews/%d.jpg", "moment_id").alias("path"))
    return ca.moments_with_previews(h, previews).select("moment_id", "asset_id", "path")


def label_gate(spark: SparkSession, d: str) -> DataFrame:
    """the five surest files of each case, of score 0.3 or more."""
    h = load(spark, d, "evaluated_hits").groupBy("case_id", F.lower(tx.basename(F.col("asset_name"))).alias("identifier")).agg(F.max("score").alias("confidence"))
    return ca.best_labels(h, "case_id")


def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    """Segments that pass each gate, by model."""
    s = load(spark, d, "voice_segments").select("segment_id", "model_id", "speaker", "start_seconds", "end_seconds", "confidence", "dimensions", F.coalesce(F.size("embedding"), F.lit(0)).alias("size")).distinct()
    minute = F.pmod(F.col("segment_id"), F.lit(1440))
    face = pe.face_gate(F.pmod(F.col("segment_id"), F.lit(100)) / 1000.0, F.lit(1000), F.col("confidence"), F.pmod(F.col("segment_id"), F.lit(91)).cast("double"))
    return s.groupBy("model_id").agg(
        F.count_if(ca.text_gate(F.col("speaker"), F.col("confidence"))).alias("texts"), F.count_if(ca.speech_gate(F.col("start_seconds"), F.col("end_seconds"), F.col("confidence"))).alias("speech"),
        F.count_if(vx.valid_embedding(F.col("dimensions"), F.lit("int8"), F.col("size"), F.lit(1.0))).alias("embeddings"), F.count_if(face).alias("faces"), F.count_if(jb.within_daily_window(minute, 1320, 360)).alias("at_night"),
    )


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """Locations whose deliveries differ in size or time, and assets with a level added."""
    l = load(spark, d, "locations").select("location_id", "file_size", "modified_at", "loaded_at").distinct()
    w = Window.partitionBy("location_id").orderBy("loaded_at", "file_size", "modified_at")
    before = l.withColumns({"s": F.lag("file_size").over(w), "m": F.lag("modified_at").over(w), "n": F.row_number().over(w)}).where("n > 1")
    same = before.groupBy(ca.same_revision(F.col("file_size"), F.col("modified_at"), F.col("s"), F.col("m")).alias("same")).agg(F.count("*").alias("n")).select(F.when(F.col("same"), "same revision").otherwise("changed").alias("what"), "n")
    a = load(spark, d, "assets").select("asset_id", "indexed_levels").distinct().select(F.format_string("levels %d", ca.add_levels(F.col("indexed_levels"), 4)).alias("what"))
    return same.unionByName(a.groupBy("what").agg(F.count("*").alias("n")))


def scan_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """C4: what a scan would find if every second file had another content: outcomes and their number."""
    l = load(spark, d, "locations").where("asset_id > 0").groupBy("volume_uuid", "relative_path").agg(F.min(F.struct("asset_id", "file_size", "modified_at", "availability")).alias("l")).select("volume_uuid", "relative_path", "l.*")
    a = load(spark, d, "assets").groupBy("asset_id").agg(F.min("content_key").alias("content_key"))
    other = F.when(F.pmod(F.col("asset_id"), F.lit(3)) == 0, F.concat(F.lit("new"), "content_key")).otherwise(F.col("content_key"))
    grown = F.col("file_size") + F.pmod(F.col("asset_id"), F.lit(2))
    moved = F.when(F.pmod(F.col("asset_id"), F.lit(5)) == 0, F.concat(F.lit("moved/"), "relative_path")).otherwise(F.col("relative_path"))
    scan = l.join(a, "asset_id").select("volume_uuid", moved.alias("relative_path"), grown.alias("file_size"), "modified_at", other.alias("content_key"))
    return ca.scan_outcomes(scan, l, a).groupBy("outcome").agg(F.count("*").alias("n"))


def face_identities(spark: SparkSession, d: str) -> DataFrame:
    """Persons of segments after voices were merged and reassigned; what a user assigned stays."""
    s = load(spark, d, "voice_segments").select(F.col("segment_id").alias("face_id"), F.col("voice_id").alias("person_id"), F.when(F.pmod(F.col("segment_id"), F.lit(4)) == 0, "user").otherwise("auto").alias("assigned_by")).distinct()
    merged = pe.merge_people(s, s.where("person_id % 10 = 3").select("person_id", (F.col("person_id") - 1).alias("survivor")))
    after = pe.reassign_faces(merged, s.where("face_id % 3 = 0").select("face_id", F.lit(7).cast("bigint").alias("person_id")))
    return after.where("person_id is not null").groupBy("person_id").agg(F.count("*").alias("n"))


def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best hits, the first forty blended with a second score."""
    h = load(spark, d, "evaluated_hits").where("score is not null").select(F.col("hit_id").alias("row_id"), F.col("score").alias("confidence")).distinct()
    top = h.orderBy(F.desc("confidence"), "row_id").limit(100)
    top = top.withColumn("rank_no", F.row_number().over(Window.orderBy(F.desc("confidence"), "row_id")))
    second = top.where("row_id % 4 <> 0").select("row_id", (F.pmod("row_id", F.lit(97)) / 97.0).alias("confidence2"))
    return vs.rerank(top, second, 0.35).select("row_id", "rank_no", F.round("confidence", 6).alias("confidence"))


def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors by the stored index, which is of the table's model and size."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    index = vi.build(e, "vec_id", "embedding", "m")
    found = vi.nearest(e, "vec_id", "embedding", "m", list(q[0]) if q else [0.0], 10, index, probes=64)
    return found.select(F.col("row_id").alias("vec_id"), "rank_no", F.round("similarity", 6).alias("similarity"))


def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Creation times as cameras and standards write them."""
    a = load(spark, d, "assets").where("created_at is not null").select("asset_id", F.date_trunc("second", "created_at").alias("t")).distinct()
    written = F.when(F.pmod("asset_id", F.lit(3)) == 0, F.date_format("t", "yyyy:MM:dd HH:mm:ss")).when(F.pmod("asset_id", F.lit(3)) == 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("not a date"))
    return a.select("asset_id", F.coalesce(F.unix_seconds(tx.parse_date(written)), F.lit(0)).alias("seconds"))


def judged_cases(spark: SparkSession, d: str) -> DataFrame:
    """Judgements of an evaluation set given as nested cases."""
    j = load(spark, d, "relevant_moments").distinct()
    item = F.struct("asset", F.col("at_seconds").alias("at"), "grade", F.col("tolerance_seconds").alias("toleranceSeconds"))
    cases = j.groupBy("case_id").agg(F.collect_list(item).alias("relevant")).withColumn("tolerance", F.lit(20.0))
    return es.judgements(cases).groupBy("case_id").agg(F.count("*").alias("n"), F.sum("grade").cast("bigint").alias("grades"), F.round(F.sum("tolerance_seconds"), 3).alias("tolerances"))


#: Typed queries, with what they ask for.
TYPED = ["fotos del mar marzo 2025", "fotos y videos", "un podcast 2024", "hace 3 semanas", "IMG_0042", "toma 7", "hombre con playera azul", "the last year", "el de la", 'busca "no había presupuesto" toma azul']
_LEXICON = pl.Lexicon([("playera", "t-shirt"), ("playera azul", "blue t-shirt"), ("hombre", "man"), ("mar", "sea")])


def typed_queries(spark: SparkSession, d: str) -> DataFrame:
    """What the planner makes of typed queries."""
    rows = []
    for q in TYPED:
        p = pl.plan_query(q, _LEXICON, NOW)
        rows.append((q, p.media_type, *(str(t) for t in p.created or (None, None)), pl.describable(q), "|".join(p.literal), "|".join(p.visual), p.source))
    return spark.createDataFrame(rows, "query string, media_type string, created_from string, created_to string, describable boolean, literal string, visual string, source string").replace("None", None)


def word_rules(spark: SparkSession, d: str) -> DataFrame:
    """Plurals, label words, empty answers, captions and query hashes."""
    rows = [("spanish", w, pl.spanish_plural(w)) for w in ("luz", "mujer", "mesa", "lentes")] + [("english", w, pl.english_plural(w)) for w in ("city", "watch", "dog", "bus stop")]
    rows += [("labels", p, "|".join(pl.label_terms([p]))) for p in ("A photo of a duck", "duck pond scene duck")] + [("nothing", t, str(pl.says_nothing(t)).lower()) for t in (" None. ", "noon", "n/a")]
    rows += [("captions", "a dog", "|".join(pl.captions("a dog"))), ("hash", "El  Mar", us.query_hash(b"key", "El  Mar"))]
    return spark.createDataFrame(rows, "rule string, word string, result string")


_JOBS = """j as (select asset_id * 3 + k job_id, asset_id, ['metadata', 'visual', 'ocr'][k + 1] task,
  ['pending', 'done', 'pending', 'running', 'pending', 'failed', 'pending'][(asset_id * 3 + k) % 7 + 1] state, cast((asset_id * 3 + k) % 5 as int) priority, cast((asset_id * 3 + k) % 4 as int) attempts
  from (select distinct asset_id from assets), (select unnest(range(3)) k)),
c as (select *, row_number() over (partition by asset_id order by priority, job_id) r from j where state = 'pending' and task in ('metadata', 'visual') and attempts < 3
  and asset_id not in (select asset_id from j where state = 'running')), h as (select job_id, asset_id, task, priority, attempts from c where r = 1)"""
_SEG = "s as (select distinct segment_id, model_id, speaker, start_seconds b, end_seconds e, confidence c, dimensions, coalesce(len(embedding), 0) z from voice_segments)"

SQL = {
    "job_queue": f"with {_JOBS} select job_id, asset_id, task, priority from h",
    "job_wave": f"with {_JOBS}, w as (select j.task, case when h.job_id is null then case when j.state = 'running' then 'pending' else j.state end when j.asset_id % 2 = 0 then 'done' when j.attempts + 1 >= 3 then 'failed' else 'pending' end state,"
    " cast(j.attempts + case when h.job_id is not null and j.asset_id % 2 = 1 then 1 else 0 end as int) attempts, h.job_id is not null and j.asset_id % 2 = 1 bad from j left join h using (job_id))"
    " select task, state, attempts, count(*) n, count_if(bad) n_errors from w group by 1, 2, 3",
    "job_backfill": f"with {_JOBS}, a as (select distinct asset_id, indexed_levels l, media_type from assets), o as (select asset_id from a where l & 2 <> 0),"
    " x as (select task, case when hit then 'pending' else state end state, case when hit then 1 else priority end priority, case when hit then 0 else attempts end attempts from (select *, task = 'ocr' and asset_id in (select asset_id from o) hit from j)"
    " union all select 'speech', 'pending', 4, 0 from (select distinct asset_id from a where media_type <> 'image' and asset_id not in (select asset_id from voice_segments where asset_id is not null)))"
    " select task, state, priority, count(*) n, max(attempts) most_attempts from x group by 1, 2, 3",
    "keyset_page": "select * from (select distinct segment_id, cast(len(embedding) as int) size from voice_segments where model_id = 'voiceprint-offline-v2' and embedding is not null) where segment_id > 1000 order by segment_id limit 4096",
    "moment_previews": "select moment_id, asset_id, path from (select distinct hit_id moment_id, rank_no asset_id, printf('previews/%d.jpg', hit_id) path, start_seconds from evaluated_hits where start_seconds is not null and hit_id % 3 = 0) order by asset_id, start_seconds, moment_id limit 5000",
    "label_gate": "with h as (select case_id, lower(regexp_extract(asset_name, '[^/]*$')) identifier, max(score) confidence from evaluated_hits group by 1, 2), r as (select *, row_number() over (partition by case_id order by confidence desc, identifier) r from h where confidence >= 0.3)"
    " select case_id, identifier, confidence from r where r <= 5",
    "quality_gates": f"with {_SEG} select model_id, count_if(c >= 0.35 and length(trim(speaker)) >= 2) texts, count_if((e - b >= 1 or isnan(e - b)) and c >= 0.5) speech, count_if(dimensions between 1 and 16384 and z = dimensions) embeddings,"
    " count_if((segment_id % 100) / 1000.0 * 1000 >= 64 and coalesce(c, 1) >= 0.35 and segment_id % 91 <= 45) faces, count_if(segment_id % 1440 >= 1320 or segment_id % 1440 < 360) at_night from s group by 1",
    "revisions": "with l as (select distinct location_id, file_size, modified_at, loaded_at from locations), b as (select *, lag(file_size) over w s, lag(modified_at) over w m, row_number() over w n from l window w as (partition by location_id order by loaded_at, file_size, modified_at nulls first))"
    " select case when coalesce(file_size = s and abs(epoch_us(modified_at) - epoch_us(m)) < 1000, false) then 'same revision' else 'changed' end what, count(*) n from b where n > 1 group by 1"
    " union all select printf('levels %d', coalesce(l, 0) | 4), count(*) from (select distinct asset_id, indexed_levels l from assets) group by 1",
    "scan_outcomes": "with l as (select volume_uuid, relative_path, min({'a': asset_id, 's': file_size, 'm': coalesce(modified_at, timestamptz '1900-01-01 00:00:00+00'), 'v': availability}) l from locations where asset_id > 0 group by 1, 2), k as (select asset_id, min(content_key) ck from assets group by 1),"
    " s as (select volume_uuid, case when asset_id % 5 = 0 then 'moved/' || relative_path else relative_path end p, l.s + asset_id % 2 fs, l.m m, case when asset_id % 3 = 0 then 'new' || ck else ck end ck from l join k on k.asset_id = l.l.a),"
    " q as (select ck, min(asset_id) same from k group by 1), z as (select distinct l.a a from l where l.v = 'missing')"
    " select case when l.l is not null and s.fs = l.l.s and s.m = l.l.m and year(s.m) > 1900 then 'unchanged' when q.same is null then 'new_asset' when l.l is not null then 'rebound' when q.same in (select a from z) then 'renamed' else 'new_location' end outcome, count(*) n"
    " from s left join l on l.volume_uuid = s.volume_uuid and l.relative_path = s.p left join q on q.ck = s.ck group by 1",
    "face_identities": "with s as (select distinct segment_id f, voice_id p, segment_id % 4 = 0 u from voice_segments), m as (select f, u, case when p % 10 = 3 then p - 1 else p end p from s)"
    " select case when f % 3 = 0 and not u then 7 else p end person_id, count(*) n from m where p is not null or f % 3 = 0 and not u group by 1",
    "rerank_blend": "with h as (select distinct hit_id i, score c from evaluated_hits where score is not null order by c desc, i limit 100), r as (select *, row_number() over (order by c desc, i) r from h),"
    " b as (select i, case when r <= 40 and i % 4 <> 0 then c * 0.65 + (i % 97) / 97.0 * 0.35 else c end c from r) select i row_id, row_number() over (order by c desc, i) rank_no, round(c, 6) confidence from b",
    "ann_topk": "with q as (select cast(embedding as double[]) v from embeddings where vec_id = 0), s as (select vec_id, list_dot_product(cast(embedding as double[]), v) s from embeddings, q)"
    " select * from (select vec_id, row_number() over (order by s desc, vec_id) rank_no, round(s, 6) similarity from s) where rank_no <= 10",
    "parsed_dates": "select distinct asset_id, case when asset_id % 3 = 2 then 0 else epoch(created_at)::bigint - case when epoch(created_at)::bigint > epoch(created_at) then 1 else 0 end end as \"seconds\" from assets where created_at is not null",
    "judged_cases": "select case_id, count(*) n, cast(sum(coalesce(grade, 1)) as bigint) grades, round(sum(coalesce(tolerance_seconds, 20)), 3) tolerances from (select distinct * from relevant_moments) group by 1",
    "typed_queries": """select * from (values
      ('fotos del mar marzo 2025', 'image', '2025-03-01 00:00:00', '2025-03-31 23:59:59', true, 'mar|marzo|2025', 'sea marzo 2025|fotos del mar marzo 2025', 'lexicon'),
      ('fotos y videos', null, null, null, true, 'videos', 'videos|fotos y videos', 'lexicon'),
      ('un podcast 2024', 'audio', '2024-01-01 00:00:00', '2024-12-31 23:59:59', true, 'podcast|2024', 'podcast 2024|un podcast 2024', 'lexicon'),
      ('hace 3 semanas', null, '2026-08-08 12:00:00', '2026-08-22 12:00:00', true, 'hace|semanas', 'hace 3 semanas', 'literal'),
      ('IMG_0042', null, null, null, false, 'img|0042', '', 'literal'), ('toma 7', null, null, null, false, 'toma', '', 'lexicon'),
      ('hombre con playera azul', null, null, null, true, 'hombre|playera|azul', 'man blue t-shirt|hombre con playera azul', 'lexicon'),
      ('the last year', null, '2025-01-01 00:00:00', '2025-12-31 23:59:59', true, 'the|last|year', 'the last year', 'literal'), ('el de la', null, null, null, false, '', '', 'lexicon'),
      ('busca "no había presupuesto" toma azul', null, null, null, true, 'no había presupuesto|toma|azul', 'no habia presupuesto azul|busca "no había presupuesto" toma azul', 'lexicon')
    ) t(query, media_type, created_from, created_to, describable, literal, visual, source)""",
    "word_rules": """select * from (values ('spanish', 'luz', 'luces'), ('spanish', 'mujer', 'mujeres'), ('spanish', 'mesa', 'mesas'), ('spanish', 'lentes', null), ('english', 'city', 'cities'), ('english', 'watch', 'watches'), ('english', 'dog', 'dogs'),
      ('english', 'bus stop', 'bus stop'), ('labels', 'A photo of a duck', 'duck'), ('labels', 'duck pond scene duck', 'duck|pond'), ('nothing', ' None. ', 'true'), ('nothing', 'noon', 'false'), ('nothing', 'n/a', 'true'),
      ('captions', 'a dog', 'a dog|a photo of a dog|a video frame of a dog'), ('hash', 'El  Mar', '2519e99a43771c7df1b3e9ccdd95bb715d3fc56af498b704ccab8ea46162bde5')) t(rule, word, result)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        job_queue, job_wave, job_backfill, keyset_page, moment_previews, label_gate, quality_gates, revisions, scan_outcomes, face_identities, rerank_blend, ann_topk, parsed_dates, judged_cases, typed_queries, word_rules,
    )
}
