"""The composed search, and the confidence of its channels, as queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutlight.functions.text import basename
from cutlight.operators.text_search import TextIndex, build_index, keep_wildcards, text_rows
from cutlight.plans import planner as pl
from cutlight.plans import search as se
from cutlight.queries.catalogue import similarity_sql
from cutlight.sources import load

LEXICON = pl.Lexicon(pl.WORDS)
QUERY = "la cámara en el río de noche"


def _text(spark, d):
    """Documents and file names as text rows of the search."""
    docs = load(spark, d, "documents").where("text is not null").select(
        F.col("doc_id").alias("row_id"), "asset_id", F.lit(None).cast("bigint").alias("moment_id"), F.when(F.col("kind").isin("transcript", "ocr"), F.col("kind")).otherwise("note").alias("kind"), "text",
        (F.col("doc_id") % 600).cast("double").alias("start_seconds"), (F.col("doc_id") % 600 + 12).cast("double").alias("end_seconds"),
    )
    names = load(spark, d, "assets").groupBy("asset_id").agg(F.min("display_name").alias("text")).select(
        (-F.col("asset_id")).alias("row_id"), "asset_id", F.lit(None).cast("bigint").alias("moment_id"), F.lit("filename").alias("kind"), "text",
        F.lit(None).cast("double").alias("start_seconds"), F.lit(None).cast("double").alias("end_seconds"),
    )
    return docs.unionByName(names)


def _assets(spark, d):
    return load(spark, d, "assets").groupBy("asset_id").agg(*(F.max_by(c, "loaded_at").alias(c) for c in ("display_name", "media_type", "created_at")))


def _moments(spark, d):
    """Vectors as moments of assets, forty seconds apart."""
    return load(spark, d, "embeddings").select(
        F.col("vec_id").alias("moment_id"), (F.col("vec_id") % 97 + 1).alias("asset_id"), (F.col("vec_id") % 15 * 40).cast("double").alias("start_seconds"),
        (F.col("vec_id") % 15 * 40 + 30).cast("double").alias("end_seconds"), "embedding",
    )


_INDEXES: dict[tuple, TextIndex] = {}


def _planned(spark, d):
    plan = pl.plan_query(QUERY, LEXICON, datetime(2026, 1, 1))
    text = _text(spark, d)
    key = (spark.sparkContext.applicationId, tuple(sorted(text.inputFiles())))
    if key not in _INDEXES:
        _INDEXES[key] = build_index(text_rows(text, "row_id", "text"))
    index = _INDEXES[key]
    return plan, text, keep_wildcards(index.vocabulary, list(plan.literal)), index


def text_search(spark: SparkSession, d: str) -> DataFrame:
    """The moments that answer a typed query, by the text channels."""
    plan, text, patterns, index = _planned(spark, d)
    out = se.search(plan, text, _assets(spark, d), patterns, index=index)
    return out.select("position", "asset_id", "start_seconds", "end_seconds", F.map_keys("ranks").alias("channels"), F.round("confidence", 6).alias("confidence"))


def full_search(spark: SparkSession, d: str) -> DataFrame:
    """The same with the visual channel, and where to open each result."""
    plan, text, patterns, index = _planned(spark, d)
    m = _moments(spark, d)
    like = m.where("moment_id = 0").select("embedding").first()
    vector = F.array(*(F.lit(float(x)) for x in like[0])) if like else None
    out = se.search(plan, text, _assets(spark, d), patterns, m, vector, index=index)
    full = se.hydrate(out, load(spark, d, "assets"), load(spark, d, "locations").where("asset_id > 0"), load(spark, d, "volumes"))
    return full.select("position", "asset_id", "display_name", "availability", "is_online", F.round("confidence", 6).alias("confidence"))


def label_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of documents as labels of assets."""
    l = load(spark, d, "documents").where("asset_id > 0").select(F.concat_ws("_", "lang", "kind").alias("identifier"), "asset_id").distinct()
    hits = l.withColumn("moment_id", F.lit(None).cast("bigint")).withColumn("rank_no", F.row_number().over(Window.partitionBy("identifier").orderBy("asset_id")))
    out = se.label_candidates(hits, l, ["an ocr note", "es"], 0.05)
    return out.select("identifier", "asset_id", F.round("confidence", 6).alias("confidence"))


def person_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Where the people like a name are heard."""
    p = load(spark, d, "people").where("is_named").select("person_id", "display_name").distinct()
    links = load(spark, d, "voice_proposals").select("voice_id", "person_id").distinct()
    s = load(spark, d, "voice_segments").where("voice_id is not null and start_seconds >= 0 and end_seconds > start_seconds").select("voice_id", "asset_id", "start_seconds", "end_seconds", F.coalesce("confidence", F.lit(0.6)).alias("confidence")).distinct()
    return se.person_candidates("an", p, links.join(s, "voice_id"), 2000).select("asset_id", "seconds", "rank_no", F.round("confidence", 6).alias("confidence"))


def evidence_labels(spark: SparkSession, d: str) -> DataFrame:
    """What results say about themselves."""
    h = load(spark, d, "evaluated_hits").select("hit_id", "asset_name", "start_seconds").distinct()
    return h.select("hit_id", se.evidence_label(F.lit("visual"), basename(F.col("asset_name")), F.col("start_seconds"), 12).alias("label"))


_L = "l as (select distinct concat_ws('_', lang, kind) identifier, asset_id from documents where asset_id > 0)"
SQL = {
    "person_confidence": f"with {similarity_sql('an')}, b as (select * from si where sim >= 0.62 order by sim desc, person_id limit 2000), r as (select *, row_number() over (order by sim desc, person_id) rank_no from b),"
    " st as (select *, greatest(case when contains(f, 'an') then 1 else 0 end, case when len(ws) = 0 then 0 else len(list_filter(ws, lambda x: x = 'an')) / len(ws) end) strength from r),"
    " v as (select distinct voice_id, person_id from voice_proposals), s as (select distinct voice_id, asset_id, start_seconds, end_seconds, coalesce(confidence, 0.6) c from voice_segments"
    " where voice_id is not null and start_seconds >= 0 and end_seconds > start_seconds)"
    " select asset_id, start_seconds as \"seconds\", cast(rank_no as int) rank_no, round(least(1, strength / (1 + (rank_no - 1) / 10.0) * least(1, greatest(0, c))), 6) confidence from st join v using (person_id) join s using (voice_id)",
    "label_confidence": f"with {_L}, n as (select count(distinct asset_id) n from l), f as (select identifier, count(distinct asset_id) c from l group by 1),"
    " w as (select identifier, c, case when n <= 1 then 1 when c >= n then 0 else ln(n / c) / ln(n) end rarity, list_filter(string_split(trim(regexp_replace(lower(identifier), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') ws from f, n),"
    " s as (select *, len(list_filter(ws, lambda x: contains('an ocr note es', x))) / greatest(len(ws), 1) share from w),"
    " h as (select identifier, asset_id, row_number() over (partition by identifier order by asset_id) r from l)"
    " select identifier, asset_id, round(share / (1 + (r - 1) / 10.0) * rarity, 6) confidence from h join s using (identifier) where rarity >= 0.05 and share > 0",
    "evidence_labels": "with t as (select distinct hit_id, regexp_extract(asset_name, '[^/]*$') f, cast(case when isfinite(start_seconds) and start_seconds >= 0 then round(start_seconds) else 0 end as bigint) s from evaluated_hits)"
    " select hit_id, 'visual: ' || case when length(f) > 12 then substring(f, 1, 11) || '…' else f end || ' (' ||"
    " case when s >= 3600 then printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) else printf('%02d:%02d', s // 60, s % 60) end || ')' as label from t",
}
QUERIES = {f.__name__: f for f in (text_search, full_search, label_confidence, person_confidence, evidence_labels)}
