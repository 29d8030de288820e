"""Query p6: judgements with the nearest hit and the nearest voice segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlight.llm.nearest_time import file_key, match_nearest
from cutlight.operators.intervals import milliseconds, timed
from cutlight.sources import read_table


def _finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d)
    judged = (
        t("relevant_moments").where(_finite("at_seconds"))
        .select(
            "case_id", file_key(F.col("asset")).alias("file"), F.col("judgement_id").alias("left_id"), milliseconds(F.col("at_seconds")).alias("at_ms"),
            milliseconds(F.coalesce(F.nanvl("tolerance_seconds", F.lit(30.0)), F.lit(30.0))).alias("tolerance_ms"),
        )
        .distinct()
    )
    hits = t("evaluated_hits").where(_finite("start_seconds")).select(
        "case_id", file_key(F.col("asset_name")).alias("file"), milliseconds(F.col("start_seconds")).alias("start_ms"), F.col("hit_id").alias("row_id")
    )
    named = t("assets").select("asset_id", file_key(F.col("display_name")).alias("file")).distinct()
    segments = t("voice_segments").where(timed(F.col("start_seconds"), F.col("end_seconds"))).select(
        "asset_id", milliseconds(F.col("start_seconds")).alias("start_ms"), F.col("segment_id").alias("row_id")
    )
    by_hit = match_nearest(judged, hits, ["case_id", "file"])
    by_segment = match_nearest(judged.join(named, "file"), segments, ["asset_id"])
    return by_hit.withColumn("matched_table", F.lit("evaluated_hits")).unionByName(by_segment.withColumn("matched_table", F.lit("voice_segments")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("matched_table", F.col("left_id").alias("judgement_id"), "row_id")


def p6_distances(spark: SparkSession, d: str) -> DataFrame:
    """Per table: matches and their distances in ms."""
    return _matches(spark, d).groupBy("matched_table").agg(
        F.count("*").alias("n"), F.sum("distance_ms").alias("total_ms"), F.max("distance_ms").alias("longest_ms")
    )


_SQL = """
with j as (
  select distinct judgement_id, case_id, lower(regexp_extract(asset, '[^/]*$')) f, cast(round(at_seconds * 1000) as bigint) at_ms,
    cast(round(coalesce(tolerance_seconds, 30) * 1000) as bigint) tol
  from relevant_moments where isfinite(at_seconds)
), cand as (
  select 'evaluated_hits' matched_table, j.judgement_id, h.row_id, abs(h.s - j.at_ms) dist, h.s, j.tol
  from j join (select distinct case_id, lower(regexp_extract(asset_name, '[^/]*$')) f, hit_id row_id, cast(round(start_seconds * 1000) as bigint) s
    from evaluated_hits where isfinite(start_seconds)) h using (case_id, f)
  union all
  select 'voice_segments', j.judgement_id, v.row_id, abs(v.s - j.at_ms), v.s, j.tol
  from j join (select distinct asset_id, lower(regexp_extract(display_name, '[^/]*$')) f from assets) a using (f)
  join (select distinct asset_id, segment_id row_id, cast(round(start_seconds * 1000) as bigint) s from voice_segments
    where isfinite(start_seconds) and isfinite(end_seconds) and start_seconds >= 0 and end_seconds > start_seconds) v using (asset_id)
), best as (
  select *, row_number() over (partition by matched_table, judgement_id order by dist, s, row_id) rn from cand where dist <= tol
)
"""

QUERIES = {"p6_found": p6_found, "p6_distances": p6_distances}
SQL = {
    "p6_found": _SQL + "select matched_table, judgement_id, row_id from best where rn = 1",
    "p6_distances": _SQL + "select matched_table, count(*) n, cast(sum(dist) as bigint) total_ms, max(dist) longest_ms from best where rn = 1 group by 1",
}
