"""Queries p2 and p5: references without a record, and periods of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlight.operators.intervals import continuous_periods, gaps_between, speech_intervals
from cutlight.operators.references import catalogue_parents, catalogue_references, missing_references
from cutlight.sources import read_table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d)
    loads, removals = catalogue_parents(t("assets"), t("volumes"), t("incoming_assets"), t("removed_keys"))
    return missing_references(catalogue_references(t("locations"), t("wf_asset_map")), loads, removals)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("child_table", "child_column", "row_id", "period_month")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table, column, month and status: the number of such references."""
    return _orphans(spark, d).groupBy("child_table", "child_column", "period_month", "status").agg(F.count("*").alias("n"))


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return continuous_periods(speech_intervals(read_table(spark, d)("voice_segments")), ["asset_id", "speaker"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return gaps_between(_periods(spark, d), ["asset_id", "speaker"])


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    """The continuous periods themselves, with the number of distinct intervals in each."""
    return _periods(spark, d)


_P2 = """
with ev as (
  select 'assets' pt, cast(asset_id as varchar) k, loaded_at ts, 1 s from assets
  union select 'volumes', lower(trim(volume_uuid, ' {}')), loaded_at, 1 from volumes
  union select 'incoming_assets', snapshot_id || '/' || asset_id, loaded_at, 1 from incoming_assets
  union select parent_table, case when parent_table = 'volumes' then lower(trim(parent_key, ' {}')) else parent_key end, removed_at, 0 from removed_keys
), loc as (
  select location_id, arg_min(asset_id, loaded_at) asset_id, arg_min(volume_uuid, loaded_at) volume_uuid, min(loaded_at) ts from
  (select location_id, loaded_at, coalesce(asset_id, 0) asset_id, coalesce(volume_uuid, '') volume_uuid from locations) group by location_id
), mp as (
  select map_id, arg_min(snapshot_id, loaded_at) snapshot_id, arg_min(coalesce(old_id, 0), loaded_at) old_id, min(loaded_at) ts from wf_asset_map group by map_id
), refs as (
  select 'locations' child_table, 'asset_id' child_column, location_id row_id, 'assets' pt, cast(asset_id as varchar) k, ts from loc where asset_id > 0
  union all select 'locations', 'volume_uuid', location_id, 'volumes', lower(trim(volume_uuid, ' {}')), ts from loc where volume_uuid <> ''
  union all select 'wf_asset_map', 'old_id', map_id, 'incoming_assets', snapshot_id || '/' || old_id, ts from mp where old_id > 0
), fin as (select pt, k, arg_max(s, ts) final, max(s) ever from ev group by 1, 2),
st as (
  select r.*, coalesce((select arg_max(e.s, e.ts) from ev e where e.pt = r.pt and e.k = r.k and e.ts <= r.ts), 0) state from refs r
), found as (
  select child_table, child_column, row_id, strftime(ts at time zone 'UTC', '%Y-%m') period_month,
    case when coalesce(ever, 0) = 0 then 'missing' when final = 1 then 'late' when state = 1 then 'deleted' else 'deleted_before' end status
  from st left join fin using (pt, k) where state = 0 or coalesce(final, 0) = 0
)
"""

_P5 = """
with seg as (
  select distinct asset_id, lower(trim(speaker)) speaker, cast(round(start_seconds * 1000) as bigint) s, cast(round(end_seconds * 1000) as bigint) e
  from voice_segments
  where isfinite(start_seconds) and isfinite(end_seconds) and start_seconds >= 0 and end_seconds > start_seconds and trim(speaker) <> ''
), m as (
  select *, max(e) over (partition by asset_id, speaker order by s, e rows between unbounded preceding and 1 preceding) pe from seg
), g as (
  select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by asset_id, speaker order by s, e rows unbounded preceding) island from m
), p as (select asset_id, speaker, island, min(s) start_ms, max(e) end_ms, count(*) n from g group by 1, 2, 3)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found, "p5_periods": p5_periods}

SQL = {
    "p2_found": _P2 + "select child_table, child_column, row_id, period_month from found",
    "p2_report": _P2 + "select child_table, child_column, period_month, status, count(*) n from found group by all",
    "p5_found": _P5
    + """select asset_id, speaker, gap_start_ms, gap_end_ms from (
      select asset_id, speaker, end_ms gap_start_ms, lead(start_ms) over (partition by asset_id, speaker order by start_ms) gap_end_ms from p
    ) where gap_end_ms is not null""",
    "p5_periods": _P5 + "select asset_id, speaker, start_ms, end_ms, cast(n as bigint) n from p",
}
