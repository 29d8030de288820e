"""Overlapping and gapped time intervals.

Union of intervals does not depend on the order in which they are merged, so it is
done in slices: ``session_window`` merges within slices of time, which spreads a
speaker who holds a large part of all rows over many tasks. What then still
overlaps the next slices is stitched by the slices' ends alone: one row for each slice of
a key says how far the periods before it reach, and only the first periods of a slice
can be reached. Times are doubled and one is added to each length, so that intervals
which touch always overlap, those a millisecond apart never do, and none is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds at which times are clipped, some 140,000 years: twice that in microseconds is what a timestamp holds.
LATEST_MS = 4_500_000_000_000_000


def timed(start: Column, end: Column) -> Column:
    """Whether an interval is finite, does not start before 0 and ends after its start."""
    return F.coalesce((start >= 0) & (end > start) & ~F.isnan(start) & ~F.isnan(end) & (end < float("inf")), F.lit(False))


def milliseconds(seconds: Column) -> Column:
    """Whole milliseconds, clipped at LATEST_MS either way."""
    return F.greatest(F.lit(-float(LATEST_MS)), F.least(F.lit(float(LATEST_MS)), F.round(seconds * 1000))).cast("bigint")


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions over start_ms and end_ms by keys, each with the number of rows in it."""
    length = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((2 * (end_ms - start_ms) + 1) as decimal(24, 0)) / 1000000)")
    return (
        df.groupBy(*keys, F.session_window(F.timestamp_micros(2 * F.col("start_ms")), length).alias("w"))
        .agg(F.sum("n").alias("n"))
        .select(*keys, F.expr("unix_micros(w.start) div 2").alias("start_ms"), F.expr("(unix_micros(w.end) - 1) div 2").alias("end_ms"), "n")
    )


def continuous_periods(df: DataFrame, keys: list[str], slice_ms: int = 600_000) -> DataFrame:
    """The continuous periods of each key: keys, start_ms, end_ms, n (distinct intervals).

    df: keys, start_ms, end_ms (bigint, start_ms <= end_ms). Intervals that overlap or
    touch form one period. Equal intervals of a key count once. Rows with a null bound
    or with the end before the start are left out; null keys form a key of their own.
    An empty table gives an empty result; further columns are ignored.

    Within slices by session_window; then a period that reaches beyond its slice takes in
    the slices' periods that it reaches. Windows are over the slices of a key, one row each, and over the periods of one slice.
    """
    rows = df.select(*keys, "start_ms", "end_ms").where("start_ms <= end_ms").distinct()
    rows = rows.withColumns({"slice": F.expr(f"start_ms div {slice_ms}"), "n": F.lit(1).cast("bigint")})
    part = _merge(rows, [*keys, "slice"])
    # how far the earlier slices reach into each slice
    slices = part.groupBy(*keys, "slice").agg(F.max("end_ms").alias("reach"), F.min("start_ms").alias("first"))
    along = Window.partitionBy(*keys).orderBy("slice")
    before = F.max("reach").over(along.rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("slice").alias("_slice"), before.alias("reached"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "slice")]
    met = part.join(slices, same).select(*keys, "slice", "start_ms", "end_ms", "n", (F.col("start_ms") > F.coalesce("reached", F.col("start_ms") - 1)).alias("opens"))
    # a period that nothing before it reaches opens a run; the others of its slice and of later ones belong to the last that opened
    within = Window.partitionBy(*keys, "slice").orderBy("start_ms").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("run", F.max(F.when(F.col("opens"), F.col("start_ms"))).over(within))
    last = met.groupBy(*keys, "slice").agg(F.max("run").alias("run"))
    carried = F.last("run", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    last = last.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("slice").alias("_slice"), carried.alias("carried"))
    runs = met.join(last, same).withColumn("run", F.coalesce("run", "carried"))
    return runs.groupBy(*keys, "run").agg(F.max("end_ms").alias("end_ms"), F.sum("n").alias("n")).select(*keys, F.col("run").alias("start_ms"), "end_ms", "n")


def gaps_between(periods: DataFrame, keys: list[str], slice_ms: int = 600_000) -> DataFrame:
    """The gaps between neighbouring periods: keys, gap_start_ms, gap_end_ms.

    periods are disjoint, as continuous_periods returns them. The next period is sought within
    a slice of time, and for the last of a slice among the first ones of the slices.
    """
    sliced = periods.select(*keys, "start_ms", "end_ms", F.expr(f"start_ms div {slice_ms}").alias("slice"))
    within = Window.partitionBy(*keys, "slice").orderBy("start_ms")
    placed = sliced.withColumn("next", F.lead("start_ms").over(within))
    slices = sliced.groupBy(*keys, "slice").agg(F.min("start_ms").alias("first"))
    following = F.lead("first").over(Window.partitionBy(*keys).orderBy("slice"))
    slices = slices.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("slice").alias("_slice"), following.alias("later"))
    both = placed.join(slices, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "slice")])
    return both.select(*keys, F.col("end_ms").alias("gap_start_ms"), F.coalesce("next", "later").alias("gap_end_ms")).where("gap_end_ms > gap_start_ms")


def speech_intervals(segments: DataFrame) -> DataFrame:
    """Timed voice segments as asset_id, speaker, start_ms, end_ms.

    The speaker is trimmed and in lower case; null and blank ones are left out.
    """
    speaker = F.lower(F.regexp_replace("speaker", r"^\s+|\s+$", ""))
    return (
        segments.where(timed(F.col("start_seconds"), F.col("end_seconds")))
        .select("asset_id", speaker.alias("speaker"), milliseconds(F.col("start_seconds")).alias("start_ms"), milliseconds(F.col("end_seconds")).alias("end_ms"))
        .where("speaker <> ''")
    )
