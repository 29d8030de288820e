"""Matching records by nearest time.

Each right-hand time owns the whole milliseconds that are nearer to it than to its
neighbours, bounded by the midpoints; ties belong to the earlier one. These intervals
don't overlap, so a left-hand time falls into at most one. They are cut at the
tolerance and indexed by slices of time, and the left-hand rows find theirs by an
equality join on group and slice plus a range condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of the narrowest slice.
FINEST = 60_000


def file_key(path: Column) -> Column:
    """The last path component, without regard to case."""
    return F.lower(F.element_at(F.split(path, "/"), -1))


def nearest_intervals(right: DataFrame, keys: list[str], slice_ms: int = 600_000) -> DataFrame:
    """keys, start_ms, row_id, from_ms, to_ms: the times for which a right-hand row is the nearest.

    right: keys, start_ms, row_id. Of rows with equal keys and time the smallest row_id
    stays. An open end is null. The neighbours are sought slice by slice, with the
    nearest times of the slices on either side, so that a large group is not one task.
    """
    rows = right.where("start_ms is not null").groupBy(*keys, "start_ms").agg(F.min("row_id").alias("row_id"))
    rows = rows.withColumn("slice", F.floor(F.col("start_ms") / slice_ms))
    edges = rows.groupBy(*keys, "slice").agg(F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"))
    along = Window.partitionBy(*keys).orderBy("slice")
    edges = edges.select(*keys, "slice", F.lag("hi").over(along).alias("before"), F.lead("lo").over(along).alias("after"))
    within = Window.partitionBy(*keys, "slice").orderBy("start_ms")
    near = rows.join(edges, [*keys, "slice"]).withColumns(
        {"before": F.coalesce(F.lag("start_ms").over(within), "before"), "after": F.coalesce(F.lead("start_ms").over(within), "after")}
    )
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / F.lit(2))
    return near.select(*keys, "start_ms", "row_id", (middle("before", "start_ms") + 1).alias("from_ms"), middle("start_ms", "after").alias("to_ms"))


def match_nearest(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each left-hand row with the right-hand row nearest in time: left_id, row_id, distance_ms.

    left: keys, left_id, at_ms, tolerance_ms. right: keys, start_ms, row_id. All times
    are whole milliseconds. A row without a partner within its tolerance does not come
    out; on a tie the earlier time wins, then the smaller row_id. Rows with a null key,
    time or tolerance match nothing; a negative tolerance neither. Repeated rows count
    once; either side may be empty; further columns are ignored.

    Left-hand rows are put into classes of tolerance, each with slices as wide as its
    tolerance (powers of two), so that an interval covers at most four slices whatever
    the tolerance; the number of classes is bounded by the logarithm of the range.
    """
    a = left.select(*keys, "left_id", "at_ms", "tolerance_ms").where("at_ms is not null and tolerance_ms >= 0").distinct()
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("tolerance_ms"), F.lit(FINEST)).cast("double")))).cast("bigint")
    a = a.withColumn("width", width).withColumn("slice", F.floor(F.col("at_ms") / F.col("width")))
    widths = sorted(r[0] for r in a.select("width").distinct().collect())  # one for each power of two at most
    if not widths:
        return a.select("left_id", F.lit(None).cast("bigint").alias("row_id"), F.col("at_ms").alias("distance_ms")).limit(0)
    b = nearest_intervals(right, keys)
    b = b.withColumn("width", F.explode(F.array(*(F.lit(w).cast("bigint") for w in widths))))
    b = b.withColumns(
        {
            "from_ms": F.greatest("from_ms", F.col("start_ms") - F.col("width")),
            "to_ms": F.least("to_ms", F.col("start_ms") + F.col("width")),
        }
    ).withColumn("slice", F.explode(F.sequence(F.floor(F.col("from_ms") / F.col("width")), F.floor(F.col("to_ms") / F.col("width")))))
    near = a.join(b, [*keys, "width", "slice"]).where("at_ms between from_ms and to_ms")
    near = near.withColumn("distance_ms", F.abs(F.col("at_ms") - F.col("start_ms")))
    return near.where("distance_ms <= tolerance_ms").select("left_id", "row_id", "distance_ms")
