"""Joins and folds over media time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """X34."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_join(left: DataFrame, right: DataFrame, key: str, slice_seconds: float = 120.0) -> DataFrame:
    """Pairs of rows of one key whose intervals overlap: key, left_id, right_id, seconds.

    left: key, left_id, start_a, end_a. right: key, right_id, start_b, end_b. Both sides are
    spread over slices of time, so that a key with very many rows is many small joins; a
    pair is taken in the slice in which its overlap starts. Rows that end before they start meet nothing.
    """
    first, last = (lambda c: F.floor(F.col(c) / slice_seconds)), (lambda c: F.floor(F.col(c) / slice_seconds))
    a = left.where("end_a >= start_a").withColumn("slice", F.explode(F.sequence(first("start_a"), last("end_a"))))
    b = right.where("end_b >= start_b").withColumn("slice", F.explode(F.sequence(first("start_b"), last("end_b"))))
    both = a.join(b, [key, "slice"]).where("start_a < end_b and end_a > start_b")
    both = both.where(F.col("slice") == F.floor(F.greatest("start_a", "start_b") / slice_seconds))
    return both.select(key, "left_id", "right_id", overlap_seconds(*map(F.col, ("start_a", "end_a", "start_b", "end_b"))).alias("seconds"))


def overlap_totals(pairs: DataFrame, left_group: str, right_group: str, least: float) -> DataFrame:
    """The seconds that two groups share, if at least `least`."""
    return pairs.groupBy(left_group, right_group).agg(F.sum("seconds").alias("seconds")).where(F.col("seconds") >= least)


def nearest_row(requests: DataFrame, rows: DataFrame, key: str, window: float | None = None, slice_seconds: float = 600.0) -> DataFrame:
    """For each request the row of its key nearest in time: request_id, row_id, distance.

    requests: key, request_id, at. rows: key, row_id, start, optionally `end`. Ties go
    to the earlier start, then the smaller row_id. With a window, rows must touch
    [at - window, at + window].

    Without a window, requests and rows are merged in order of time, slice by slice: the last row
    at or before a request and the first one after it are all that can be nearest, and the slices
    hand on their outermost rows. With one, rows meet the requests of the slices that they touch.
    """
    if window is not None:
        end = F.greatest("start", "end") if "end" in rows.columns else F.col("start")
        wide = max(float(window), 1.0)
        at_slice = lambda c: F.floor(c / wide)
        spread = rows.select(key, "row_id", "start", end.alias("_end")).withColumn("slice", F.explode(F.sequence(at_slice(F.col("start") - window), at_slice(F.col("_end") + window))))
        both = requests.select(key, "request_id", "at").withColumn("slice", at_slice(F.col("at"))).join(spread, [key, "slice"])
        both = both.where((F.col("_end") >= F.col("at") - window) & (F.col("start") <= F.col("at") + window))
        near = both.groupBy("request_id").agg(F.min(F.struct(F.abs(F.col("start") - F.col("at")).alias("distance"), "start", "row_id")).alias("b"))
        return near.select("request_id", "b.row_id", "b.distance")
    place = F.struct(F.col("at").alias("start"), "row_id")
    points = rows.where("start is not null").groupBy(key, F.col("start").alias("at")).agg(F.min("row_id").alias("row_id")).withColumns({"request_id": F.lit(None), "p": place})
    asked = requests.select(key, "at", F.lit(None).alias("row_id"), "request_id", F.lit(None).alias("p")).where("at is not null")
    line = points.unionByName(asked).withColumn("slice", F.floor(F.col("at") / slice_seconds))
    up = Window.partitionBy(key, "slice").orderBy("at", F.col("p").isNull())
    down = Window.partitionBy(key, "slice").orderBy(F.desc("at"), F.col("p").isNull())
    told = line.withColumns({"before": F.last("p", True).over(up), "after": F.last("p", True).over(down)}).where("request_id is not null")
    ends = line.groupBy(key, "slice").agg(F.max("p").alias("hi"), F.min("p").alias("lo"))
    earlier, later = Window.partitionBy(key).orderBy("slice"), Window.partitionBy(key).orderBy(F.desc("slice"))
    beyond = lambda c, w: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(key, "slice", beyond("hi", earlier).alias("hi"), beyond("lo", later).alias("lo"))
    both = told.join(ends, [key, "slice"]).select("request_id", "at", F.array(F.coalesce("before", "hi"), F.coalesce("after", "lo")).alias("c"))
    best = F.array_min(F.transform(F.filter("c", lambda x: x.isNotNull()), lambda x: F.struct(F.abs(x["start"] - F.col("at")).alias("distance"), x["start"].alias("start"), x["row_id"].alias("row_id"))))
    return both.withColumn("b", best).where("b is not null").select("request_id", "b.row_id", "b.distance")


def exact_or_nearest(requests: DataFrame, exact: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A request's own row if it has one (exact: request_id, exact_id), else the nearest."""
    near = nearest_row(requests, rows, key)
    return requests.select("request_id").join(exact, "request_id", "left").join(near, "request_id", "left").select(
        "request_id", F.coalesce("exact_id", "row_id").alias("row_id"), F.col("exact_id").isNotNull().alias("is_exact")
    )


def islands(rows: DataFrame, keys: list[str], gap: float, least_span: float = 0.5, quality: str | None = None, unknown: float = 0.5) -> DataFrame:
    """Keys, start_seconds, end_seconds, n, confidence of the runs of each key.

    rows: keys, start, end. A run ends where the next start is more than `gap` after
    the latest end so far. Runs are made at least least_span long; confidence is the mean of
    the quality column, `unknown` where it is null.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    q = F.coalesce(F.col(quality), F.lit(unknown)) if quality else F.lit(unknown)
    marked = rows.select(*keys, "start", "end", q.alias("q")).withColumn("new", F.when(before.isNull() | (F.col("start") - before > gap), 1).otherwise(0))
    numbered = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*keys, "run").agg(F.min("start").alias("start_seconds"), F.max("end").alias("last"), F.count("*").alias("n"), F.avg("q").alias("confidence"))
    return runs.select(*keys, "start_seconds", F.greatest("last", F.col("start_seconds") + least_span).alias("end_seconds"), "n", "confidence")


def close_moments(frames: DataFrame, key: str, at: str, duration: str) -> DataFrame:
    """Each frame lasts until the next of its file, the last until the file's end; never ends before its start."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    return frames.withColumn("end_seconds", F.greatest(F.coalesce(following, F.col(duration)), F.col(at)))


def sampling_grid(files: DataFrame, duration: str, step: float = 5.0, most: int = 4000) -> DataFrame:
    """One row per file and sampled time t = 0, step, ... below the duration; the step grows so that there are at most `most`."""
    width = F.greatest(F.lit(step), F.col(duration) / most)
    n = F.ceil(F.col(duration) / width).cast("int")
    return files.where(F.col(duration) > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)))).withColumn("at_seconds", F.col("i") * width).drop("i")


def changed_frames(frames: DataFrame, key: str, at: str, hash_: str, least: int = 12) -> DataFrame:
    """The frames whose 64-bit hash differs in `least` bits or more from the last frame *kept* of their file.

    A fold in order of time: one file at a time, with all its columns.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        kept, last = [], None
        for h in pdf[hash_].tolist():
            new = last is None or ((int(h) ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() >= least
            kept.append(new)
            if new:
                last = int(h)
        return pdf[kept]

    return frames.where(F.col(hash_).isNotNull() & F.col(at).isNotNull()).groupBy(key).applyInPandas(keep, frames.schema)


def chunk_transcript(words: DataFrame, least: float = 12.0) -> DataFrame:
    """Words (asset_id, start, end, text, confidence) gathered into chunks of at least `least` seconds.

    asset_id, start_seconds, end_seconds, text, confidence (mean of the known ones).
    """
    schema = "asset_id bigint, start_seconds double, end_seconds double, text string, confidence double"

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], []
        for r in pdf.sort_values(["start", "end"], kind="stable").itertuples(index=False):
            held.append(r)
            if r.end - held[0].start >= least:
                out.append(held)
                held = []
        if held:
            out.append(held)
        rows = []
        for h in out:
            known = [x.confidence for x in h if x.confidence == x.confidence and x.confidence is not None]
            rows.append((h[0].asset_id, h[0].start, max(x.end for x in h), " ".join(x.text.strip() for x in h), sum(known) / len(known) if known else None))
        return pd.DataFrame(rows, columns=["asset_id", "start_seconds", "end_seconds", "text", "confidence"])

    return words.where("text is not null and start is not null and end is not null").groupBy("asset_id").applyInPandas(gather, schema)


def evict_oldest(rows: DataFrame, size: str, used_at: str, row_id: str, budget: float, pinned: str | None = None) -> DataFrame:
    """The rows to evict, oldest first, until the sizes fit the budget; pinned rows stay.

    A running sum needs one order of all rows: sums are taken per day of use first, and
    only the running sum within a day is a window.
    """
    free = rows.where(~F.col(pinned)) if pinned else rows
    total = rows.agg(F.sum(size).alias("total"))
    day = F.to_date(used_at)
    days = free.groupBy(day.alias("day")).agg(F.sum(size).alias("of_day"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("day", F.coalesce(F.sum("of_day").over(w), F.lit(0)).alias("before_day"))
    within = Window.partitionBy("day").orderBy(used_at, row_id).rowsBetween(Window.unboundedPreceding, -1)
    placed = free.withColumn("day", day).join(before, "day").withColumn("gone", F.col("before_day") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    return placed.join(F.broadcast(total)).where(F.col("total") - F.col("gone") > budget).drop("day", "before_day", "gone", "total")
