"""Work on assets as a table of jobs: queue, claims, retries, backfills.

jobs: job_id, asset_id, task, state (pending, running, done, failed), priority, attempts, last_error.
Every transition takes the table and gives the table after it, so that it is stored like any other state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIES = 3


def claimable(jobs: DataFrame, tasks: list[str]) -> DataFrame:
    """For each asset without a running job its first pending one of the given tasks, by priority, then job_id.

    Jobs that have failed TRIES times are not tried again. The head of the queue is the first row by (priority, job_id).
    """
    busy = jobs.where("state = 'running'").select("asset_id").distinct()
    open_ = jobs.where((F.col("state") == "pending") & F.col("task").isin(*tasks) & (F.col("attempts") < TRIES)).join(busy, "asset_id", "left_anti")
    w = Window.partitionBy("asset_id").orderBy("priority", "job_id")
    return open_.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").select(*jobs.columns)


def _changed(jobs: DataFrame, which: DataFrame, **columns: Column) -> DataFrame:
    """The table with columns of the jobs in `which` (job_id and what the columns need) set anew."""
    mark = which.withColumn("_hit", F.lit(True))
    joined = jobs.join(mark, "job_id", "left")
    return joined.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in columns.items()}).select(*jobs.columns)


def claim(jobs: DataFrame, claimed: DataFrame) -> DataFrame:
    """The claimed jobs are running."""
    return _changed(jobs, claimed.select("job_id"), state=F.lit("running"))


def complete(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """Finished jobs (skipped ones too) are done, without an error."""
    return _changed(jobs, finished.select("job_id"), state=F.lit("done"), last_error=F.lit(None).cast("string"))


def fail(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """Failures (job_id, error) count as an attempt; after TRIES of them the job has failed, before that it is pending again."""
    f = failures.groupBy("job_id").agg(F.max("error").alias("_error"))
    n = F.col("attempts") + 1
    return _changed(jobs, f, state=F.when(n >= TRIES, "failed").otherwise("pending"), last_error=F.substring("_error", 1, 500), attempts=n)


def requeue_stale(jobs: DataFrame) -> DataFrame:
    """What was left running is pending again."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "pending").otherwise(F.col("state")))


def enqueue(jobs: DataFrame, wanted: DataFrame, anew: bool = False) -> DataFrame:
    """Wanted (asset_id, task, priority) as pending jobs.

    A job that is there stays done or becomes pending, with its attempts; with `anew` (a backfill) it
    becomes pending whatever its state, without attempts and error, at the wanted priority. New jobs get ids after the largest, in order of task and asset_id.
    """
    key = ["asset_id", "task"]
    want = wanted.groupBy(*key).agg(F.min("priority").alias("_priority"))
    both = jobs.join(want, key, "left")
    hit = F.col("_priority").isNotNull()
    if anew:
        changes = {"state": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string"), "priority": F.col("_priority")}
    else:
        changes = {"state": F.when(F.col("state") == "done", "done").otherwise("pending")}
    kept = both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).select(*jobs.columns)
    fresh = want.join(jobs.select(*key).distinct(), key, "left_anti")
    top = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0)).alias("_top"))
    # numbered range by range of asset_id, so that no task sorts all of them
    part = F.floor(F.col("asset_id") / 10_000)
    counts = fresh.groupBy("task", part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("task", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = fresh.withColumn("_part", part).join(before, ["task", "_part"]).join(F.broadcast(top))
    number = F.col("_top") + F.col("_before") + F.row_number().over(Window.partitionBy("task", "_part").orderBy("asset_id"))
    new = placed.select(number.alias("job_id"), *key, F.lit("pending").alias("state"), F.col("_priority").alias("priority"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"))
    return kept.unionByName(new.select(*(F.col(c).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns)))


def backfill(jobs: DataFrame, versions: dict[str, str], key: str, version: str, wanted: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """T4: jobs and versions after an analysis changed: the wanted jobs anew, or nothing if this version is already recorded."""
    if versions.get(key) == version:
        return jobs, versions
    return enqueue(jobs, wanted, anew=True), versions | {key: version}


def within_daily_window(minute: Column, start: int, end: int) -> Column:
    """whether a minute of the day is in a daily window: start in it, end not; it may wrap midnight; equal ends mean always."""
    if start == end:
        return F.lit(True)
    inside = (minute >= start) & (minute < end)
    return inside if start < end else (minute >= start) | (minute < end)
