"""Incremental forms: new files, online clusters, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cutlight.session import remove_folder


def file_stream(spark: SparkSession, schema: str, folder: str, files_a_batch: int = 8) -> DataFrame:
    """Parquet files as they arrive, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def into_table(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Each batch once through a function, then stop; the checkpoint remembers what was read."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def merge_batch(state: str, keys: list[str], latest: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the latest row of each key as numbered tables below a folder.

    Table n + 1 is table n with batch n applied; a batch that is repeated after a failure
    writes the same table again. Tables before the last two are removed.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else spark.read.parquet(f"{state}/{number}").unionByName(batch)
        w = Window.partitionBy(*keys).orderBy(F.desc(latest))
        rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{state}/{number + 1}")
        if number > 1:  # the one before is needed if this batch is repeated
            remove_folder(spark, f"{state}/{number - 1}")

    return apply


def event_sessions(events: DataFrame, key: str, at: str, gap: str, late: str | None) -> DataFrame:
    """Sessions of a stream: key, start, last, n. A session ends with its last event, not a gap later.

    late: how far events may lag behind the latest of earlier batches; those that lag more
    are dropped, in complete mode too. None keeps every event, whatever the order of the files.
    """
    kept = events if late is None else events.withWatermark(at, late)
    s = kept.groupBy(key, F.session_window(at, gap).alias("w"))
    return s.agg(F.count("*").alias("n"), F.max(at).alias("last")).select(key, F.col("w.start").alias("start"), "last", "n")
