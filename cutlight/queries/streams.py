"""Structured Streaming queries: each reads its table as a stream of files to the end, and returns what the sink holds."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlight.queries.catalogue import SQL as BATCH_SQL
from cutlight.session import remove_folder, shared_folder
from cutlight.sources import load
from cutlight.streaming import catalogue_stream as cs


def _place(spark: SparkSession) -> str:
    """A folder for a stream's state and results, removed when the driver's Python ends."""
    at = f"{shared_folder(spark).rstrip('/')}/cutlight-stream-{uuid.uuid4().hex}"
    atexit.register(remove_folder, spark, at)
    return at


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(load(spark, d, name).schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/{name}.parquet*")  # a pattern, as the table may be one file


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a stream of events with pauses below an hour."""
    at = _place(spark)
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = cs.event_sessions(events, "user_id", "ts", "1 hour", None)  # no watermark: files come in any order of time
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{number}")
        last.append(number)

    q = sessions.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    s = spark.read.parquet(f"{at}/{last[-1]}")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each asset, kept up by a stream."""
    at = _place(spark)
    rows = _stream(spark, d, "assets").select("asset_id", "content_key", "loaded_at")
    done = []
    merge = cs.merge_batch(f"{at}/table", ["asset_id"], "loaded_at")

    def apply(batch: DataFrame, number: int) -> None:
        merge(batch, number)
        done.append(number + 1)

    cs.into_table(rows, apply, f"{at}/state").start().awaitTermination()
    t = spark.read.parquet(f"{at}/table/{done[-1]}")
    return t.select("asset_id", "content_key", F.unix_micros("loaded_at").alias("loaded_us"))


QUERIES = {"stream_sessions": stream_sessions, "stream_latest": stream_latest}
SQL = {"stream_sessions": BATCH_SQL["event_sessions"], "stream_latest": BATCH_SQL["upsert_assets"]}
