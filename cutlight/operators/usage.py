"""Learning from use: what channels the chosen results came from."""

from __future__ import annotations

import hashlib
import hmac
import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlight.functions.text import fold_text

RECENT, KEPT, LEAST_ROWS, LEAST_OF_CHANNEL, DWELL_MS, REACH = 2000, 5000, 200, 10, 3000, 0.15


def query_hash(key: bytes, query: str) -> str:
    """A keyed hash of the folded query, so that queries can be compared but not read."""
    return hmac.new(key, fold_text(query).encode(), hashlib.sha256).hexdigest()


def newest(rows: DataFrame, row_id: str, most: int = KEPT) -> DataFrame:
    """The rows with the highest ids."""
    return rows.orderBy(F.desc(row_id)).limit(most)


def channel_preferences(interactions: DataFrame, recent: int = RECENT) -> DataFrame:
    """A10: channel, n, won, multiplier over the most recent interactions.

    interactions: id, action (open, seek, pin, reformulate), dwell_milliseconds, channels
    (joined by commas). An open or pin wins, a seek if it lasted; a channel's rate is
    smoothed toward the overall one, and its multiplier stays within REACH of 1. Too few
    rows, or all or none won, give nothing.
    """
    rows = newest(interactions, "id", recent)
    won = F.when(F.col("action").isin("open", "pin"), 1).when((F.col("action") == "seek") & (F.coalesce("dwell_milliseconds", F.lit(0)) >= DWELL_MS), 1).otherwise(0)
    rows = rows.select("id", won.alias("won"), F.array_distinct(F.filter(F.transform(F.split("channels", ","), lambda c: F.trim(c)), lambda c: c != "")).alias("channels"))
    total = rows.agg(F.count("*").alias("all_n"), F.coalesce(F.sum("won"), F.lit(0)).alias("all_won"))
    per = rows.select("won", F.explode("channels").alias("channel")).groupBy("channel").agg(F.count("*").alias("n"), F.sum("won").alias("won"))
    average = (F.col("all_won") + 10) / (F.col("all_n") + 20)
    rate = (F.col("won") + 20 * average) / (F.col("n") + 20)
    multiplier = F.when(F.col("n") < LEAST_OF_CHANNEL, 1.0).otherwise(F.least(F.lit(1 + REACH), F.greatest(F.lit(1 - REACH), rate / average)))
    both = per.join(F.broadcast(total)).where(f"all_n >= {LEAST_ROWS} and all_won > 0 and all_won < all_n")
    return both.select("channel", "n", "won", multiplier.alias("multiplier"))


#: The channels that are learned from.
CHANNELS = ("label", "metadata", "ocr", "person", "transcript", "visual")
INTERACTION = "id bigint, query_hash string, asset_id bigint, moment_id bigint, action string, rank int, dwell_milliseconds int, channels string"


@dataclass(frozen=True)
class UsageState:
    """Whether use is recorded, the key of the query hashes, and a number that changes with either."""

    enabled: bool = False
    key: bytes = field(default_factory=lambda: os.urandom(32))
    revision: int = 0

    def switched(self, on: bool) -> UsageState:
        return replace(self, enabled=on, revision=self.revision + 1)


def record(state: UsageState, rows: DataFrame, action: str, query: str, asset_id: int | None = None, moment_id: int | None = None, rank: int | None = None, dwell: int | None = None, channels: tuple[str, ...] = ()) -> DataFrame:
    """The interactions (INTERACTION) with one more, the newest KEPT of them.

    Nothing is recorded while it is switched off, for a blank query, or without a known channel.
    """
    known = sorted(set(channels) & set(CHANNELS))
    if not state.enabled or not query.strip() or not known:
        return rows
    row = rows.sparkSession.createDataFrame([(None, query_hash(state.key, query), asset_id, moment_id, action, rank, None if dwell is None else max(0, dwell), ",".join(known))], INTERACTION)
    last = rows.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("_id"))
    numbered = row.join(F.broadcast(last)).withColumn("id", F.col("_id")).select(*rows.columns)
    return newest(rows.unionByName(numbered), "id")


def report(state: UsageState, rows: DataFrame) -> dict:
    """What is known: whether it is recorded, how many interactions, and the preferences of channels (one row each)."""
    return {"enabled": state.enabled, "interactions": rows.count(), "minimum_samples": LEAST_ROWS, "channels": [r.asDict() for r in channel_preferences(rows).orderBy("channel").collect()]}


def forget(state: UsageState, rows: DataFrame) -> tuple[UsageState, DataFrame]:
    """No interactions, and another key, so that hashes of before can't be matched."""
    return replace(state, key=os.urandom(32), revision=state.revision + 1), rows.limit(0)
