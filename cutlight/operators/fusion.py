"""Fusing the candidates of several channels in time, and ranking them.

Candidates: asset_id, moment_id, seconds, end_seconds, channel, rank_no, confidence.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight in rank fusion and trust in noisy-or, by channel.
WEIGHTS = {"visual": 0.45, "transcript": 0.35, "ocr": 0.12, "label": 0.2, "person": 0.5, "metadata": 0.08}
TRUSTS = {"visual": 1.0, "transcript": 0.95, "ocr": 0.95, "label": 0.85, "person": 0.98, "metadata": 0.7}
#: At equal seconds candidates are taken in this order.
TIE_ORDER = ("person", "label", "transcript", "ocr", "visual")
RRF_K = 60.0

FUSED = (
    "asset_id bigint, moment_id bigint, start_seconds double, end_seconds double, "
    "ranks map<string,int>, confidences map<string,double>"
)


def fuse_one(rows: list[tuple], window: float) -> list[dict]:
    """The buckets of one asset: rows (seconds, end_seconds, channel, rank_no, confidence, moment_id) in order.

    A row joins the first bucket that lacks its channel and starts within the window of
    it, else it opens a bucket of its own.
    """
    buckets: list[dict] = []
    for seconds, end, channel, rank, confidence, moment in rows:
        b = next((b for b in buckets if channel not in b["ranks"] and abs(b["start"] - seconds) <= window), None)
        if b is None:
            b = {"start": seconds, "end": end, "moment": None, "ranks": {}, "confidences": {}}
            buckets.append(b)
        b["start"], b["end"] = min(b["start"], seconds), max(b["end"], end)
        b["ranks"][channel], b["confidences"][channel] = rank, confidence
        if b["moment"] is None:
            b["moment"] = moment
    return buckets


def fuse(candidates: DataFrame, window: float = 30.0) -> DataFrame:
    """Fused candidates (FUSED). One group per asset; its size is bounded by the depth of the channels.

    A metadata candidate has no time: the best of an asset is copied to each of its
    buckets, or makes one of its own at 0 if the asset has nothing else.
    """

    order = F.array_position(F.array(*map(F.lit, TIE_ORDER)), F.col("channel"))
    tie = F.when(order == 0, len(TIE_ORDER) + 1).otherwise(order)
    row = F.struct("seconds", tie.alias("tie"), "rank_no", "moment_id", "end_seconds", "channel", F.col("confidence").cast("double").alias("confidence"))
    groups = candidates.groupBy("asset_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def fold(batches):
        for b in batches:
            out = []
            for asset, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                timed = [(r["seconds"], r["end_seconds"], r["channel"], r["rank_no"], r["confidence"], r["moment_id"]) for r in rows if r["channel"] != "metadata"]
                buckets = fuse_one(timed, window)
                meta = min((r for r in rows if r["channel"] == "metadata"), key=lambda r: r["rank_no"], default=None)
                if meta is not None:
                    buckets = buckets or [{"start": 0.0, "end": 0.0, "moment": None, "ranks": {}, "confidences": {}}]
                    for x in buckets:
                        x["ranks"]["metadata"], x["confidences"]["metadata"] = meta["rank_no"], meta["confidence"]
                out += [(asset, x["moment"], x["start"], x["end"], list(x["ranks"].items()), list(x["confidences"].items())) for x in buckets]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.int32()), pa.map_(pa.string(), pa.float64()))
            names = ("asset_id", "moment_id", "start_seconds", "end_seconds", "ranks", "confidences")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return groups.mapInArrow(fold, FUSED)


def _by_channel(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def rank_fusion(ranks: Column, weights: dict[str, float] = WEIGHTS, k: float = RRF_K) -> Column:
    """The sum of weight / (k + rank); channels in a fixed order, so that sums don't vary."""
    parts = (F.coalesce(F.lit(w) / (F.lit(k) + F.try_element_at(ranks, F.lit(c))), F.lit(0.0)) for c, w in weights.items())
    return sum(parts, F.lit(0.0))


def noisy_or(confidences: Column, trusts: dict[str, float] = TRUSTS) -> Column:
    """1 - product of (1 - trust * confidence)."""
    miss = F.lit(1.0)
    for c, t in trusts.items():
        x = F.coalesce(F.try_element_at(confidences, F.lit(c)), F.lit(0.0))
        miss = miss * (1 - F.lit(t) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    return 1 - miss


def ordering(fused: DataFrame, mode: str = "confidence") -> DataFrame:
    """With confidence and score; mode rank_fusion, confidence or blend."""
    both = fused.withColumns({"confidence": noisy_or(F.col("confidences")), "rrf": rank_fusion(F.col("ranks"))})
    score = {"rank_fusion": F.col("rrf"), "confidence": F.col("confidence"), "blend": F.col("rrf") * (0.25 + 0.75 * F.col("confidence"))}[mode]
    return both.withColumn("score", score).drop("rrf")


def trim(ranked: DataFrame, limit: int, least: float = 0.0, per_asset: int = 3) -> DataFrame:
    """Confidence of at least `least`, the first 3 * limit, then at most per_asset of an asset, then limit.

    The cap comes after the first cut: before it, other rows would result.
    """
    total = [F.desc("score"), F.desc("confidence"), "asset_id", "start_seconds", F.coalesce("moment_id", F.lit(-1))]
    first = ranked.where(F.col("confidence") >= least).orderBy(*total).limit(3 * max(0, limit))
    capped = first.withColumn("n", F.row_number().over(Window.partitionBy("asset_id").orderBy(*total))).where(F.col("n") <= per_asset)
    return capped.drop("n").orderBy(*total).limit(max(0, limit)).withColumn("position", F.row_number().over(Window.orderBy(*total)))


def learned_order(trimmed: DataFrame, multipliers: DataFrame) -> DataFrame:
    """A10 applied: the trimmed rows in order of score times the mean multiplier of their channels.

    multipliers: channel, multiplier. Neither the members nor their confidence change.
    """
    per = trimmed.select("asset_id", "position", F.explode(F.map_keys("ranks")).alias("channel")).join(F.broadcast(multipliers), "channel", "left")
    mean = per.groupBy("position").agg(F.avg(F.coalesce("multiplier", F.lit(1.0))).alias("m"))
    moved = trimmed.join(mean, "position", "left").withColumn("learned", F.col("score") * F.coalesce("m", F.lit(1.0))).drop("m")
    return moved.withColumn("position", F.row_number().over(Window.orderBy(F.desc("learned"), "position"))).drop("learned")


def eligible(candidates: DataFrame, assets: DataFrame, media_type: str | None = None, created: tuple | None = None) -> DataFrame:
    """candidates of assets of a media type and, with a range (both ends in), a known creation time in it."""
    kept = assets
    if media_type:
        kept = kept.where(F.col("media_type") == media_type)
    if created:
        kept = kept.where(F.col("created_at").between(F.lit(created[0]), F.lit(created[1])))
    return candidates.join(kept.select("asset_id").distinct(), "asset_id", "left_semi")


def best_location(locations: DataFrame) -> DataFrame:
    """asset_id, location_id of the best location: online, offline, moved, missing; then the smaller id."""
    place = F.array_position(F.array(*map(F.lit, ("online", "offline", "moved", "missing"))), F.col("availability"))
    place = F.when(place == 0, 9).otherwise(place)
    return locations.where("asset_id is not null").groupBy("asset_id").agg(
        F.min_by("location_id", F.struct(place, "location_id")).alias("location_id"), F.min_by("availability", F.struct(place, "location_id")).alias("availability")
    )
