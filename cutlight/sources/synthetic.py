"""Synthetic catalogues for scale tests (S26): seeded, made in parallel, the same whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(*parts):
    """A number in [0, 1) that depends on its arguments alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def assets(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    u = lambda k: _uniform(F.col("id"), F.lit(seed), F.lit(k))
    return spark.range(1, n + 1).select(
        F.col("id").alias("asset_id"), F.concat(F.lit("q1:"), F.sha2(F.concat_ws("-", F.lit(seed), "id"), 256)).alias("content_key"),
        F.when(u(1) < 0.6, "video").when(u(1) < 0.85, "image").otherwise("audio").alias("media_type"),
        F.round(10 + 3590 * u(2), 3).alias("duration_seconds"), F.format_string("CLIP_%07d.mov", "id").alias("display_name"),
    )


def vectors(spark: SparkSession, n: int, dimensions: int, similarity: float, seed: int = 1, scenes: int = 16) -> DataFrame:
    """vec_id, scene, embedding: unit vectors whose cosine to the unit centre of their scene is exactly `similarity`."""

    def normal(*parts):
        return F.sqrt(-2 * F.log(1 - _uniform(*parts, F.lit("a")))) * F.cos(6.283185307179586 * _uniform(*parts, F.lit("b")))

    from cutlight.functions.vectors import dot, normalise

    at = F.sequence(F.lit(1), F.lit(dimensions))
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.pmod("id", F.lit(scenes)).alias("scene"))
    rows = rows.withColumn("c", normalise(F.transform(at, lambda k: normal(F.col("scene"), F.lit(seed), k))))
    rows = rows.withColumn("r", F.transform(at, lambda k: normal(F.col("vec_id"), F.lit(seed + 1), k)))
    rows = rows.withColumn("along", dot(F.col("r"), F.col("c")))
    rows = rows.withColumn("o", normalise(F.zip_with("r", "c", lambda x, y: x - F.col("along") * y)))
    side = (1 - similarity * similarity) ** 0.5
    return rows.select("vec_id", "scene", F.zip_with("c", "o", lambda x, y: (similarity * x + side * y).cast("float")).alias("embedding"))


def moments(spark: SparkSession, assets_n: int, each: int, seed: int = 1) -> DataFrame:
    """moment_id, asset_id, start_seconds, end_seconds, preview (a path), `each` for each asset."""
    rows = spark.range(assets_n * each).select((F.col("id") + 1).alias("moment_id"), (F.floor(F.col("id") / each) + 1).alias("asset_id"), F.pmod("id", F.lit(each)).alias("k"))
    start = F.round(F.col("k") * 12 + 4 * _uniform(F.col("moment_id"), F.lit(seed)), 3)
    return rows.select("moment_id", "asset_id", start.alias("start_seconds"), (start + 8).alias("end_seconds"), F.format_string("previews/%03d/%d.jpg", F.pmod("moment_id", F.lit(997)), "moment_id").alias("preview"))


def texts(spark: SparkSession, n: int, assets_n: int, words: tuple[str, ...], length: int = 12, ocr_share: float = 0.02, seed: int = 1) -> DataFrame:
    """row_id, asset_id, kind (transcript, ocr), text, start_seconds, end_seconds: rows of words, the first of them the most frequent."""
    vocabulary = F.array(*map(F.lit, words))
    pick = lambda k: F.element_at(vocabulary, (F.floor(F.pow(_uniform(F.col("id"), F.lit(seed), k), F.lit(2.0)) * len(words)) + 1).cast("int"))
    u = _uniform(F.col("id"), F.lit(seed), F.lit("at"))
    return spark.range(1, n + 1).select(
        F.col("id").alias("row_id"), (F.pmod("id", F.lit(assets_n)) + 1).alias("asset_id"), F.when(_uniform(F.col("id"), F.lit(seed), F.lit("kind")) < ocr_share, "ocr").otherwise("transcript").alias("kind"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), pick), " ").alias("text"), F.round(3600 * u, 3).alias("start_seconds"), F.round(3600 * u + 6, 3).alias("end_seconds"),
    )
