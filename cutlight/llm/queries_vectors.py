"""Queries p3 and p4: clusters of voices and nearest segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlight.llm.clusters import describe_clusters, similarity_clusters
from cutlight.llm.neighbours import nearest, nearest_by_walk
from cutlight.sources import read_table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return similarity_clusters(read_table(spark, d)("voice_segments")).select("segment_id", "cluster_key")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Per cluster: size, most typical segments, the voice that it mostly carries, and that voice's best proposal."""
    t = read_table(spark, d)
    best = t("voice_proposals").distinct().groupBy("voice_id").agg(F.max_by("person_id", F.struct("shared_seconds", -F.col("person_id"))).alias("person_id"))
    return describe_clusters(t("voice_segments")).join(best.withColumnRenamed("voice_id", "cluster_key"), "cluster_key", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d)
    hits = nearest(t("voice_segments"), t("probe_segments"))
    return hits.select(F.least("query", "id").alias("segment_id_a"), F.greatest("query", "id").alias("segment_id_b")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest segments of each segment whose id is divisible by 20, with their cosine."""
    segments = read_table(spark, d)("voice_segments")
    hits = nearest_by_walk(segments, segments.where("segment_id % 20 = 0").select("segment_id"))
    return hits.select(F.col("query").alias("segment_id"), F.col("id").alias("neighbour_id"), "rank_no", F.round(F.col("sim").cast("double"), 4).alias("score"))


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters, "p4_found": p4_found, "p4_neighbours": p4_neighbours}
SQL: dict[str, str] = {}
