"""Vectors: exact top-k, library statistics, centroids, model conflicts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlight.functions.vectors import dot, normalise


def exact_top_k(rows: DataFrame, row_id: str, vector: str, query: Column, k: int) -> DataFrame:
    """K1: row_id, similarity, rank_no of the k rows nearest to a query vector (a literal array); ties by row_id."""
    scored = rows.select(F.col(row_id).alias("row_id"), dot(F.col(vector), query).alias("similarity")).where("similarity is not null")
    best = scored.orderBy(F.desc("similarity"), "row_id").limit(k)
    return best.withColumn("rank_no", F.row_number().over(Window.orderBy(F.desc("similarity"), "row_id")))


def stride_sample(rows: DataFrame, row_id: str, most: int) -> DataFrame:
    """The rows whose id is divisible by max(1, n / most), at most `most` in order of id; deterministic."""
    n = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("stride"))
    return rows.join(F.broadcast(n)).where(F.pmod(F.col(row_id), F.col("stride")) == 0).drop("stride").orderBy(row_id).limit(most)


def library_statistics(sample: DataFrame, vector: str, query: Column) -> DataFrame:
    """Mean and population deviation of the similarities of a sample to a query, one row."""
    s = dot(F.col(vector), query)
    return sample.agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("deviation"), F.count(s).alias("n"))


def ensemble(phrases: DataFrame, vector: str) -> DataFrame:
    """The sum of vectors at length 1, as one row with an array `vector`."""
    parts = phrases.select(F.posexplode(F.col(vector).cast("array<double>"))).groupBy("pos").agg(F.sum("col").alias("x"))
    return parts.agg(normalise(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"])).alias("vector"))


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Key, n and the element-wise sum of its vectors at length 1; whole vectors are summed before the shuffle.

    Vectors of another length than the most frequent of their key count in n alone.
    """
    size = rows.groupBy(key).agg(F.count("*").alias("n"))
    v = rows.where(F.size(vector) > 0).select(key, F.col(vector).cast("array<double>").alias("v"))
    sums = v.groupBy(key, F.size("v").alias("d")).agg(F.count("*").alias("held"), Summarizer.sum(array_to_vector("v")).alias("s"))
    whole = sums.groupBy(key).agg(F.max_by("s", F.struct("held", "d")).alias("s"))
    return size.join(whole, key).select(key, "n", normalise(vector_to_array("s")).alias("centroid"))


def dimension_conflicts(*parts: tuple[DataFrame, str, str]) -> DataFrame:
    """Model ids for which tables (table, model column, dimensions column) disagree on the dimensions."""
    rows = None
    for df, model, dims in parts:
        one = df.select(F.col(model).alias("model_id"), F.col(dims).alias("dimensions"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("model_id").agg(F.min("dimensions").alias("least"), F.max("dimensions").alias("most")).where("least <> most")


def use_graph(index_model: str | None, index_count: int, model: str, canonical_count: int) -> bool:
    """K3: whether an approximate index may answer: same model, not empty, as many vectors as the table."""
    return index_model == model and index_count > 0 and index_count == canonical_count


def rerank(candidates: DataFrame, second: DataFrame, share: float, depth: int = 40) -> DataFrame:
    """The first `depth` candidates get confidence prev * (1 - share) + new * share; all are ordered anew.

    candidates: row_id, confidence, rank_no. second: row_id, confidence2.
    """
    both = candidates.join(second, "row_id", "left")
    new = F.when((F.col("rank_no") <= depth) & F.col("confidence2").isNotNull(), F.col("confidence") * (1 - share) + F.col("confidence2") * share).otherwise(F.col("confidence"))
    scored = both.select("row_id", new.alias("confidence"))
    return scored.withColumn("rank_no", F.row_number().over(Window.orderBy(F.desc("confidence"), "row_id")))
