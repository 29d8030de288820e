"""A stored index of vectors for approximate search.

Vectors lie in lists, each around a pivot; a query looks only into the lists whose
pivots are nearest to it, and the files are read by list. The table of vectors stays the
truth: an index that does not hold as many vectors of the same model isn't used.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlight.operators.vector_search import exact_top_k, use_graph
from cutlight.session import cut

#: Rows that pivots are fitted on, and the most pivots.
SAMPLE, MOST_PIVOTS = 20_000, 1_024


@dataclass(frozen=True)
class VectorIndex:
    """Lists (row_id, vector, list), the pivots, and the model."""

    rows: DataFrame
    pivots: np.ndarray
    model: str


def _placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS rows

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.map(np.asarray).tolist()).astype(np.float32) if len(v) else np.zeros((0, shared.value.shape[1]), np.float32)
        return pd.Series((x @ shared.value.T).argmax(1) if len(x) else [], dtype="int32")

    return vectors.withColumn("list", nearest("vector"))


def build(table: DataFrame, row_id: str, vector: str, model: str) -> VectorIndex | None:
    """The index of a table's non-null vectors of one length; None without any.

    Pivots are vectors of a bounded sample, those with the smallest hash of the id; as many as the square root of the rows.
    """
    rows = table.select(F.col(row_id).alias("row_id"), F.col(vector).cast("array<float>").alias("vector")).where("row_id is not null and size(vector) > 0")
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return None
    rows = rows.where(F.size("vector") == size["d"])
    sample = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(min(SAMPLE, max(16, min(MOST_PIVOTS, int(size["count"] ** 0.5))))).select("vector").toPandas()
    p = np.stack(sample["vector"].map(np.asarray).tolist()).astype(np.float32)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    return VectorIndex(cut(_placed(rows, p).repartition("list").sortWithinPartitions("list")), p, model)


def add(index: VectorIndex, more: DataFrame) -> VectorIndex:
    """With more vectors (row_id, vector); those that it holds under the same id are replaced."""
    fresh = more.select("row_id", F.col("vector").cast("array<float>").alias("vector")).where(F.size("vector") == index.pivots.shape[1]).dropDuplicates(["row_id"])
    kept = index.rows.join(fresh.select("row_id"), "row_id", "left_anti")
    return replace(index, rows=cut(kept.unionByName(_placed(fresh, index.pivots))))


def remove(index: VectorIndex, ids: DataFrame) -> VectorIndex:
    """Without the vectors of some ids (row_id)."""
    return replace(index, rows=cut(index.rows.join(ids.select("row_id").distinct(), "row_id", "left_anti")))


def search(index: VectorIndex, query: list[float], k: int, probes: int = 8) -> DataFrame:
    """K2: row_id, similarity, rank_no of about the k nearest: the best of the `probes` lists nearest to the query."""
    near = np.argsort(-(index.pivots @ np.asarray(query, np.float32)), kind="stable")[:probes]
    return exact_top_k(index.rows.where(F.col("list").isin(near.tolist())), "row_id", "vector", F.array(*(F.lit(float(x)) for x in query)), k)


def nearest(table: DataFrame, row_id: str, vector: str, model: str, query: list[float], k: int, index: VectorIndex | None = None, probes: int = 8) -> DataFrame:
    """K1 to K3: by the index if it is of this model and holds as many vectors as the table, else by a scan of the table."""
    if index is not None and use_graph(index.model, index.rows.count(), model, table.where(F.size(vector) > 0).count()):
        return search(index, query, k, probes)
    return exact_top_k(table, row_id, vector, F.array(*(F.lit(float(x)) for x in query)), k)
