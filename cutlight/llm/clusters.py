"""Grouping records into similarity clusters.

The neighbour graph of cells (neighbour descent) gives the pairs of cells that may hold
similar vectors. A pair counts as linked if two of its vectors are similar enough: surely
so if the mean cosine between the cells is, surely not if the cells are too far apart for
their radii, and by comparing the vectors otherwise. A cluster is what hangs together by
links. Within the clusters, communities of high modularity are formed by local moving on
the linked cells, weighted by the sum of cosines between them; they tell a cluster that is
one voice from one in which several hang together by a few links. A record's internal
degree, the sum of its cosines to all records of its community, is its dot product with
the sum of their unit vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlight.llm.cells import NO_TAG, build_cells, fit_pivots, prepared, unit, unpack
from cutlight.llm.graph import coded, descend, graph_pivots
from cutlight.session import cut, shuffle_width

#: Similarity of means from which two cells are examined for a link.
GRAPH_LEAST = 0.5
#: Error of a cosine taken from coded means.
SLACK = 5e-3
#: Rows up to which a list of cells is broadcast to find them.
FEW = 100_000


def _links(cells: DataFrame, scalars: DataFrame, graph: DataFrame, least: float) -> DataFrame:
    """a, b, w: linked cells (a < b) and the sum of cosines between their vectors."""
    pairs = graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    side = lambda c: scalars.select(F.col("cell").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "len", "r")))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    average = F.col("sim") * F.col("len_a") * F.col("len_b")
    far = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("sim").cast("double")))) - F.col("r_a") - F.col("r_b")
    pairs = cut(
        pairs.select(
            "a", "b", "n_a", "n_b", (average * F.col("n_a") * F.col("n_b")).alias("w"),
            (average >= least + SLACK).alias("sure"), (F.cos(F.greatest(F.lit(0.0), far)) >= least - SLACK).alias("can"),
        ).where("sure or can")
    )
    larger = F.col("n_a") >= F.col("n_b")
    doubtful = pairs.where("not sure").select(
        F.when(larger, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("guest")
    )
    # lists of cells are broadcast if they are known to be short, so that only their vectors move
    short = (lambda df: F.broadcast(df)) if doubtful.count() <= FEW else (lambda df: df)
    wanted = doubtful.select(F.col("host").alias("cell")).distinct()
    hosts = cells.select("cell", "n", "vectors").join(short(wanted), "cell", "left_semi").select(F.col("cell").alias("host"), F.lit(None).cast("bigint").alias("guest"), "n", "vectors")
    visiting = cells.select(F.col("cell").alias("guest"), "n", "vectors").join(short(doubtful), "guest")
    guests = visiting.select("host", "guest", "n", "vectors")

    def compare(batches):
        host, held = None, None
        for b in batches:
            out = []
            for h, g, n, v in zip(*(b.column(k).to_pylist() for k in range(4))):
                if g is None:
                    host, held = h, unit(unpack(v, n))
                elif h == host and float((unit(unpack(v, n)) @ held.T).max()) >= least - 1e-6:
                    out.append((min(h, g), max(h, g)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], names=["a", "b"])

    seen = hosts.unionByName(guests).repartition(shuffle_width(cells.sparkSession), "host").sortWithinPartitions("host", F.col("guest").asc_nulls_first()).mapInArrow(compare, "a bigint, b bigint")
    return cut(pairs.where("sure").select("a", "b", "w").unionByName(pairs.where("not sure").join(seen, ["a", "b"], "left_semi").select("a", "b", "w")))


def _scalars(batches):
    for b in batches:
        length = [float(np.linalg.norm(np.frombuffer(m, np.float32))) for m in b.column(2).to_pylist()]
        r = np.arccos(np.clip(b.column(3).to_numpy().astype(np.float64), -1, 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(length, pa.float64()), pa.array(r, pa.float64())], names=["cell", "n", "len", "r"])


def communities(links: DataFrame, inner: DataFrame, rounds: int = 12) -> DataFrame:
    """node, label: communities by local moving for modularity, until no node moves (or after `rounds`).

    links: a, b, w. inner: node, w (weight within the node). In even rounds a node may move
    to a smaller label only, in odd ones to a larger, so that two never swap.
    """
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"), "w")))
    degree = both.groupBy("node").agg(F.sum("w").alias("k")).join(inner.withColumnRenamed("w", "own"), "node").select("node", (F.col("k") + F.col("own")).alias("k"))
    state = cut(degree.withColumn("label", F.col("node")))
    still = 0
    for i in range(rounds):
        total = state.agg(F.sum("k").alias("m2"))
        held = state.groupBy("label").agg(F.sum("k").alias("tot"))
        toward = both.join(state.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("w").alias("w"))
        options = toward.unionByName(state.select("node", "label", F.lit(0.0).alias("w"))).groupBy("node", "label").agg(F.sum("w").alias("w"))
        scored = options.join(held, "label").join(state.select("node", "k", F.col("label").alias("now")), "node").join(F.broadcast(total))
        stays = F.col("label") == F.col("now")
        gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("m2")
        way = F.col("label") < F.col("now") if i % 2 == 0 else F.col("label") > F.col("now")
        best = scored.where(stays | way).groupBy("node").agg(F.max_by("label", F.struct(gain.alias("g"), stays.alias("s"), -F.col("label"))).alias("label"))
        after = cut(state.withColumnRenamed("label", "before").join(best, "node"))
        state = after.select("node", "k", "label")
        still = still + 1 if after.where("label <> before").isEmpty() else 0
        if still == 2:
            break
    return state.select("node", "label")


def components(pairs: DataFrame) -> DataFrame:
    """node, root: connected components of a, b; the root is the smallest node."""
    both = cut(pairs.select("a", "b").where("a <> b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    state = cut(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "node")
        lower = state.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        leap = state.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = cut(lower.join(leap, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")))
        state = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return state


def linked_cells(segments: DataFrame, least: float = 0.8, tag: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """The cells of all usable vectors, their scalars, their links, and cell, cluster for each of them; None without any vector."""
    rows = prepared(segments, tag)
    pivots = fit_pivots(rows, segments.count(), least)
    if not pivots.by_space and rows.isEmpty():
        return None
    cells = build_cells(rows, pivots, least)
    scalars = cut(cells.select("cell", "n", "mean", "cos_radius").mapInArrow(_scalars, "cell bigint, n int, len double, r double"))
    nodes = coded(cells)
    links = _links(cells, scalars, descend(nodes, graph_pivots(cells, nodes, 4_096), least=GRAPH_LEAST), least)
    roots = components(links)
    named = cells.select("cell").join(roots.withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("root", "cell").alias("cluster"))
    return cells, scalars, links, cut(named)


def _members(cells: DataFrame, named: DataFrame) -> DataFrame:
    """id, tag, cluster, space: one row for each record."""

    def spread(batches):
        for b in batches:
            cluster, space, ids, tags = (b.column(k).to_pylist() for k in range(4))
            n = [len(x) // 8 for x in ids]
            tag = np.frombuffer(b"".join(tags), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(b"".join(ids), np.int64), pa.int64()), pa.array(tag, pa.int64(), mask=tag == NO_TAG),
                    pa.array(np.repeat(np.array(cluster, np.int64), n), pa.int64()), pa.array([s for s, k in zip(space, n) for _ in range(k)], pa.string()),
                ],
                names=["id", "tag", "cluster", "space"],
            )

    rows = cells.select("cell", "space", "ids", "tags").join(named, "cell").select("cluster", "space", "ids", "tags")
    return rows.mapInArrow(spread, "id bigint, tag bigint, cluster bigint, space string").dropDuplicates(["id"])


def _keys(members: DataFrame) -> DataFrame:
    """cluster, size, cluster_key, first_id of the clusters of two or more records."""
    votes = members.groupBy("cluster", "tag").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    per = votes.groupBy("cluster").agg(
        F.sum("n").alias("size"), F.min("first_id").alias("first_id"),
        F.max_by("tag", F.when(F.col("tag").isNotNull(), F.struct("n", -F.col("tag")))).alias("top"),
    )
    return per.where("size > 1").select("cluster", "size", "first_id", F.coalesce("top", -F.col("first_id")).alias("cluster_key"))


def similarity_clusters(segments: DataFrame, least: float = 0.8, tag: str = "voice_id") -> DataFrame:
    """segment_id, cluster_key, size for each segment in a cluster of two or more.

    Segments with usable embeddings of one model and length belong together if their
    cosine is at least `least`, directly or through others. The key of a cluster is its
    most frequent non-null tag (the smaller on a tie) or, without one, minus its smallest
    segment_id. Segments that are alone don't come out. Repeated segments count once;
    unusable embeddings are left out; an empty table gives an empty result; further
    columns are ignored.
    """
    found = linked_cells(segments, least, tag)
    if found is None:
        return segments.sparkSession.createDataFrame([], "segment_id bigint, cluster_key bigint, size bigint")
    members = cut(_members(found[0], found[3]))
    return members.join(_keys(members), "cluster").select(F.col("id").alias("segment_id"), "cluster_key", "size")


def describe_clusters(segments: DataFrame, least: float = 0.8, tag: str = "voice_id", typical: int = 3) -> DataFrame:
    """One row for each cluster: cluster_key, size, first_id, communities, core_size, typical segments and centrality.

    communities is the number of communities of high modularity in the cluster, core_size the
    number of records of the largest. The typical segments are those of highest internal degree
    in that community, best first; centrality is the mean cosine of the first to its others.
    """
    found = linked_cells(segments, least, tag)
    if found is None:
        return segments.sparkSession.createDataFrame([], "cluster_key bigint, size bigint, first_id bigint, communities bigint, core_size bigint, typical array<bigint>, centrality double")
    cells, scalars, links, named = found
    nodes = links.select(F.col("a").alias("cell")).union(links.select("b")).distinct()
    inner = scalars.join(nodes, "cell", "left_semi").select(F.col("cell").alias("node"), (F.col("n") * F.col("n") * F.col("len") * F.col("len")).alias("w"))
    label = communities(links, inner).select(F.col("node").alias("cell"), "label")
    placed = cut(named.join(label, "cell", "left").select("cell", "cluster", F.coalesce("label", "cell").alias("label")))
    sizes = scalars.select("cell", "n").join(placed, "cell").groupBy("cluster", "label").agg(F.sum("n").alias("n"))
    core = cut(sizes.groupBy("cluster").agg(F.count("*").alias("communities"), F.max("n").alias("core_size"), F.max_by("label", F.struct("n", -F.col("label"))).alias("label")))

    def sums(batches):
        """The sum of the unit vectors of each community's cells, as far as a batch holds them."""
        for b in batches:
            held: dict[tuple[int, int], np.ndarray] = {}
            for cluster, n, mean in zip(*(b.column(k).to_pylist() for k in range(3))):
                v = np.frombuffer(mean, np.float32).astype(np.float64) * n
                held[cluster, len(v)] = held[cluster, len(v)] + v if (cluster, len(v)) in held else v
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["cluster", "s"])

    own = cells.join(placed.join(core.select("cluster", "label", "core_size"), ["cluster", "label"]).where("core_size > 1").select("cell", "cluster"), "cell")
    parts = own.select("cluster", "n", "mean").mapInArrow(sums, "cluster bigint, s array<double>").select("cluster", F.posexplode("s"))
    total = parts.groupBy("cluster", "pos").agg(F.sum("col").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("total"))

    def rank(batches):
        for b in batches:
            out = []
            for cluster, n, ids, vectors, s in zip(*(b.column(k).to_pylist() for k in range(5))):
                degree = unit(unpack(vectors, n)).astype(np.float64) @ np.array(s) - 1
                number = np.frombuffer(ids, np.int64)
                for i in np.lexsort((number, -degree))[:typical]:
                    out.append((cluster, int(number[i]), float(degree[i])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["cluster", "id", "degree"])

    keys = cut(_keys(_members(cells, named)))
    few = own.join(total, "cluster").select("cluster", "n", "ids", "vectors", "total").mapInArrow(rank, "cluster bigint, id bigint, degree double")
    few = few.groupBy("cluster", "id").agg(F.max("degree").alias("degree"))
    # the best of each cell at most are left, and of these the best of the cluster
    w = Window.partitionBy("cluster").orderBy(F.desc("degree"), "id")
    best = few.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)
    top = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda e: e["id"]).alias("typical"), F.max("degree").alias("degree"))
    return keys.join(core.drop("label"), "cluster").join(top, "cluster", "left").select(
        "cluster_key", "size", "first_id", "communities", "core_size", "typical", F.round(F.col("degree") / (F.col("core_size") - 1), 4).alias("centrality")
    )
