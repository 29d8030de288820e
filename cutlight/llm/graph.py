"""Neighbour graph of cells by neighbour descent.

The first neighbours of a cell are sought among the cells that share one of its
nearest pivots; the pivots are cells of several vectors themselves, and the more cells there
are, the more pivots. Pivots with many cells are split by a hash. Then, round by round, each cell brings its neighbours together, and
those that are nearer to each other than the neighbours that they have take each other
as neighbours, until hardly any edge changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlight.llm.cells import Pivots, _mix
from cutlight.session import cut, shuffle_width

#: Most pivots of all spaces together; their means are held by every task (1.5 MB at 96 dimensions).
MOST_PIVOTS = 4_096
#: Cosine to its nearest pivot below which a cell belongs to none of them.
LONE = 0.75

_EDGE = "a bigint, b bigint, sim float"
_EDGE_TYPES = [pa.int64(), pa.int64(), pa.float32()]


def _edges(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((a, b, s), _EDGE_TYPES)], names=["a", "b", "sim"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar neighbours of each cell; other columns than a, b and sim keep their largest value."""
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    others = [F.max(c).alias(c) for c in edges.columns if c not in ("a", "b")]
    return edges.groupBy("a", "b").agg(*others).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _near_in_block(cells: np.ndarray, x: np.ndarray, k: int, least: float, known: np.ndarray | None = None):
    """a, b, sim of the pairs in a block that are among the k best of a and at least `least`."""
    step = max(1, 4_000_000 // max(1, len(cells)))
    for i in range(0, len(cells), step):
        s = x[i : i + step] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        bar = np.full((len(s), 1), least, np.float32) if known is None else np.maximum(least, known[i : i + step, None])
        if s.shape[1] > k:
            bar = np.maximum(bar, np.partition(s, -k, axis=1)[:, -k][:, None])
        p, q = np.nonzero(s >= bar)
        yield cells[p + i], cells[q], s[p, q]


def code(x: np.ndarray) -> bytes:
    """A vector's direction in one byte a dimension, behind the scale."""
    top = max(float(np.abs(x).max()), 1e-30)
    q = np.rint(x * (127 / top)).astype(np.int8)
    return np.float32(1 / max(float(np.linalg.norm(q.astype(np.float32))), 1e-30)).tobytes() + q.tobytes()


def decode(codes: list[bytes]) -> np.ndarray:
    """Rows at length 1."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def coded(cells: DataFrame) -> DataFrame:
    """cell, space, v, r: the directions of the cells' means in short form and their radius as an angle, as a table in the shared folder."""

    def shorten(batches):
        for b in batches:
            v = [code(np.frombuffer(m, np.float32)) for m in b.column(2).to_pylist()]
            r = np.arccos(np.clip(b.column(3).to_numpy(), -1, 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v, pa.binary()), pa.array(r, pa.float32())], names=["cell", "space", "v", "r"])

    return cut(cells.select("cell", "space", "mean", "cos_radius").mapInArrow(shorten, "cell bigint, space string, v binary, r float"))


def graph_pivots(cells: DataFrame, nodes: DataFrame, block: int, most: int = MOST_PIVOTS) -> Pivots:
    """Pivots for cells: the cells of two vectors or more, beyond `most` a share of them by hash. A space that has none has no pivots.

    block: the number of cells from which a pivot is split.
    """
    counts = {r[0]: (r[1], r[2]) for r in cells.groupBy("space").agg(F.count("*"), F.count_if(F.col("n") > 1)).collect()}  # one row for each model
    every = max(1, -(-sum(n for _, n in counts.values()) // most))
    chosen = cells.where("n > 1").where(F.pmod(F.xxhash64("cell"), F.lit(every)) == 0).select("cell")
    rows = nodes.select("cell", "space", "v").join(chosen, "cell").collect()  # about `most` rows of a byte a dimension
    by_space, first, salts, at = {}, {}, {}, 1
    for space in sorted({r["space"] for r in rows}):
        p = decode([r["v"] for r in sorted(rows, key=lambda r: r["cell"]) if r["space"] == space])
        by_space[space], first[space] = p, at
        # pivots that lie close together share their cells
        crowd = np.concatenate([((p[i : i + 256] @ p.T) > 0.9).sum(1) for i in range(0, len(p), 256)])
        salts[space] = np.maximum(1, np.ceil(crowd * counts[space][0] / len(p) / block)).astype(np.int64)
        at += len(p)
    return Pivots(by_space, first, salts)


def under_pivots(nodes: DataFrame, pivots: Pivots, shared_pivots: int = 3, lone_pivots: int = 8) -> DataFrame:
    """Each node (cell, space, v, asked) once for each of its nearest pivots: grp (pivot and salt), space, cell, v, asked."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def spread(batches):
        p = shared.value
        for b in batches:
            out: list = []
            space = np.array(b.column(1).to_pylist(), object)
            all_cells = b.column(0).to_numpy()
            all_asked = b.column(3).to_numpy(zero_copy_only=False)
            for name in sorted(set(space.tolist())):
                at = np.flatnonzero(space == name)
                codes = [b.column(2)[int(i)].as_py() for i in at]
                u = decode(codes)
                near = p.nearest(name, u, lone_pivots)
                salts = p.salts[name][near] if name in p.salts else np.ones_like(near)
                group = near + p.first.get(name, 0) << 20 | _mix(all_cells[at])[:, None] % salts
                # a cell that no pivot is close to may be near any of several
                lone = (u * p.by_space[name][near[:, 0]]).sum(1) < LONE if name in p.by_space else np.ones(len(u), bool)
                counts = np.where(lone | all_asked[at], lone_pivots, shared_pivots)
                for gs, n, c, v, o in zip(group.tolist(), counts.tolist(), all_cells[at].tolist(), codes, all_asked[at].tolist()):
                    out += [(g, name, c, v, o) for g in gs[:n]]
            types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=["grp", "space", "cell", "v", "asked"])

    return nodes.select("cell", "space", "v", "asked").mapInArrow(spread, "grp bigint, space string, cell bigint, v binary, asked boolean")


def descend(nodes: DataFrame, pivots: Pivots, k: int = 8, least: float = 0.3, shared_pivots: int = 3, lone_pivots: int = 8, block: int = 4_096, rounds: int = 10, around_hub: int = 10, settled: float = 0.01) -> DataFrame:
    """Edges a, b, sim between cells of one space: each with up to k neighbours whose similarity is at least `least`.

    nodes: cell, space, v, as coded() makes them. A cell is first compared with those that share one
    of its shared_pivots nearest pivots; one that is close to none, of its lone_pivots nearest. A cell whose column
    `asked` (optional) is true takes lone_pivots too, and keeps its first neighbours however far they are. The similarity of two cells is the
    cosine of their means; single vectors are cells of one. The graph is approximate:
    a neighbour may be missed. In a round a cell brings together its around_hub nearest
    neighbours of either direction, if an edge of its own is new; the rounds end when no more
    than the share `settled` of the edges is new.
    """
    width = shuffle_width(nodes.sparkSession)

    def first(batches):
        for cell, x, bar in _groups(batches, ("grp", "space"), "cell", block):
            for e in _near_in_block(cell, x, k, -2.0, bar):
                yield _edges(*e)

    placed = under_pivots(nodes if "asked" in nodes.columns else nodes.withColumn("asked", F.lit(False)), pivots, shared_pivots, lone_pivots)
    placed = placed.select("grp", "space", "cell", "v", F.when(F.col("asked"), -2.0).otherwise(least).alias("bar"))
    found = placed.repartition(width, "grp", "space").sortWithinPartitions("grp", "space", F.xxhash64("cell")).mapInArrow(first, _EDGE)
    graph = cut(_best(found, k))

    def join_around(batches):
        for cell, x, bar in _groups(batches, ("hub",), "cell", block):
            for e in _near_in_block(cell, x, k, least, bar):
                yield _edges(*e)

    size, fresh = None, graph
    for _ in range(rounds):
        both = graph.select("a", "b", "sim").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
        changed = fresh.select(F.col("a").alias("hub")).union(fresh.select("b")).distinct()
        around = _best(both, around_hub).join(changed.withColumnRenamed("hub", "a"), "a", "left_semi")
        members = around.select(F.col("a").alias("hub"), F.col("b").alias("cell")).where("hub <> cell")
        bars = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("low")).select(F.col("a").alias("cell"), F.when(F.col("n") >= k, F.col("low")).alias("bar"))
        gathered = members.join(nodes.select("cell", "v"), "cell").join(bars, "cell", "left")
        nearer = gathered.repartition(width, "hub").sortWithinPartitions("hub", "cell").mapInArrow(join_around, _EDGE)
        new = nearer.join(graph, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.max("sim").alias("sim"))
        merged = cut(_best(graph.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True))), k))
        graph, fresh = merged.drop("new"), merged.where("new").drop("new")
        changes = fresh.count()
        size = graph.count() if size is None else size
        if changes <= settled * size:
            break
    return graph


def _groups(batches, key: tuple[str, ...], name: str, block: int):
    """Sorted rows (key, name, v, bar?) in groups of at most `block`: numbers, matrix, bars."""
    now, ids, rows, bars = None, [], [], []

    def group():
        bar = np.array([-2.0 if x is None else x for x in bars], np.float32) if bars else None
        return np.array(ids, np.int64), decode(rows), bar

    for b in batches:
        cols = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in (*key, name, "v")}
        bar_col = b.column(b.schema.get_field_index("bar")).to_pylist() if b.schema.get_field_index("bar") >= 0 else None
        for i in range(b.num_rows):
            k = tuple(cols[c][i] for c in key)
            if k != now or len(ids) >= block:
                if len(ids) > 1:
                    yield group()
                now, ids, rows, bars = k, [], [], []
            ids.append(cols[name][i])
            rows.append(cols["v"][i])
            if bar_col is not None:
                bars.append(bar_col[i])
    if len(ids) > 1:
        yield group()
