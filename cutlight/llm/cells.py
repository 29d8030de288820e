"""Cells of similar vectors: what the neighbour graph, search and clustering work on.

A cell holds vectors whose cosine to its first member is at least a threshold. Cells are
made block by block: pivots, fitted on a bounded sample, say which vectors come together
(pivots with many vectors are split by a hash of the id into blocks of some thousands),
and each block is divided into cells by itself. No task holds more than one block,
whatever the skew. Vectors travel and are kept packed: byte planes, then zstd.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlight.session import cut, shuffle_width

#: Rows of the sample that pivots are fitted on, and the most pivots that are kept.
SAMPLE = 20_000
PIVOTS = 512
#: Vectors in a block.
BLOCK = 8_192
#: Rows that a task gathers before it packs them.
GATHERED = 60_000
NO_TAG = np.iinfo(np.int64).min

CELL_SCHEMA = (
    "cell bigint, space string, n int, mean binary, cos_radius float, ids binary, tags binary, vectors binary"
)


def pack(x: np.ndarray) -> bytes:
    """float32 rows as byte planes, compressed without loss."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, np.float32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.float32).reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, safe for very large and very small values."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def usable_rows(b: pa.RecordBatch):
    """space, row numbers, float32 matrix of the usable vectors of a batch (id, space, vector, tag)."""
    v = b.column(2)
    spaces = b.column(1)
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    sizes = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    codes = spaces.dictionary_encode()
    code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for k, space in enumerate(codes.dictionary.to_pylist()):
        rows = np.flatnonzero((code == k) & (sizes > 0))
        if not len(rows):
            continue
        x = flat[starts[rows][:, None] + np.arange(sizes[rows[0]])]
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        yield space, rows[good], x[good]


def leaders(u: np.ndarray, least: float, step: int = 128) -> list[np.ndarray]:
    """Row numbers of unit rows in groups whose cosine to their first member is at least `least`."""
    groups, rest = [], np.arange(len(u))
    while len(rest):
        s = u[rest] @ u[rest[:step]].T
        free = np.ones(len(rest), bool)
        for c in range(min(step, len(rest))):
            if free[c]:
                own = free & (s[:, c] >= least)
                own[c] = True
                groups.append(rest[own])
                free &= ~own
        rest = rest[free]
    return groups


def prepared(segments: DataFrame, tag: str | None = None) -> DataFrame:
    """id, space (model and dimensions), vector, tag of the rows whose vector has the right length."""
    return segments.where("segment_id is not null and model_id is not null and dimensions > 0 and size(embedding) = dimensions").select(
        F.col("segment_id").cast("bigint").alias("id"),
        F.concat_ws("/", "model_id", F.col("dimensions").cast("string")).alias("space"),
        F.col("embedding").cast("array<float>").alias("vector"),
        (F.col(tag) if tag else F.lit(None)).cast("bigint").alias("tag"),
    )


@dataclass
class Pivots:
    """Pivots of each space, with the number of salts of each."""

    by_space: dict[str, np.ndarray]
    first: dict[str, int]
    salts: dict[str, np.ndarray]

    def nearest(self, space: str, u: np.ndarray, k: int = 1) -> np.ndarray:
        """Numbers of the k nearest pivots of unit rows, nearest first; a space without pivots has number 0 alone."""
        p = self.by_space.get(space)
        if p is None:
            return np.zeros((len(u), 1), np.int64)
        k = min(k, len(p))
        out = np.empty((len(u), k), np.int64)
        step = max(1, 2_000_000 // len(p))  # so many rows at a time that their similarities stay small
        for i in range(0, len(u), step):
            s = -(u[i : i + step] @ p.T)
            if k == 1:
                out[i : i + step, 0] = s.argmin(1)
                continue
            top = np.argpartition(s, k - 1, axis=1)[:, :k]
            out[i : i + step] = np.take_along_axis(top, np.argsort(np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
        return out


def fit_pivots(rows: DataFrame, total: int, least: float, block: int = BLOCK) -> Pivots:
    """Pivots from about SAMPLE rows, those whose hash of the id is divisible by a number. total: rows, about."""
    every = max(1, total // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id", "space", "vector", "tag")
    parts: dict[str, list] = {}
    for b in sample.mapInArrow(_as_packs, "space string, ids binary, vectors binary").collect():
        ids = np.frombuffer(b["ids"], np.int64)
        parts.setdefault(b["space"], []).append((ids, unpack(b["vectors"], len(ids))))
    by_space, first, salts, at = {}, {}, {}, 1
    for space in sorted(parts):
        ids = np.concatenate([i for i, _ in parts[space]])
        u = unit(np.concatenate([x for _, x in parts[space]])[np.argsort(ids, kind="stable")])
        groups = sorted(leaders(u, least), key=len, reverse=True)
        several = [g for g in groups if len(g) > 1]
        kept = several[:PIVOTS] if len(several) >= 16 else groups[:64]
        p = unit(np.stack([u[g].mean(0) for g in kept]))
        share = np.bincount((u @ p.T).argmax(1), minlength=len(p))
        by_space[space], first[space] = p, at
        salts[space] = np.maximum(1, np.ceil(share * every / block)).astype(np.int64)
        at += len(p)
    return Pivots(by_space, first, salts)


def _as_packs(batches):
    for b in batches:
        out = [(space, b.column(0).to_numpy()[rows].astype(np.int64).tobytes(), pack(x)) for space, rows, x in usable_rows(b)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["space", "ids", "vectors"])


def _mix(ids: np.ndarray) -> np.ndarray:
    """A hash of ids, never negative."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(8)).astype(np.int64)


_PACK = "grp bigint, space string, first_id bigint, n int, ids binary, tags binary, vectors binary"
_PACK_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def build_cells(rows: DataFrame, pivots: Pivots, least: float, block: int = BLOCK) -> DataFrame:
    """All usable vectors in cells (CELL_SCHEMA), as a table in the shared folder.

    rows: id, space, vector, tag. Repeated ids within a block stay once.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        p = shared.value
        held: dict[str, list] = {}
        n = 0

        def flush():
            out = []
            for space, parts in held.items():
                ids, tags, group, x = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort((ids, group))
                cuts = np.flatnonzero(np.diff(group[order])) + 1
                for own in np.split(order, cuts):
                    out.append((int(group[own[0]]), space, int(ids[own[0]]), len(own), ids[own].tobytes(), tags[own].tobytes(), pack(x[own])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_PACK_TYPES)], names=[c.split()[0] for c in _PACK.split(", ")])

        for b in batches:
            all_ids = b.column(0).to_numpy()
            all_tags = b.column(3).fill_null(NO_TAG).to_numpy()
            for space, at, x in usable_rows(b):
                if not len(at):
                    continue
                ids = all_ids[at].astype(np.int64)
                near = p.nearest(space, unit(x))[:, 0]
                salts = p.salts[space][near] if space in p.salts else np.full(len(at), 64)
                group = (near + p.first.get(space, 0)) << 20 | _mix(ids) % salts
                held.setdefault(space, []).append((ids, all_tags[at].astype(np.int64), group, x))
                n += len(at)
            if n >= GATHERED:
                yield flush()
                n = 0
        if held:
            yield flush()

    def divide(batches):
        for group, number, space, ids, tags, x in _blocks(batches, block):
            _, once = np.unique(ids, return_index=True)
            ids, tags, x = ids[once], tags[once], x[once]
            u = unit(x)
            out = []
            for k, own in enumerate(leaders(u, least)):
                mean = u[own].astype(np.float64).mean(0)
                length = np.linalg.norm(mean)
                radius = float((u[own] @ (mean / length)).min()) if length > 1e-6 and len(own) > 1 else 1.0
                out.append((group << 30 | number << 14 | k, space, len(own), mean.astype(np.float32).tobytes(), radius, ids[own].tobytes(), tags[own].tobytes(), pack(x[own])))
            types = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.float32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[c.split()[0] for c in CELL_SCHEMA.split(", ")])

    packs = rows.mapInArrow(assign, _PACK)
    width = shuffle_width(spark)
    return cut(packs.repartition(width, "grp", "space").sortWithinPartitions("grp", "space", "first_id", "n").mapInArrow(divide, CELL_SCHEMA))


def _blocks(batches, block: int):
    """Sorted packs as blocks of at most about `block` vectors: group, number, space, ids, tags, matrix."""
    key, held, n, number = None, [], 0, 0

    def block_of():
        ids, tags, x = (np.concatenate(c) for c in zip(*held))
        return key[0], number, key[1], ids, tags, x

    for b in batches:
        for r in b.to_pylist():
            if (r["grp"], r["space"]) != key:
                if held:
                    yield block_of()
                key, held, n, number = (r["grp"], r["space"]), [], 0, 0
            elif n >= block:
                yield block_of()
                held, n, number = [], 0, number + 1
            held.append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["tags"], np.int64), unpack(r["vectors"], r["n"])))
            n += r["n"]
    if held:
        yield block_of()
