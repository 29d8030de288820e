"""Portable snapshots of one volume's part of a catalogue.

A snapshot is a folder with one Parquet table each, a manifest with a checksum, and nothing
else: no bookmarks, biometrics or usage. Tables are on an allow list.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("volumes", "locations", "assets", "moments", "transcript_chunks", "search_rows")
FORMAT, MOST_MANIFEST = 1, 64 * 1024
DEEP = 8


def closure(tables: dict[str, DataFrame], volume: str) -> dict[str, DataFrame]:
    """The rows of the allowed tables that belong to one volume; online becomes offline, private levels go."""
    out = {"volumes": tables["volumes"].where(F.col("volume_uuid") == volume).drop("bookmark").withColumn("is_online", F.lit(False))}
    locations = tables["locations"].where(F.col("volume_uuid") == volume)
    out["locations"] = locations.withColumn("availability", F.when(F.col("availability") == "online", "offline").otherwise(F.col("availability")))
    ids = locations.select("asset_id").distinct()
    out["assets"] = tables["assets"].join(ids, "asset_id", "left_semi").withColumn("indexed_levels", F.col("indexed_levels").bitwiseAND(F.lit(~DEEP)))
    for name in ("moments", "transcript_chunks", "search_rows"):
        if name in tables:
            out[name] = tables[name].join(ids, "asset_id", "left_semi")
    return out


def _digest(folder: Path) -> str:
    h = hashlib.sha256()
    for p in sorted(folder.rglob("*.parquet")):
        h.update(str(p.relative_to(folder)).encode())
        h.update(hashlib.sha256(p.read_bytes()).digest())
    return h.hexdigest()


def export(tables: dict[str, DataFrame], volume: str, folder: str) -> dict:
    """Writes a snapshot; it appears under its name only when complete."""
    staging = Path(folder + ".part")
    shutil.rmtree(staging, ignore_errors=True)
    for name, df in closure(tables, volume).items():
        df.write.parquet(f"file://{staging}/{name}")
    manifest = {"format": FORMAT, "volume_uuid": volume, "checksum": _digest(staging)}
    (staging / "manifest.json").write_text(json.dumps(manifest, sort_keys=True))
    os.rename(staging, folder)
    return manifest


def inspect(folder: str) -> dict:
    """The manifest of a sound snapshot; ValueError for anything else."""
    root = Path(folder)
    if root.is_symlink() or any(p.is_symlink() for p in root.rglob("*")):
        raise ValueError("a snapshot holds no links")
    at = root / "manifest.json"
    if not at.is_file() or at.stat().st_size >= MOST_MANIFEST:
        raise ValueError("the manifest is missing or too large")
    manifest = json.loads(at.read_text())
    if manifest.get("format") != FORMAT:
        raise ValueError("unknown format")
    if any(p.suffix in (".wal", ".journal") or p.name.startswith("_temporary") for p in root.rglob("*")):
        raise ValueError("the snapshot is being written")
    if manifest.get("checksum") != _digest(root):
        raise ValueError("the checksum differs")
    return manifest


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a sound snapshot."""
    inspect(folder)
    return {n: spark.read.parquet(f"file://{folder}/{n}") for n in TABLES if (Path(folder) / n).is_dir()}


def asset_map(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """old_id, new_id, is_new: incoming assets by content_key; new ones are numbered after the local ones.

    Numbers are given in order of content_key, part by part, without sorting all rows in
    one task: parts hold ranges of keys, and each starts after those before it.
    """
    known = local.groupBy("content_key").agg(F.min("asset_id").alias("have"))
    rows = incoming.groupBy("content_key").agg(F.min("asset_id").alias("old_id"), F.collect_set("asset_id").alias("all"))
    both = rows.join(known, "content_key", "left")
    part = F.substring(F.sha2("content_key", 256), 1, 2)
    fresh = both.where("have is null").withColumn("part", part)
    before = fresh.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = local.agg(F.coalesce(F.max("asset_id"), F.lit(0)).alias("top"))
    numbered = fresh.join(F.broadcast(before.select("part", "before")), "part").join(F.broadcast(top)).withColumn("new_id", F.col("top") + F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("content_key")))
    kept = both.where("have is not null").select("all", F.col("have").alias("new_id"), F.lit(False).alias("is_new"))
    return kept.unionByName(numbered.select("all", "new_id", F.lit(True).alias("is_new"))).select(F.explode("all").alias("old_id"), "new_id", "is_new")


def conflicts(local: dict[str, DataFrame], incoming: dict[str, DataFrame], mapping: DataFrame) -> DataFrame:
    """What forbids a merge: kind (strong_key or path) and key. Empty if all is well."""
    both = incoming["assets"].select(F.col("asset_id").alias("old_id"), F.col("strong_key").alias("theirs")).join(mapping.where("not is_new"), "old_id").join(
        local["assets"].select(F.col("asset_id").alias("new_id"), F.col("strong_key").alias("ours")), "new_id"
    )
    keys = both.where("theirs <> ours").select(F.lit("strong_key").alias("kind"), F.col("new_id").cast("string").alias("key"))
    paths = incoming["locations"].withColumnRenamed("asset_id", "old_id").join(mapping, "old_id").join(
        local["locations"].select("volume_uuid", "relative_path", F.col("asset_id").alias("ours")), ["volume_uuid", "relative_path"]
    )
    return keys.unionByName(paths.where("ours <> new_id").select(F.lit("path").alias("kind"), F.col("relative_path").alias("key"))).distinct()


def merge(local: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The local tables with a snapshot merged in, ids mapped; ValueError, and nothing changed, on a conflict.

    Analysis (moments, text rows) of an asset is taken only if there is none here.
    """
    mapping = asset_map(local["assets"], incoming["assets"])
    found = conflicts(local, incoming, mapping).limit(5).collect()
    if found:
        raise ValueError(f"conflicts: {[(r.kind, r.key) for r in found]}")
    remap = lambda df: df.withColumnRenamed("asset_id", "old_id").join(mapping.select("old_id", "new_id"), "old_id").drop("old_id").withColumnRenamed("new_id", "asset_id")
    fresh = mapping.where("is_new").select("old_id", "new_id")
    new_assets = incoming["assets"].withColumnRenamed("asset_id", "old_id").join(fresh, "old_id").drop("old_id").withColumnRenamed("new_id", "asset_id").dropDuplicates(["asset_id"])
    out = dict(local)
    out["assets"] = local["assets"].unionByName(new_assets, allowMissingColumns=True)
    there = local["locations"].select("volume_uuid", "relative_path")
    out["locations"] = local["locations"].unionByName(remap(incoming["locations"]).join(there, ["volume_uuid", "relative_path"], "left_anti"), allowMissingColumns=True)
    analysed = local["moments"].select("asset_id").union(local["transcript_chunks"].select("asset_id")).distinct() if "moments" in local else None
    for name in ("moments", "transcript_chunks", "search_rows"):
        if name in local and name in incoming:
            own = remap(incoming[name])
            out[name] = local[name].unionByName(own.join(analysed, "asset_id", "left_anti") if analysed is not None else own, allowMissingColumns=True)
    return out
