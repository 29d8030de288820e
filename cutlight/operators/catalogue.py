"""Catalogue tables as state: upserts, replacement, repair, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels of indexing, as bits.
LEVELS = {"metadata": 1, "visual": 2, "spoken": 4, "deep": 8}


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """The table with the rows of `changes` in place of those with equal keys.

    Of several changes to a key the latest counts (by a column; ties, and without one, by the order of the values). Columns
    that the changes lack become null in changed rows.
    """
    others = [c for c in changes.columns if c not in keys and c != latest and not changes.schema[c].dataType.simpleString().startswith("map")]
    w = Window.partitionBy(*keys).orderBy(*([F.desc(latest)] if latest else []), *others or keys)
    newest = changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    kept = table.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True).select(*table.columns)


def replace_slices(table: DataFrame, fresh: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """The table without the rows of the touched keys (those of `fresh` by default), and with the fresh rows."""
    keys = (touched if touched is not None else fresh).select(key).distinct()
    return table.join(keys, key, "left_anti").unionByName(fresh)


def metadata_rows(assets: DataFrame, locations: DataFrame) -> DataFrame:
    """asset_id, kind (filename, folder, metadata) and text of each asset, blank texts left out."""
    folder = F.regexp_replace("relative_path", "/?[^/]*$", "")
    a = assets.select("asset_id", F.col("display_name").alias("filename"), F.concat_ws(" ", "camera_make", "camera_model").alias("camera"))
    names = a.select("asset_id", F.lit("filename").alias("kind"), F.col("filename").alias("text"))
    cameras = a.select("asset_id", F.lit("metadata").alias("kind"), F.col("camera").alias("text"))
    folders = locations.where("asset_id > 0").select("asset_id", F.lit("folder").alias("kind"), folder.alias("text"))
    return reduce(DataFrame.unionByName, (names, cameras, folders)).where("trim(text) <> ''").distinct()


def coverage(assets: DataFrame, levels: str = "indexed_levels") -> DataFrame:
    """The number of assets and of those with each level, in one pass."""
    return assets.agg(F.count("*").alias("assets"), *(F.count_if(F.col(levels).bitwiseAND(bit) != 0).alias(name) for name, bit in LEVELS.items()))


def add_levels(levels: Column, bits: int) -> Column:
    """C6."""
    return F.coalesce(levels, F.lit(0)).bitwiseOR(F.lit(bits))


def same_revision(size_a: Column, at_a: Column, size_b: Column, at_b: Column) -> Column:
    """equal sizes and times less than a millisecond apart; both times must be known."""
    near = F.abs(F.unix_micros(at_a) - F.unix_micros(at_b)) < 1000
    return F.coalesce((size_a == size_b) & near, F.lit(False))


def mark_missing(locations: DataFrame, seen: DataFrame, volume: str, prefix: str = "") -> DataFrame:
    """Online locations of a volume below a prefix that a scan has not seen (volume_uuid, relative_path) become missing."""
    from cutlight.functions.text import under_prefix

    mark = seen.select("volume_uuid", "relative_path").distinct().withColumn("_seen", F.lit(True))
    scope = (F.col("volume_uuid") == volume) & under_prefix(F.col("relative_path"), prefix) & (F.col("availability") == "online")
    joined = locations.join(mark, ["volume_uuid", "relative_path"], "left")
    return joined.withColumn("availability", F.when(scope & F.col("_seen").isNull(), "missing").otherwise(F.col("availability"))).drop("_seen").select(*locations.columns)


def mark_volumes(locations: DataFrame, online: DataFrame) -> DataFrame:
    """Locations follow their volume between online and offline; others stay as they are. online: volume_uuid."""
    here = online.select("volume_uuid").distinct().withColumn("_here", F.lit(True))
    follows = F.col("availability").isin("online", "offline")
    state = F.when(follows, F.when(F.col("_here"), "online").otherwise("offline")).otherwise(F.col("availability"))
    return locations.join(here, "volume_uuid", "left").withColumn("availability", state).drop("_here").select(*locations.columns)


def redundant_missing(locations: DataFrame) -> DataFrame:
    """The missing locations of assets that are also online or offline somewhere."""
    held = locations.where(F.col("availability").isin("online", "offline")).select("asset_id").distinct()
    return locations.where("availability = 'missing'").join(held, "asset_id", "left_semi")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def repair(child: DataFrame, checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Child rows that pass all checks (column, parent, key); null references pass."""
    for column, parent, key in checks:
        missing = child.select(column).distinct().where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
        child = child.join(missing, column, "left_anti")
    return child


def resolve_volume(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Path with the volume of the longest mount point that holds it, and the path relative to it.

    paths: path. mounts: mount, volume_uuid. Each path meets the mounts through its own
    ancestors, an equality join.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = paths.select("path", F.explode(ancestors).alias("mount"))
    m = mounts.select(F.when(F.col("mount") == "/", "").otherwise(F.regexp_replace("mount", "/+$", "")).alias("mount"), "volume_uuid")
    best = up.join(m, "mount").groupBy("path").agg(F.max_by(F.struct("volume_uuid", "mount"), F.length("mount")).alias("b"))
    return best.select("path", "b.volume_uuid", F.regexp_replace(F.expr("substring(path, length(b.mount) + 1)"), "^/+", "").alias("relative_path"))


def scan_outcomes(scan: DataFrame, locations: DataFrame, assets: DataFrame) -> DataFrame:
    """C4: what a scan found: unchanged, rebound, renamed, new_location or new_asset, per path.

    scan: volume_uuid, relative_path, file_size, modified_at, content_key.
    """
    at = locations.select("volume_uuid", "relative_path", F.col("asset_id").alias("at_asset"), F.col("file_size").alias("_s"), F.col("modified_at").alias("_m"))
    known = assets.select("content_key", F.col("asset_id").alias("same_asset")).groupBy("content_key").agg(F.min("same_asset").alias("same_asset"))
    lost = locations.where("availability = 'missing'").groupBy(F.col("asset_id").alias("same_asset")).agg(F.lit(True).alias("was_missing"))
    both = scan.join(at, ["volume_uuid", "relative_path"], "left").join(known, "content_key", "left").join(lost, "same_asset", "left")
    same = same_revision(F.col("file_size"), F.col("modified_at"), F.col("_s"), F.col("_m"))
    outcome = (
        F.when(F.col("at_asset").isNotNull() & same, "unchanged").when(F.col("same_asset").isNull(), "new_asset")
        .when(F.col("at_asset").isNotNull(), "rebound").when(F.col("was_missing"), "renamed").otherwise("new_location")
    )
    return both.select("volume_uuid", "relative_path", "content_key", F.coalesce("same_asset", "at_asset").alias("asset_id"), outcome.alias("outcome"))


def page_after(rows: DataFrame, row_id: str, last: int | None, size: int = 4096) -> DataFrame:
    """The next `size` rows by id after the last one seen (from the first on for None)."""
    return (rows if last is None else rows.where(F.col(row_id) > last)).orderBy(row_id).limit(size)


def moments_with_previews(moments: DataFrame, previews: DataFrame, most: int = 5000) -> DataFrame:
    """The first `most` moments by asset_id and start_seconds that have a preview (moment_id, path)."""
    return moments.join(previews, "moment_id").orderBy("asset_id", "start_seconds", "moment_id").limit(most)


def text_gate(text: Column, confidence: Column) -> Column:
    """recognised text counts from confidence 0.35 and two characters on."""
    return F.coalesce((confidence >= 0.35) & (F.length(F.trim(text)) >= 2), F.lit(False))


def best_labels(labels: DataFrame, moment: str, least: float = 0.3, most: int = 5) -> DataFrame:
    """the `most` surest labels (identifier, confidence) of each moment, of at least `least`."""
    w = Window.partitionBy(moment).orderBy(F.desc("confidence"), "identifier")
    return labels.where(F.col("confidence") >= least).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def speech_gate(start: Column, end: Column, quality: Column) -> Column:
    """a stretch of speech counts from one second and quality 0.5 on."""
    return F.coalesce((end - start >= 1.0) & (quality >= 0.5), F.lit(False))
