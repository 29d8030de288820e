"""Media files as rows: walking folders, types, content keys."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions by type, and the smallest sizes that count, in bytes.
EXTENSIONS = {
    "video": ("mov", "mp4", "m4v", "avi", "mkv", "mxf", "mts", "m2ts", "mpg", "mpeg", "webm", "braw", "r3d"),
    "image": ("jpg", "jpeg", "png", "heic", "heif", "tif", "tiff", "dng", "cr2", "cr3", "nef", "arw", "raf", "orf", "webp", "gif"),
    "audio": ("wav", "aiff", "aif", "m4a", "mp3", "caf", "flac"),
}
SMALLEST = {"image": 2 * 1024, "video": 64 * 1024, "audio": 64 * 1024}
WHOLE, SAMPLE = 8 * 1024 * 1024, 1024 * 1024


def media_type(path: Column) -> Column:
    """Video, image or audio by extension, else null."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.lit(None).cast("string")
    for name, exts in EXTENSIONS.items():
        kind = F.when(ext.isin(*exts), name).otherwise(kind)
    return kind


def scan_folder(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Path, file_size, modified_at, media_type of the media files below a folder.

    Hidden files and folders, and excluded folder names, are left out, as are files too
    small for their type. The content of the files is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at")).withColumn("media_type", media_type(F.col("path")))
    floor = F.lit(0)
    for name, n in SMALLEST.items():
        floor = F.when(F.col("media_type") == name, n).otherwise(floor)
    inside = F.expr("substring(path, length(regexp_extract(path, '^[a-z]+:', 0)) + 1)")
    hidden = F.exists(F.split(inside, "/"), lambda p: p.startswith(".") | p.isin(*excluded) if excluded else p.startswith("."))
    return rows.where(F.col("media_type").isNotNull() & (F.col("file_size") >= floor) & ~hidden)


def new_files(scan: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned files that are not known at this size and time. known: path, file_size, modified_at."""
    k = known.select("path", F.col("file_size").alias("_s"), F.unix_millis("modified_at").alias("_m")).distinct()
    s = scan.withColumn("_m", F.unix_millis("modified_at"))
    return s.join(k, (s.path == k.path) & (s.file_size == k._s) & (s._m == k._m), "left_anti").drop("_m")


def quick_key(path: str, size: int, duration_ms: int | None = None, codec: str | None = None) -> str:
    """A key of size, duration, codec and either the whole file (up to 8 MiB) or three samples of it."""
    h = hashlib.sha256(f"cutlight|{size}|{duration_ms or 0}|{codec or ''}|".encode())
    with open(path, "rb") as f:
        if size <= WHOLE:
            h.update(f.read())
        else:
            for at in (0, size // 2 - SAMPLE // 2, size - SAMPLE):
                f.seek(at)
                h.update(f.read(SAMPLE))
    return "q1:" + h.hexdigest()


def strong_key(path: str) -> str:
    """The hash of the whole file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(SAMPLE):
            h.update(part)
    return "s1:" + h.hexdigest()


def with_content_keys(files: DataFrame) -> DataFrame:
    """Files (path, file_size) with content_key; null for files that can't be read from an executor."""

    def one(path: str, size: int) -> str | None:
        try:
            p = path.removeprefix("file:")
            return quick_key("/" + p.lstrip("/"), size)
        except OSError:
            return None

    @F.pandas_udf(T.StringType())
    def key(path: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([one(p, s) for p, s in zip(path, size)])

    return files.withColumn("content_key", key("path", "file_size"))


def with_probe(files: DataFrame, probe, schema: str) -> DataFrame:
    """The hook for decoders and models: probe(path) -> tuple of the schema's further columns, or None."""
    names = [c.split()[0] for c in schema.split(",")]
    base = files.columns

    def run(batches):
        for pdf in batches:
            found = [probe(p) for p in pdf["path"]]
            extra = pd.DataFrame([f or (None,) * len(names) for f in found], columns=names, index=pdf.index)
            yield pd.concat([pdf[base], extra], axis=1)

    full = T.StructType(files.schema.fields + T.StructType.fromDDL(schema).fields)
    return files.mapInPandas(run, full)


