"""Catalogue tables as DataFrames.

A table is one Parquet file or a folder of part files named ``<name>.parquet``.
The files' own schema is used; nothing is inferred from values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_table(spark: SparkSession, folder: str):
    """A loader bound to one folder: ``t = read_table(spark, d); t("assets")``."""
    return lambda name: load(spark, folder, name)
