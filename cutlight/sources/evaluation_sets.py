"""Evaluation sets and reports as JSON."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "name string, library string, defaultToleranceSeconds double, cases array<struct<id string, query string, category string, "
    "cluster string, lang string, language string, expectedAssets array<string>, expect string, expectation string, "
    "relevant array<struct<asset string, at double, grade int, toleranceSeconds double>>>>"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case: set_name, case_id, query, category, language, expectation, tolerance, relevant."""
    sets = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    c = sets.select("name", F.coalesce("defaultToleranceSeconds", F.lit(30.0)).alias("tolerance"), F.explode("cases").alias("c"))
    return c.select(
        F.col("name").alias("set_name"), F.col("c.id").alias("case_id"), "c.query", "c.category", F.coalesce("c.language", "c.lang").alias("language"),
        F.coalesce("c.expectation", "c.expect", F.lit("any")).alias("expectation"), "tolerance",
        F.concat(
            F.coalesce("c.relevant", F.array().cast("array<struct<asset:string,at:double,grade:int,toleranceSeconds:double>>")),
            F.transform(F.coalesce("c.expectedAssets", F.array().cast("array<string>")), lambda a: F.struct(a.alias("asset"), F.lit(None).cast("double").alias("at"), F.lit(1).alias("grade"), F.lit(None).cast("double").alias("toleranceSeconds"))),
        ).alias("relevant"),
    )


def judgements(cases: DataFrame) -> DataFrame:
    """case_id, judgement_id (position), asset, at_seconds, grade (1 by default), tolerance_seconds."""
    j = cases.select("case_id", "tolerance", F.posexplode("relevant").alias("judgement_id", "r"))
    return j.select("case_id", "judgement_id", "r.asset", F.col("r.at").alias("at_seconds"), F.coalesce("r.grade", F.lit(1)).alias("grade"), F.coalesce("r.toleranceSeconds", "tolerance").alias("tolerance_seconds"))


def write_report(metrics: DataFrame, path: str, **about: str) -> None:
    """The cases of a report, one row each, as one JSON document with sorted keys."""
    cases = [r.asDict(recursive=True) for r in metrics.orderBy("case_id").toLocalIterator()]
    Path(path).write_text(json.dumps(about | {"cases": cases}, indent=2, sort_keys=True, default=str) + "\n")
