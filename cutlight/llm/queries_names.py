"""Query p1: rows of people that mean the same person or organisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlight.llm.names import entity_pairs, link_names
from cutlight.sources import read_table


def _linked(spark: SparkSession, d: str) -> DataFrame:
    people = read_table(spark, d)("people").where("is_named")
    return link_names(people.select(F.col("person_id").alias("row_id"), F.col("display_name").alias("name")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_pairs(_linked(spark, d)).select(F.col("a").alias("person_id_a"), F.col("b").alias("person_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each named person: its entity, and how many persons and spellings that has."""
    linked = _linked(spark, d)
    sizes = linked.groupBy("entity").agg(F.count_distinct("row_id").alias("n_people"), F.count_distinct("spelling").alias("n_spellings"))
    return linked.join(sizes, "entity").select(F.col("row_id").alias("person_id"), "entity", "n_people", "n_spellings")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
SQL: dict[str, str] = {}
