"""Queries p7 to p9: leaked evaluation items, mixtures of sources and reading levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlight.llm.leaks import find_leaks
from cutlight.llm.mixing import find_tokenizer, mix_sources, source_key
from cutlight.llm.reading import reading_levels
from cutlight.sources import read_table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d)
    return find_leaks(t("documents"), t("eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: the documents into which it leaked and the words of its longest passage."""
    t = read_table(spark, d)
    return find_leaks(t("documents"), t("eval_items")).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("longest").alias("longest"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per target: the share reached, the documents and tokens used (copies counted) and the most copies of a document."""
    t = read_table(spark, d)
    return mix_sources(t("documents"), t("mixture_targets"), find_tokenizer(spark))[1]


def p8_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Per target: whether no document is used too often, and whether the share is met to half a percentage point; and the documents at hand.

    A source without documents has to stay at 0, the others share the total.
    """
    t = read_table(spark, d)
    report = mix_sources(t("documents"), t("mixture_targets"), find_tokenizer(spark))[1]
    held = t("documents").where("text <> ''").groupBy(source_key(F.col("source")).alias("source")).agg(F.count_distinct("doc_id").alias("n_held"))
    caps = t("mixture_targets").groupBy(source_key(F.col("source")).alias("source")).agg(F.max("max_repeats").alias("max_repeats"))
    both = report.join(caps, "source").join(held, "source", "left").withColumn("n_held", F.coalesce("n_held", F.lit(0)))
    usable = both.where("n_held > 0").agg(F.sum("target_share").alias("all"))
    share = F.when(F.col("n_held") > 0, F.col("target_share") / F.col("all")).otherwise(0.0)
    return both.join(F.broadcast(usable)).select(
        "source", "n_held", (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"), (F.abs(F.col("reached_share") - share) <= 0.005).alias("share_met")
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d)
    return reading_levels(t("documents"), t("reading_labels")).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per source (without regard to case and blanks) and level: documents and mean difficulty."""
    t = read_table(spark, d)
    source = t("documents").select("doc_id", F.lower(F.trim("source")).alias("source")).distinct()
    levels = reading_levels(t("documents"), t("reading_labels"))
    return levels.join(source, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("n_docs"), F.avg("difficulty").alias("mean_difficulty"))


_WORDS = "list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'), lambda x: x <> '')"
_GRAMS = "unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) g"
_SQL = f"""
with w as (select doc_id, {_WORDS} w from (select distinct doc_id, text from documents) where text is not null),
i as (select item_id, {_WORDS} w from (select distinct item_id, text from eval_items) where text is not null),
ig as (select distinct item_id, {_GRAMS} from i where len(w) >= 10),
dg as (select doc_id, {_GRAMS} from w where len(w) >= 10)
"""

QUERIES = {"p7_found": p7_found, "p7_items": p7_items, "p8_report": p8_report, "p8_constraints": p8_constraints, "p9_found": p9_found, "p9_profile": p9_profile}
SQL = {
    "p7_found": _SQL + "select distinct doc_id, item_id from dg join ig using (g)",
    "p7_items": _SQL.rstrip() + ", windows as (select doc_id, unnest(range(1, len(w) - 8)) k, w from w where len(w) >= 10), hit as (select distinct doc_id, k, item_id from (select doc_id, k, array_to_string(w[k:k + 9], ' ') g from windows) join ig using (g)),"
    " steps as (select *, case when k - lag(k) over (partition by doc_id, item_id order by k) <= 10 then 0 else 1 end opens from hit), marked as (select *, sum(opens) over (partition by doc_id, item_id order by k rows unbounded preceding) r from steps),"
    " runs as (select doc_id, item_id, max(k) - min(k) + 10 words from marked group by doc_id, item_id, r),"
    " spans as (select doc_id, item_id, max(words) longest from runs group by 1, 2) select item_id, count(*) n_docs, cast(max(longest) as int) longest from spans group by 1",
    # p8_report is one of many selections that keep the constraints, so only these are said in SQL
    "p8_constraints": "with h as (select nullif(regexp_replace(lower(source), '^\\s+|\\s+$', '', 'g'), '') source, count(distinct doc_id) n from documents where text <> '' group by 1)"
    " select source, coalesce(n, 0) n_held, true cap_kept, true share_met from mixture_targets left join h using (source)",
}
