"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlight.functions.text import basename


def graded_hits(hits: DataFrame, judgements: DataFrame, tolerance: float = 30.0) -> DataFrame:
    """Each hit with the judgement that it meets best: case_id, rank_no, hit_id, judgement_id, grade (0 if none).

    hits: case_id, hit_id, rank_no, asset_name, start_seconds, end_seconds. judgements:
    case_id, judgement_id, asset, at_seconds, grade, tolerance_seconds. The files'
    names must agree without regard to folder and case; an instant must lie in the hit or
    within the tolerance of its start. The highest grade wins, then the first judgement.
    """
    h = hits.select("case_id", "hit_id", "rank_no", F.lower(basename(F.col("asset_name"))).alias("file"), "start_seconds", "end_seconds")
    j = judgements.select(
        "case_id", "judgement_id", F.lower(basename(F.col("asset"))).alias("file"), "at_seconds", F.coalesce("grade", F.lit(1)).alias("grade"),
        F.coalesce("tolerance_seconds", F.lit(tolerance)).alias("tol"),
    )
    inside = F.col("at_seconds").between(F.col("start_seconds"), F.col("end_seconds"))
    near = F.abs(F.col("start_seconds") - F.col("at_seconds")) <= F.col("tol")
    met = h.join(j, ["case_id", "file"]).where(F.col("at_seconds").isNull() | inside | near)
    best = met.groupBy("case_id", "hit_id").agg(F.max(F.struct("grade", (-F.col("judgement_id")).alias("j"))).alias("b"))
    return h.join(best, ["case_id", "hit_id"], "left").select(
        "case_id", "hit_id", "rank_no", (-F.col("b.j")).alias("judgement_id"), F.coalesce("b.grade", F.lit(0)).alias("grade")
    )


def _gain(grade: Column, rank: Column) -> Column:
    return F.when(grade > 0, (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)).otherwise(0.0)


def case_metrics(graded: DataFrame, judgements: DataFrame, cutoff: int = 10) -> DataFrame:
    """Per case first_rank, recall10, recall50, reciprocal_rank, ndcg10, n_hits, false_positive.

    Recall counts each judgement once, at its best rank. nDCG isn't clamped: several hits
    on one judgement all earn its gain while the ideal has it once, so it may exceed 1.
    """
    found = graded.where("judgement_id is not null").groupBy("case_id", "judgement_id").agg(F.min("rank_no").alias("r"))
    recall = found.groupBy("case_id").agg(F.count_if(F.col("r") <= 10).alias("in10"), F.count_if(F.col("r") <= 50).alias("in50"))
    dcg = graded.groupBy("case_id").agg(
        F.sum(F.when(F.col("rank_no") <= cutoff, _gain(F.col("grade"), F.col("rank_no"))).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("grade") > 0, F.col("rank_no"))).alias("first_rank"), F.count("*").alias("n_hits"),
    )
    w = Window.partitionBy("case_id").orderBy(F.desc("g"), "judgement_id")
    ideal = judgements.select("case_id", "judgement_id", F.coalesce("grade", F.lit(1)).alias("g")).withColumn("i", F.row_number().over(w))
    ideal = ideal.groupBy("case_id").agg(F.sum(F.when(F.col("i") <= cutoff, _gain(F.col("g"), F.col("i"))).otherwise(0.0)).alias("ideal"), F.count("*").alias("n_judged"))
    both = dcg.join(ideal, "case_id", "full").join(recall, "case_id", "left")
    share = lambda c: F.when(F.col("n_judged") > 0, F.coalesce(c, F.lit(0)) / F.col("n_judged")).otherwise(0.0)
    return both.select(
        "case_id", "first_rank", share("in10").alias("recall10"), share("in50").alias("recall50"),
        F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg10"),
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"), (F.col("n_judged").isNull() & (F.col("n_hits") > 0)).alias("false_positive"),
    )


def summary(cases: DataFrame) -> DataFrame:
    """Means over the positive cases, and the false positives among the rest; one row."""
    positive = F.col("is_positive")
    mean = lambda c: F.avg(F.when(positive, F.col(c)))
    return cases.agg(
        F.count("*").alias("n_cases"), mean("recall10").alias("recall10"), mean("recall50").alias("recall50"), mean("reciprocal_rank").alias("mrr"),
        mean("ndcg10").alias("ndcg10"), F.count_if(~positive & (F.col("n_hits") > 0)).alias("false_positives"),
    )


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """The element at position n / 2 of the sorted values; null if there is none.

    Approximate percentiles bound the few values among which it lies; these are ranked exactly, from the count of those below them.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    bounds = v.agg(F.count("*").alias("total"), F.percentile_approx("v", [0.499, 0.501], 100_000).alias("b"))
    placed = v.join(F.broadcast(bounds))
    below = placed.agg(F.count_if(F.col("v") < F.col("b")[0]).alias("below"))
    near = placed.where(F.col("v").between(F.col("b")[0], F.col("b")[1])).groupBy("v", "total").agg(F.count("*").alias("n")).join(F.broadcast(below))
    upto = F.col("below") + F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("upto", upto).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("v").alias("upper_median"))


def calibration(samples: DataFrame, score: str, relevant: str) -> DataFrame:
    """Hits and relevant hits by tenth of the score."""
    index = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col(score) * 10).cast("int")))
    return samples.groupBy((index / 10).alias("lower_bound")).agg(F.count("*").alias("hits"), F.count_if(F.col(relevant)).alias("relevant"))


def threshold_sweep(samples: DataFrame, score: str, relevant: str, low: int = 10, high: int = 80, step: float = 0.005) -> DataFrame:
    """Precision, recall and f1 for thresholds i * step, i from low to high.

    Samples are counted by the last threshold that they pass before the thresholds are
    accumulated, so that the grid multiplies a few counts, not the samples.
    """
    bucket = F.least(F.lit(high), F.floor(F.col(score) / step + 1e-9)).cast("int")
    counts = samples.where(F.col(score).isNotNull()).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col(relevant)).alias("p"))
    spark = samples.sparkSession
    total = counts.agg(F.sum("p").alias("all_p"))
    grid = spark.range(low, high + 1).select(F.col("id").cast("int").alias("i"))
    passed = grid.join(F.broadcast(counts), F.col("b") >= F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("p"), F.lit(0)).alias("tp"))
    precision = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0)
    recall = F.when(F.col("all_p") > 0, F.col("tp") / F.col("all_p")).otherwise(0.0)
    scored = passed.join(F.broadcast(total)).select((F.col("i") * step).alias("threshold"), precision.alias("precision"), recall.alias("recall"))
    return scored.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def changed_cases(before: DataFrame, now: DataFrame) -> DataFrame:
    """The cases whose first rank changed, a missing one included."""
    return before.select("case_id", F.col("first_rank").alias("rank_before")).join(now.select("case_id", F.col("first_rank").alias("rank_now")), "case_id").where(
        ~F.col("rank_before").eqNullSafe(F.col("rank_now"))
    )
