"""Inverted index and BM25 over text rows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlight.functions.text import fold, fold_text
from cutlight.session import cut, shuffle_width

K1, B = 1.2, 0.75
#: Weight of the text column, multiplied into the term frequency before saturation.
WEIGHT = 10.0
#: Documents up to which a prefix term keeps its wildcard.
BREADTH = 50_000


def text_rows(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """row_id, folded text and its number of words (dl) of the rows with a text that isn't blank."""
    rows = df.where(F.length(F.trim(text)) > 0).select(F.col(row_id).alias("row_id"), fold(text).alias("folded"))
    blanks = F.length("folded") - F.length(F.replace(F.col("folded"), F.lit(" "), F.lit("")))
    return rows.withColumn("dl", F.when(F.col("folded") == "", 0).otherwise(blanks + 1))


def postings(rows: DataFrame) -> DataFrame:
    """Term, row_id, tf, dl for each term of each row."""
    words = rows.select("row_id", "dl", F.explode(F.split("folded", " ")).alias("term")).where("term <> ''")
    return words.groupBy("term", "row_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


@dataclass(frozen=True)
class TextIndex:
    """A stored index: postings with positions in order of term, vocabulary, and one row of statistics."""

    postings: DataFrame
    vocabulary: DataFrame
    statistics: DataFrame


def build_index(rows: DataFrame) -> TextIndex:
    """The index of text_rows, as tables in the shared folder.

    Postings (term, row_id, tf, dl, positions) lie in files by ranges of term and row, sorted by term: a
    query reads only the row groups of its words or prefixes, and a word that a third of the rows has fills several files.
    """
    words = rows.select("row_id", "dl", F.posexplode(F.split("folded", " ")).alias("pos", "term")).where("term <> ''")
    posts = words.groupBy("term", "row_id").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("positions"))
    stored = cut(posts.repartitionByRange(shuffle_width(rows.sparkSession), "term", "row_id").sortWithinPartitions("term", "row_id"))
    words = cut(stored.groupBy("term").agg(F.count("*").alias("n_rows")))
    return TextIndex(stored, words, cut(rows.agg(F.count("*").alias("n_all"), F.avg("dl").alias("avgdl"))))


def search_index(index: TextIndex, patterns: list[str], weight: float = WEIGHT) -> DataFrame:
    """What bm25 gives, from a stored index: row_id and score.

    The words of all patterns are read in one pass over their postings. The words of a phrase
    have to stand side by side, which their positions tell; a prefix counts each word that starts with it.
    """
    asked = []  # pattern, place of the word in it, words in it, word, whether a prefix
    patterns = list(dict.fromkeys(p for p in patterns if fold_text(p)))
    for k, p in enumerate(patterns):
        parts = fold_text(p).split()
        asked += [(k, i, len(parts), w, p.endswith("*") and i == len(parts) - 1) for i, w in enumerate(parts)]
    if not asked:
        return index.postings.select("row_id", F.lit(0.0).alias("score")).limit(0)
    fits = [F.col("term").startswith(w) if prefix else F.col("term") == w for _, _, _, w, prefix in asked]
    hit = index.postings.where(reduce(lambda a, b: a | b, fits))
    marks = F.filter(F.array(*(F.when(f, F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(n).alias("words"))) for f, (k, i, n, _, _) in zip(fits, asked))), lambda x: x.isNotNull())
    hit = hit.withColumn("m", F.explode(marks)).select("row_id", "dl", "tf", "positions", "m.*")
    found = hit.where("words = 1").groupBy("row_id", "k").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    if any(n > 1 for _, _, n, _, _ in asked):
        placed = hit.where("words > 1").select("row_id", "k", "words", "dl", "i", F.explode("positions").alias("pos")).withColumn("at", F.col("pos") - F.col("i"))
        whole = placed.groupBy("row_id", "k", "words", "at").agg(F.count_distinct("i").alias("c"), F.first("dl").alias("dl")).where("c = words")
        found = found.unionByName(whole.groupBy("row_id", "k").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")))
    # one row for each pattern
    n = found.groupBy("k").agg(F.count("*").alias("n"))
    idf = F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    tf = F.col("tf") * weight
    part = F.when(idf <= 0, 1e-6).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.join(F.broadcast(n), "k").join(F.broadcast(index.statistics)).groupBy("row_id").agg(F.sum(part).alias("score"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """term, n_rows."""
    return rows.select(F.explode(F.array_distinct(F.split("folded", " "))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n_rows"))


def prefix_breadth(vocab: DataFrame, prefix: str) -> DataFrame:
    """A5: the sum of row counts over the terms that start with a prefix, an upper bound of the rows."""
    return vocab.where(F.col("term").startswith(fold_text(prefix))).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("breadth"))


def _matches(pattern: str):
    """How often a pattern (a word; a phrase; either as a prefix, with *) stands in the folded text, overlaps included."""
    parts = fold_text(pattern)
    if not parts:
        return F.lit(0)
    end = "" if pattern.endswith("*") else "(?= |$)"
    return F.regexp_count("folded", F.lit(f"(?<=^| )(?={re.escape(parts)}{end})"))


def bm25(rows: DataFrame, patterns: list[str], weight: float = WEIGHT) -> DataFrame:
    """row_id and score of the rows that match any pattern.

    rows: row_id, folded, dl. A pattern is a word, a phrase of consecutive words, or either
    with a trailing * for a prefix. Statistics are those of all rows, of whatever kind;
    a row counts once for a pattern however many expansions it holds. The matches of a
    query are found in one scan of the rows, and the few numbers of its patterns are
    aggregated in the same job and broadcast (one row).
    """
    patterns = list(dict.fromkeys(p for p in patterns if fold_text(p)))
    columns = {f"tf{k}": _matches(p) for k, p in enumerate(patterns)}
    found = rows.select("row_id", "dl", *(c.alias(k) for k, c in columns.items()))
    stats = found.agg(F.count("*").alias("n_all"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in columns))

    def part(c: str):
        n = F.col(f"n_{c}")
        idf = F.log((F.col("n_all") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        tf = F.col(c) * weight
        return F.when(F.col(c) > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    if not patterns:
        return found.select("row_id", F.lit(0.0).alias("score")).limit(0)
    some = reduce(lambda a, b: a | b, (F.col(c) > 0 for c in columns))
    return found.where(some).join(F.broadcast(stats)).select("row_id", reduce(lambda a, b: a + b, map(part, columns)).alias("score"))


def bm25_from_postings(posts: DataFrame, rows: DataFrame, terms: list[str], weight: float = WEIGHT) -> DataFrame:
    """R2 for plain words over a stored inverted index: reads only the postings of the terms."""
    stats = rows.agg(F.count("*").alias("n_all"), F.avg("dl").alias("avgdl"))
    hit = posts.where(F.col("term").isin([fold_text(t) for t in terms]))
    n = hit.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    tf = F.col("tf") * weight
    part = F.when(idf <= 0, 1e-6).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # one row for each term of the query
    return hit.join(F.broadcast(n), "term").join(F.broadcast(stats)).groupBy("row_id").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows with their rank, ties by row_id."""
    best = scored.orderBy(F.desc("score"), "row_id").limit(k)
    return best.withColumn("rank_no", F.row_number().over(Window.orderBy(F.desc("score"), "row_id")))


def grouped_top_k(scored: DataFrame, group: str, k: int) -> DataFrame:
    """K5: the k best rows of each group; the statistics behind the scores stay those of all rows."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "row_id")
    return scored.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


def label_frequency(labels: DataFrame, identifier: str, asset: str) -> DataFrame:
    """A3, A4: identifier, n_assets and rarity ln(N / n) / ln(N) of each label."""
    total = labels.agg(F.count_distinct(asset).alias("n_all"))
    counts = labels.groupBy(F.col(identifier).alias("identifier")).agg(F.count_distinct(asset).alias("n_assets"))
    n, c = F.col("n_all"), F.col("n_assets")
    rarity = F.when(n <= 1, 1.0).when(c >= n, 0.0).otherwise(F.log(n / c) / F.log(n))
    return counts.join(F.broadcast(total)).select("identifier", "n_assets", rarity.alias("rarity"))


def keep_wildcards(vocab: DataFrame, terms: list[str], budget: int = BREADTH) -> list[str]:
    """Terms as patterns; a word gets a * if it is the start of few enough rows' words, a phrase none."""
    folded = list(dict.fromkeys(f for f in map(fold_text, terms) if len(f) >= 2))
    words = [f for f in folded if " " not in f]
    if not words:
        return folded
    sums = vocab.agg(*(F.coalesce(F.sum(F.when(F.col("term").startswith(w), F.col("n_rows"))), F.lit(0)) for w in words)).first()  # one row
    breadth = dict(zip(words, sums))
    return [f + "*" if breadth.get(f, budget + 1) <= budget else f for f in folded]


def snippet(text, term: str, words: int = 12):
    """Up to `words` words around the first that equals the term (without regard to case and accents), which stands in « »; null without one."""
    parts = F.split(text, r"\s+")
    wanted = fold_text(term)
    at = F.array_position(F.transform(parts, fold), wanted).cast("int")
    start = F.greatest(F.lit(1), at - words // 2)
    shown = F.slice(F.transform(parts, lambda w: F.when(fold(w) == wanted, F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w)), start, F.lit(words))
    return F.when(at > 0, F.array_join(shown, " "))
