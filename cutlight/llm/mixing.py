"""Mixing sources to target weights by balanced sampling (the cube method).

Every document of a source is wanted equally often: whole copies first, then with the
probability that is left. The probabilities are moved through the null space of the
constraints, token total and number of documents, until each is 0 or 1 (flight phase).
That is done block by block, and at most two documents of each block stay undecided; these
go through further flights with each other until one block of a source is left. There
the flight ends with the last LANDING documents undecided, and they are decided
together so that the token total is met best (landing), which a small source needs: the
sizes of two documents alone may miss its share by a quarter.
"""

from __future__ import annotations

import importlib.util
import os
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlight.session import cut

#: Documents in a block of the flight phase.
BLOCK = 20_000
#: Documents of a source that are left for the landing: all their subsets are weighed.
LANDING = 14
#: Split pattern of the byte-level vocabularies in .tiktoken form, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, object] = {}


def find_tokenizer(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a vocabulary: the session's spark.cutlight.tokenizer, else the file `name` of an installed package of public vocabularies.

    Raises ValueError if there is neither. The path must exist on all executors.
    """
    named = spark.conf.get("spark.cutlight.tokenizer", None)
    if named:
        return named
    package = importlib.util.find_spec("public_tokenizers")
    for folder in package.submodule_search_locations if package else ():
        if os.path.exists(at := os.path.join(folder, name)):
            return at
    raise ValueError("set spark.cutlight.tokenizer to the path of a vocabulary file")


def token_counter(path: str):
    """A function from texts to their numbers of tokens, for a .json, .tiktoken or .model vocabulary."""
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _LOADED[path] = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        elif path.endswith(".tiktoken"):
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
            e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda texts: [len(e.encode_ordinary(x)) for x in texts]
        else:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]
    return _LOADED[path]


def count_tokens(text: Column, tokenizer: str) -> Column:
    """The number of tokens of whole texts; 0 for null."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return pd.Series(token_counter(tokenizer)(texts.fillna("").tolist()), dtype="int64")

    return count(text)


def source_key(source: Column) -> Column:
    """A source's name without regard to case and outer blanks; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), F.lit(""))


def flight(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Probabilities moved until at most `leave` (two or more) are neither 0 nor 1; sum(p) and sum(sizes * p) stay as they were."""
    p = p.astype(np.float64).copy()
    draws = rng.random(len(p) + 3)
    open_ = [k for k in range(len(p)) if 0 < p[k] < 1]
    hand, at = open_[:3], 3
    step = 0
    while len(hand) == 3 and len(hand) + len(open_) - at > leave:
        a, b, c = (float(sizes[k]) for k in hand)
        u = (b - c, c - a, a - b)
        if a == b == c:
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(hand, u) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(hand, u) if v)
        move = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        for k, v in zip(hand, u):
            p[k] += move * v
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        hand = [k for k in hand if 0 < p[k] < 1]
        while len(hand) < 3 and at < len(open_):
            hand.append(open_[at])
            at += 1
    return p


def land(sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The last undecided documents (at most LANDING) decided so that the size expected of them is met best, then their number."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    if len(open_):
        want, number = float(sizes[open_] @ p[open_]), float(p[open_].sum())
        subsets = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        out[open_] = subsets[np.lexsort((np.abs(subsets.sum(1) - number), np.abs(subsets @ sizes[open_] - want)))[0]]
    return out


def wanted_copies(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per source: target_share, max_repeats, has_docs, has_tokens, share (of the sources that have documents), copies wanted of each document.

    sizes: source, n_tokens. Without a total, the largest is taken at which every source
    can reach its share; with one, a source whose documents don't suffice is used to its cap.
    """
    held = sizes.groupBy("source").agg(F.count("*").alias("has_docs"), F.sum("n_tokens").alias("has_tokens"))
    aims = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    aims = aims.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = aims.join(held, "source", "left").withColumns({"has_docs": F.coalesce("has_docs", F.lit(0)), "has_tokens": F.coalesce("has_tokens", F.lit(0))})
    usable = both.where("has_tokens > 0").agg(F.sum("target_share").alias("all_shares"))
    both = both.join(F.broadcast(usable)).withColumn("share", F.when(F.col("has_tokens") > 0, F.col("target_share") / F.col("all_shares")).otherwise(0.0))
    most = both.where("share > 0").agg(F.min(F.col("has_tokens") * F.col("max_repeats") / F.col("share")).alias("total"))
    if total is not None:
        most = most.select(F.lit(float(total)).alias("total"))
    copies = F.when(F.col("has_tokens") > 0, F.least(F.col("total") * F.col("share") / F.col("has_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.join(F.broadcast(most)).withColumn("copies", copies).drop("all_shares", "total")


def _flights(seed: int, level: int, last: bool):
    """The flight of one block, and in the last round its landing."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        rng = np.random.default_rng([seed, level, int(pdf["block"].iloc[0]), zlib.crc32(pdf["source"].iloc[0].encode())])
        n = pdf["n_tokens"].to_numpy(np.float64)
        p = flight(n, pdf["p"].to_numpy(), rng, LANDING if last else 2)
        return pdf.assign(p=land(n, p) if last else p)[["doc_id", "source", "n_tokens", "whole", "p"]]

    return fly


def mix_sources(documents: DataFrame, targets: DataFrame, tokenizer: str, total: float | None = None, seed: int = 1, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """A selection (doc_id, source, n_tokens, copies) and its report by source.

    documents: doc_id, text, source. targets: source, target_share, max_repeats. The
    report has source, target_share, reached_share, n_docs (distinct), n_tokens (with
    copies) and most_copies, one row for each target.

    Sources are compared without regard to case and outer blanks. Documents without
    source or text, without tokens, or of a source that isn't a target, are not used; a
    repeated doc_id counts once (of different rows the one with the first source, then the shortest). A target without documents stays at 0 and the others
    share the total in proportion. No document is used more than max_repeats times. The
    same seed gives the same selection. Empty tables give an empty selection.
    """
    spark = documents.sparkSession
    sizes = cut(
        documents.select("doc_id", source_key(F.col("source")).alias("source"), count_tokens(F.col("text"), tokenizer).alias("n_tokens"))
        .where("doc_id is not null and source is not null and n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.*")
    )
    aims = cut(wanted_copies(sizes, targets, total))  # one row for each target
    docs = sizes.join(aims.select("source", "copies"), "source")
    whole = F.floor(F.col("copies") + 1e-9)
    rest = F.when(F.col("copies") - whole < 1e-9, 0.0).otherwise(F.col("copies") - whole)
    state = cut(docs.select("doc_id", "source", "n_tokens", whole.cast("int").alias("whole"), rest.alias("p")))
    schema = "doc_id bigint, source string, n_tokens bigint, whole int, p double"
    decided = state.where("p = 0 or p = 1")
    undecided = state.where("p > 0 and p < 1")
    level = 0
    while True:
        counts = undecided.groupBy("source").agg(F.count("*").alias("n"))
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
        last = counts.where(F.col("n") > block).isEmpty()
        placed = undecided.join(counts.select("source", blocks.alias("blocks")), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + level)), F.col("blocks"))).drop("blocks")

        flown = cut(placed.groupBy("source", "block").applyInPandas(_flights(seed, level, last), schema))
        decided = decided.unionByName(flown.where("p = 0 or p = 1"))
        if last:
            break
        undecided = flown.where("p > 0 and p < 1")
        level += 1
    chosen = cut(decided.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies")).where("copies > 0"))
    used = chosen.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    total_used = used.agg(F.sum("n_tokens").alias("total"))
    report = (
        aims.select("source", "target_share").join(used, "source", "left").join(F.broadcast(total_used))
        .select(
            "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"),
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )
    return chosen, report
