"""Evaluation texts leaking into training text.

The word n-grams of the evaluation items are hashed into a set that is sent to all
executors (its size is checked, see MOST_ITEM_WORDS); documents are scanned once,
window by window, and every hit is verified on the words themselves.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the items that are held at once (about 150 MB in a Python worker); beyond it the items are processed in several rounds.
MOST_ITEM_WORDS = 400_000

_WORD = re.compile(r"[a-z0-9]+")


def normalise(text: str) -> str:
    """Lower case, canonical decomposition, without combining marks."""
    low = text.lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """Runs of a-z and 0-9 after normalise."""
    return _WORD.findall(normalise(text))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit polynomial hash of every window of n word numbers."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _BASE + ids[k : k + len(out)]
    return out


class ItemIndex:
    """The n-grams of the items, for scanning texts."""

    def __init__(self, items: list[tuple[int, str | None]], n: int) -> None:
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.items = {i: words(t or "") for i, t in items}
        pairs: dict[int, set[tuple[int, int]]] = {}
        for i, w in self.items.items():
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.uint64)
            for at, h in enumerate(_window_hashes(ids, n).tolist()):
                pairs.setdefault(h, set()).add((i, at))
        self.places = pairs
        self.hashes = np.array(sorted(pairs), np.uint64)

    def scan(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """item_id -> spans (first word, word after the last) of the text that stand in the item."""
        w = words(text)
        number = self.vocabulary.get
        ids = np.fromiter((number(x, 0) for x in w), np.uint64, len(w))
        if len(ids) < self.n or not len(self.hashes):
            return {}
        h = _window_hashes(ids, self.n)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hits = np.flatnonzero(self.hashes[at] == h)
        found: dict[int, list[tuple[int, int]]] = {}
        for k in hits.tolist():
            window = w[k : k + self.n]
            for i in {i for i, j in self.places[int(h[k])] if self.items[i][j : j + self.n] == window}:
                spans = found.setdefault(i, [])
                if spans and spans[-1][1] >= k:
                    spans[-1] = (spans[-1][0], k + self.n)
                else:
                    spans.append((k, k + self.n))
        return found


def _rounds(items: DataFrame) -> list[list[tuple[int, str | None]]]:
    """Items on the driver in rounds of bounded size; the evaluation set is a stated query set."""
    rounds, now, size = [], [], 0
    for r in items.select("item_id", "text").where("item_id is not null").distinct().toLocalIterator():
        k = len(r[1] or "") // 2 + 1
        if now and size + k > MOST_ITEM_WORDS:
            rounds.append(now)
            now, size = [], 0
        now.append((r[0], r[1]))
        size += k
    return [*rounds, now] if now else rounds


def find_leaks(documents: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Spans of documents that stand in an evaluation item: doc_id, item_id, n_spans, n_words, longest.

    A document and an item come out together if at least n consecutive words of the
    item occur consecutively in the document. n_words counts the words of the document
    in such spans, longest the longest span. Null, blank and short texts match nothing, nor do rows without an id;
    whole texts are read however long; a document that is repeated is reported once,
    items with equal texts each for themselves. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, n_spans int, n_words int, longest int"
    found = None
    for some in _rounds(items):
        index = spark.sparkContext.broadcast(ItemIndex(some, n))

        def scan(batches, index=index):
            for b in batches:
                rows = []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item, spans in index.value.scan(text).items() if text else ():
                        long = [y - x for x, y in spans]
                        rows.append((i, item, len(spans), sum(long), max(long)))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "item_id", "n_spans", "n_words", "longest"]).astype({"doc_id": "int64", "item_id": "int64", "n_spans": "int32", "n_words": "int32", "longest": "int32"}), preserve_index=False)

        part = documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    # hits are few; of repeated documents the same row comes out again
    return found.groupBy("doc_id", "item_id").agg(F.max("n_spans").alias("n_spans"), F.max("n_words").alias("n_words"), F.max("longest").alias("longest"))


def remove_leaks(documents: DataFrame, items: DataFrame, n: int = 10, most_share: float = 0.5) -> DataFrame:
    """The documents without leaked passages: all columns, text cleaned, and n_removed.

    Spans that stand in an item are cut out of the text; a document of whose words more
    than most_share would go is removed whole. Texts without a leak stay as they are,
    null texts too (n_removed 0).
    """
    spark = documents.sparkSession
    found = None
    for some in _rounds(items):
        index = spark.sparkContext.broadcast(ItemIndex(some, n))

        def scan(batches, index=index):
            for b in batches:
                rows = []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    spans = [{"first": x, "past": y} for s in index.value.scan(text).values() for x, y in s] if text else []
                    if spans:
                        rows.append((key, spans))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])))], names=["_key", "spans"])

        part = documents.where("text is not null").select(F.sha2("text", 256).alias("_key"), "text").mapInArrow(scan, "_key string, spans array<struct<first:int,past:int>>")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.withColumn("n_removed", F.lit(0))
    # equal texts have equal spans, so a text is cleaned once however often it stands there
    of_text = found.distinct().groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("_spans"))

    @F.pandas_udf("text string, n_removed int, share double")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, own in zip(texts, spans):
            gone = {k for x in own for k in range(x["first"], x["past"])} if own is not None else ()
            out.append((cut_words(t, gone), len(gone), len(gone) / max(1, len(words(t)))) if gone else (t, 0, 0.0))
        return pd.DataFrame(out, columns=["text", "n_removed", "share"])

    kept = documents.withColumn("_key", F.sha2("text", 256)).join(of_text, "_key", "left").withColumn("_clean", clean("text", "_spans")).where(F.col("_clean.share") <= most_share)
    return kept.withColumns({"text": F.col("_clean.text"), "n_removed": F.col("_clean.n_removed")}).select(*documents.columns, "n_removed")


def cut_words(text: str, gone: set[int]) -> str:
    """text without the words whose numbers are in gone; what stands between two of them goes too."""
    marks = []  # for each character of the normalised text, the character of the text it comes from
    normal = []
    for k, c in enumerate(text):
        for x in normalise(c):
            normal.append(x)
            marks.append(k)
    found = list(_WORD.finditer("".join(normal)))
    keep, last, before = [], 0, -2
    for k, m in enumerate(found):
        if k in gone:
            if before != k - 1:
                keep.append(text[last : marks[m.start()]])
            last, before = marks[m.end() - 1] + 1, k
    keep.append(text[last:])
    return "".join(keep)
