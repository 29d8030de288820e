"""Reading level of each document.

Interpolated word n-gram models (Witten-Bell, bigrams over unigrams over a uniform
rest), one for each level, are trained on labelled documents: over all words, and over
the text with all but the frequent words made one (what binds the sentences
together). The surprisals of a whole document under each of them, their distribution over the
words and the level that they make likeliest, and the length of the sentences give one
difficulty score, which isotonic regression maps to the levels 1 to 5.

Models and map are fitted on at most ``most_labelled`` labelled documents, those with
the smallest hash of doc_id, with all n-grams of their texts; scoring covers all documents. In
fitting, a document's surprisal comes from models that haven't seen its fold.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 5
#: Parts of the labelled documents; a document's fitting features come from models of the other parts, which must be near in size to all of them.
FOLDS = 8
#: Bound of the labelled documents used for fitting.
MOST_LABELLED = 20_000
#: Share of all words from which a word counts as frequent.
FREQUENT = 2e-4
#: Words in a sentence beyond which a text counts as unpunctuated.
UNPUNCTUATED = 70
#: Tokens that are scored at once.
TOKENS = 300_000
#: How much of a document's log likelihood counts when levels are weighed against each other: words depend on each other.
TEMPERS, FREQUENT_TEMPERS = (0.1, 0.3, 1.0), (0.2, 0.5, 1.0)

_NOISE = re.compile(r"&\w+;|\[?\d+:\d+(?::\d+)?\]?|\w+_\d+\.\w+|\w+(?:/\w+)+")
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|[.!?]+")
_WORD, _END = 0, 1  # numbers of an unknown word and of a sentence's end
_NOTHING = "\0"  # no token


def tokens(text: str | None) -> list[str]:
    """Words in lower case and "." for each sentence's end; entities, timecodes and file names are left out."""
    return ["." if t[0] in ".!?" else t for t in _TOKEN.findall(_NOISE.sub(" ", (text or "").lower()))]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least-squares non-decreasing fit of y over sorted x (pooled neighbours)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v in y[order].tolist():
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
    return x[order], np.repeat([s / n for s, n in blocks], [int(n) for _, n in blocks])


def level_bounds(score: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each k from 1 to 4 the score from which a level above k is likelier than not, by isotonic regression."""
    bounds = []
    for k in range(1, LEVELS):
        x, p = isotonic(score, (level > k).astype(float))
        j = int(np.searchsorted(p, 0.5))
        bounds.append(-math.inf if j == 0 else math.inf if j == len(x) else (x[j - 1] + x[j]) / 2)
    return np.array(bounds)


class Grams:
    """Log probabilities of numbered tokens under the models of all levels.

    n1: token x level counts. n2: counts of the pairs first, second by level.
    """

    def __init__(self, n1: np.ndarray, first: np.ndarray, second: np.ndarray, n2: np.ndarray) -> None:
        v = len(n1)
        total, kinds = n1.sum(0), (n1 > 0).sum(0)
        p1 = (n1 + (kinds + 1) / (v + 50_000)) / (total + kinds + 1)
        self.log1 = np.log(p1).astype(np.float32)
        history, after = np.zeros((v, LEVELS)), np.zeros((v, LEVELS))
        np.add.at(history, first, n2)
        np.add.at(after, first, (n2 > 0).astype(float))
        both = history + after
        self.log_rest = np.where(both > 0, np.log(np.maximum(after, 1e-9) / np.maximum(both, 1e-9)), 0.0).astype(np.float32)
        p2 = np.where(both[first] > 0, (n2 + after[first] * p1[second]) / np.maximum(both, 1e-9)[first], p1[second])
        key = first.astype(np.int64) << 32 | second
        order = np.argsort(key)
        self.keys, self.log2 = key[order], np.log(p2[order]).astype(np.float32)

    def bigrams(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Log probabilities of tokens, given the ones before them."""
        key = before.astype(np.int64) << 32 | now
        out = self.log_rest[before] + self.log1[now]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[hit] = self.log2[at[hit]]
        return out


class NgramModels:
    """The models of all words and of frequent words, from the counts of n-grams.

    words: numbered from 2 on. n1: counts of those numbers by level; first, second, n2: pairs of numbers and their counts by level.
    """

    def __init__(self, words: list[str], n1: np.ndarray, first: np.ndarray, second: np.ndarray, n2: np.ndarray) -> None:
        self.number = {w: k + 2 for k, w in enumerate(words)}
        self.number["."] = _END
        self.whole = Grams(n1, first, second, n2)
        # the same counts with all but the frequent words made one
        often = n1.sum(1) >= FREQUENT * max(1.0, n1.sum())
        often[[_WORD, _END]] = False
        self.frequent = np.where(often, np.cumsum(often) + 1, _WORD)
        self.frequent[_END] = _END
        size = int(self.frequent.max()) + 1
        bound = np.zeros((max(2, size), LEVELS))
        np.add.at(bound, self.frequent, n1)
        key, to = np.unique(self.frequent[first].astype(np.int64) << 32 | self.frequent[second], return_inverse=True)
        pairs = np.zeros((len(key), LEVELS))
        np.add.at(pairs, to.reshape(-1), n2)
        self.skeleton = Grams(bound, key >> 32, key & 0xFFFFFFFF, pairs)

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the texts that have words, and what the score of each is made of."""
        at, rows, held, size = [], [], [], 0
        for k, text in enumerate(texts):
            t = tokens(text)
            if any(x != "." for x in t):
                at.append(k)
                held.append(t)
                size += len(t)
            if held and (size >= TOKENS or k == len(texts) - 1):
                rows.append(self._features(held))
                held, size = [], 0
        if held:
            rows.append(self._features(held))
        return np.array(at, np.int64), np.concatenate(rows) if rows else np.zeros((0, 0))

    def _features(self, docs: list[list[str]]) -> np.ndarray:
        number = self.number.get
        ids = np.fromiter((number(x, _WORD) for t in docs for x in t), np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in docs])
        end = ids == _END
        n_words = np.bincount(doc[~end], minlength=len(docs))
        n_ends = np.bincount(doc[end], minlength=len(docs))
        bare = (n_ends == 0) | (n_words > UNPUNCTUATED * n_ends)

        def sums(x, d):
            return np.stack([np.bincount(d, x[:, k], minlength=len(docs)) for k in range(x.shape[1])], 1)

        def likeliest(total, tempers):
            """The mean level under the weights that the log likelihoods give, for each temper."""
            out = []
            for t in tempers:
                z = np.exp((total - total.max(1, keepdims=True)) * t)
                out.append(z @ np.arange(1, LEVELS + 1) / z.sum(1))
            return np.stack(out, 1)

        def centred(mean):
            return mean - mean.mean(1, keepdims=True)

        one = self.whole.log1[ids[~end]]
        words = doc[~end]
        run = ~(end & bare[doc])  # the ends in an unpunctuated text say nothing
        r, d = ids[run], doc[run]
        start = np.r_[True, d[1:] != d[:-1]]
        before = np.where(start, _END, np.r_[_END, r[:-1]])
        n_run = np.maximum(1, np.bincount(d, minlength=len(docs)))[:, None]
        one_sum, two_sum = sums(one, words), sums(self.whole.bigrams(before, r), d)
        f, fb = self.frequent[r], self.frequent[before]
        sk_one, sk_two = sums(self.skeleton.log1[f], d), sums(self.skeleton.bigrams(fb, f), d)
        apart = one[:, -1] - one[:, 0]
        in_order = apart[np.lexsort((apart, words))]
        first = np.cumsum(n_words) - n_words
        spread = []
        for q in (0.1, 0.25, 0.5, 0.75, 0.9):
            place = q * (n_words - 1)
            low = np.floor(place).astype(np.int64)
            a, b = in_order[first + low], in_order[first + np.minimum(low + 1, n_words - 1)]
            spread.append(a + (b - a) * (place - low))
        mean = np.bincount(words, apart, minlength=len(docs)) / n_words
        length = np.where(bare, 0.0, np.log(n_words / np.maximum(1, n_ends)))
        x = np.column_stack([
            centred(one_sum / n_words[:, None]), centred(two_sum / n_run), centred(sk_one / n_run), centred(sk_two / n_run), np.stack(spread, 1), mean, mean**2, length,
            likeliest(one_sum, TEMPERS), likeliest(two_sum, TEMPERS), likeliest(sk_one, FREQUENT_TEMPERS), likeliest(sk_two, FREQUENT_TEMPERS), np.ones(len(docs)),
        ])
        return np.column_stack([x, x * bare[:, None]])


class ReadingModel:
    """Features to score to level."""

    def __init__(self, models: NgramModels, mean, scale, weights, bounds) -> None:
        self.models, self.mean, self.scale, self.weights, self.bounds = models, mean, scale, weights, bounds

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and levels; a text without words is as easy as can be."""
        score = np.ones(len(texts))
        at, f = self.models.features(texts)
        if len(at):
            score[at] = np.column_stack([(f - self.mean) / self.scale, np.ones(len(f))]) @ self.weights
        return score, 1 + (score[:, None] >= self.bounds).sum(1)


def _labelled(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled documents: doc_id, text, fold, votes (number of annotators by level)."""
    votes = (
        labels.where("reading_level between 1 and 5 and doc_id is not null").select("doc_id", "annotator", "reading_level").distinct()
        .groupBy("doc_id").agg(F.array(*(F.count(F.when(F.col("reading_level") == k, 1)).cast("int") for k in range(1, LEVELS + 1))).alias("votes"))
    )
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most `most` rows, so small enough to broadcast
    return documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(FOLDS)).cast("int"))


def _median(votes: list[int]) -> int:
    total, seen = sum(votes), 0
    for k, n in enumerate(votes):
        seen += n
        if 2 * seen >= total:
            return k + 1
    return 3


def _count_ngrams(batches):
    for b in batches:
        counts: dict[tuple[str, str, int, int], int] = {}
        for text, votes, fold in zip(*(b.column(k).to_pylist() for k in range(3))):
            level = _median(votes)
            before = "."
            for w in tokens(text):
                for g in (("", w), (before, w)):
                    k = (*g, fold, level)
                    counts[k] = counts.get(k, 0) + 1
                before = w
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()))],
            names=["before", "word", "fold", "level", "n"],
        )


def fit_reading_model(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> ReadingModel | None:
    """The model, or None if no labelled document has a text with words."""
    spark = documents.sparkSession
    sample = _labelled(documents, labels, most_labelled)
    # all n-grams of at most most_labelled texts
    grams = (
        sample.select("text", "votes", "fold").mapInArrow(_count_ngrams, "before string, word string, fold int, level int, n bigint")
        .groupBy("before", "word").agg(
            *(F.sum(F.when((F.col("fold") == f) & (F.col("level") == k), F.col("n")).otherwise(0)).cast("int").alias(f"c{f}_{k}") for f in range(FOLDS) for k in range(1, LEVELS + 1)),
        ).toPandas()
    )
    if not len(grams):
        return None
    by_fold = grams.iloc[:, 2:].to_numpy(np.float32).reshape(len(grams), FOLDS, LEVELS)
    single = (grams["before"] == "").to_numpy()
    words = sorted(set(grams["word"][single]) - {"."})
    index = pd.Index([_NOTHING, ".", *words])
    n1 = np.zeros((len(index), FOLDS, LEVELS))
    n1[index.get_indexer(grams["word"][single])] = by_fold[single]
    first, second = index.get_indexer(grams["before"][~single]), index.get_indexer(grams["word"][~single])
    n2 = by_fold[~single]
    of = lambda c1, c2: NgramModels(words, c1, first, second, c2)
    held_out = [spark.sparkContext.broadcast(of(n1.sum(1) - n1[:, f], n2.sum(1) - n2[:, f])) for f in range(FOLDS)]

    def featured(batches):
        for b in batches:
            text, votes, fold, ids = (b.column(k).to_pylist() for k in range(4))
            for f in range(FOLDS):
                own = [k for k, x in enumerate(fold) if x == f]
                at, x = held_out[f].value.features([text[k] for k in own])
                kept = [own[k] for k in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.tolist(), pa.list_(pa.float64())), pa.array([votes[k] for k in kept], pa.list_(pa.int32())), pa.array([ids[k] for k in kept], pa.int64())],
                    names=["f", "votes", "doc_id"],
                )

    rows = sample.select("text", "votes", "fold", "doc_id").mapInArrow(featured, "f array<double>, votes array<int>, doc_id bigint").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("doc_id")
    x = np.stack(rows["f"].to_numpy())
    votes = np.stack(rows["votes"].to_numpy())
    y = votes @ np.arange(1, LEVELS + 1) / votes.sum(1)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    ridge = np.eye(z.shape[1]) * (1 + 400 / len(x))
    ridge[-1, -1] = 1e-6
    weights = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    each = [(s, k + 1) for s, v in zip(z @ weights, votes) for k in range(LEVELS) for _ in range(v[k])]
    bounds = level_bounds(np.array([s for s, _ in each]), np.array([k for _, k in each]))
    return ReadingModel(of(n1.sum(1), n2.sum(1)), mean, scale, weights, bounds)


def reading_levels(documents: DataFrame, labels: DataFrame, least_words: int = 10, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, difficulty (score, about 1 to 5) and reading_level (1 to 5) of each document.

    Documents with a null id or text, or fewer than least_words words divided by white
    space, are left out; whole texts are read, however long. A document whose words are all
    foreign to the models is judged by the length of its sentences alone.
    Repeated documents come out once. Null labels, and repeated labels of one annotator,
    don't count. Without any usable label the level and difficulty are null. Empty
    tables give an empty result; further columns are ignored.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, difficulty double, reading_level int"
    model = spark.sparkContext.broadcast(fit_reading_model(documents, labels, most_labelled))

    def judge(batches):
        m = model.value
        for b in batches:
            text = b.column(1).to_pylist()
            at = [k for k, t in enumerate(text) if t and len(t.split()) >= least_words]
            score, level = m.judge([text[k] for k in at]) if m else ([None] * len(at), [None] * len(at))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())).cast(pa.int64()), pa.array(score, pa.float64()), pa.array(level, pa.int32())], names=["doc_id", "difficulty", "reading_level"])

    found = documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(judge, schema)
    return found.groupBy("doc_id").agg(F.max("difficulty").alias("difficulty"), F.max("reading_level").alias("reading_level"))
