import os

import numpy as np
import pytest

from cutlight.llm import mixing as mx
from tests.conftest import rows_of

VOCAB = "/opt/tokenizers/byte_bpe_50k.json"


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 500, 400).astype(float)
    p = mx.flight(n, np.full(400, 0.37), rng)
    assert ((p > 0) & (p < 1)).sum() <= 2 and abs(p.sum() - 148) < 1e-6 and abs(n @ p - 0.37 * n.sum()) < 1e-4
    done = mx.land(n, p)
    assert set(done.tolist()) <= {0.0, 1.0} and abs(n @ done - 0.37 * n.sum()) < 500
    same = mx.flight(np.full(9, 5.0), np.full(9, 0.5), rng)
    assert ((same > 0) & (same < 1)).sum() <= 2 and abs(same.sum() - 4.5) < 1e-9
    assert mx.flight(np.array([]), np.array([]), rng).size == 0


def test_landing_of_a_small_source():
    """A source of which four documents are wanted meets its tokens, not only within a document."""
    n = np.random.default_rng(5).integers(60, 400, 300).astype(float)
    p = mx.flight(n, np.full(300, 4 / 300), np.random.default_rng(1), mx.LANDING)
    assert ((p > 0) & (p < 1)).sum() <= mx.LANDING
    assert abs(n @ mx.land(n, p) - n.sum() * 4 / 300) < 25


def test_inclusion_is_unbiased():
    n = np.array([3.0, 5, 8, 13, 21, 34])
    hits = sum(mx.land(n, mx.flight(n, np.full(6, 0.5), np.random.default_rng(s))) for s in range(400)) / 400
    assert abs(hits.mean() - 0.5) < 0.06


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="vocabulary files absent")
def test_mix(table):
    rows = [(i, "palabra " * (i % 40 + 1), ("Big", " big ", "small", "none")[0 if i < 300 else 1 if i < 600 else 2 if i < 630 else 3]) for i in range(700)]
    rows += rows[:50] + [(9001, None, "big"), (9002, "", "big"), (9003, "x", None)]
    docs = table("doc_id bigint, text string, source string", *rows)
    targets = table("source string, target_share double, max_repeats int", ("big", 0.6, 1), ("small", 0.3, 4), ("empty", 0.1, 2))
    chosen, report = mx.mix_sources(docs, targets, VOCAB, block=64)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "small", "empty"} and got["empty"].n_docs == 0 and got["small"].most_copies == 4
    assert abs(got["big"].reached_share - 2 / 3) < 0.01 and abs(got["small"].reached_share - 1 / 3) < 0.01
    assert chosen.groupBy("doc_id").count().where("count > 1").count() == 0
    again, _ = mx.mix_sources(docs.repartition(7), targets, VOCAB, block=64)
    assert rows_of(chosen) == rows_of(again)
    assert mx.find_tokenizer(docs.sparkSession)
    few, few_report = mx.mix_sources(docs, targets, VOCAB, total=10**9)
    assert {r.source: r.most_copies for r in few_report.collect()} == {"big": 1, "small": 4, "empty": 0}
    none, _ = mx.mix_sources(docs.limit(0), targets, VOCAB)
    assert none.count() == 0


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="vocabulary files absent")
def test_tokenizers_agree():
    texts = ["Hola, ¿qué tal? I'm here 123", "", "a" * 3000]
    assert mx.token_counter(VOCAB)(texts) == mx.token_counter(VOCAB.replace(".json", ".tiktoken"))(texts)
    assert mx.token_counter("/opt/tokenizers/piece_bpe_32k.model")(texts)[1] == 0
