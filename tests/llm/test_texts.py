import random

import numpy as np

from cutlight.llm.leaks import cut_words, find_leaks, remove_leaks, words
from cutlight.llm import leaks as lk
from cutlight.llm.reading import fit_reading_model, isotonic, level_bounds, reading_levels, tokens
from tests.conftest import rows_of

D, I = "doc_id bigint, text string, item_id int", "item_id bigint, text string, set_name string"
ITEM = "Uno dos tres cuatro cinco seis siete ocho nueve diez once doce"


def test_leaks(table):
    docs = table(
        D, (1, "xx " + ITEM.upper() + " yy", 0), (2, "uno dós tres, cuatro-cinco seis siete ocho nueve diez", 0), (3, "uno dos tres cuatro cinco seis siete ocho nueve", 0), (4, None, 0), (5, "", 0),
        (6, "a " * 60_000 + ITEM, 0), (7, "dos tres cuatro cinco seis siete ocho nueve diez X once doce", 0), (1, "xx " + ITEM.upper() + " yy", 0),
    )
    items = table(I, (10, ITEM, "s"), (11, ITEM, "s"), (12, "corto", "s"), (13, None, "s"), (10, ITEM, "s"))
    assert rows_of(find_leaks(docs, items).select("doc_id", "item_id", "longest")) == [(1, 10, 12), (1, 11, 12), (2, 10, 10), (2, 11, 10), (6, 10, 12), (6, 11, 12)]
    assert find_leaks(docs, items.limit(0)).count() == 0 == find_leaks(docs.limit(0), items).count()


def test_leaks_brute_force(table):
    rnd = random.Random(5)
    vocab = "abcdefg"
    docs = [(i, " ".join(rnd.choices(vocab, k=60)), 0) for i in range(30)]
    items = [(i, " ".join(rnd.choices(vocab, k=30)), "s") for i in range(10)]
    want = set()
    for d, t, _ in docs:
        for i, s, _ in items:
            a, b = t.split(), s.split()
            if {tuple(a[k : k + 3]) for k in range(58)} & {tuple(b[k : k + 3]) for k in range(28)}:
                want.add((d, i))
    assert set(rows_of(find_leaks(table(D, *docs), table(I, *items), n=3).select("doc_id", "item_id"))) == want


def test_removal(table):
    docs = table(D, (1, "Antes: " + " ".join(f"w{i}" for i in range(30)) + ". " + ITEM + ". Después, más.", 7), (2, "limpio", 7), (3, ITEM, 7), (4, None, 7))
    got = {r.doc_id: r for r in remove_leaks(docs, table(I, (1, ITEM, "s"))).collect()}
    assert set(got) == {1, 2, 4} and got[1].n_removed == 12 and "tres" not in got[1].text and got[1].text.endswith("Después, más.") and got[2].text == "limpio" and got[1].item_id == 7
    assert cut_words("Ä b Ç d", {1, 2}) == "Ä  d" and words("Ärzte&nbsp;ISBN-10") == ["arzte", "nbsp", "isbn", "10"]


def test_rounds_of_items(table, monkeypatch):
    """Items beyond the bound are searched in rounds, with the same result."""
    monkeypatch.setattr(lk, "MOST_ITEM_WORDS", 40)
    docs = table(D, (1, "x " + ITEM + " y " + ITEM.replace("tres", "otro"), 7), (2, "b " * 30 + ITEM, 7), (2, "b " * 30 + ITEM, 7))
    items = table(I, (1, ITEM, "s"), (2, "b " * 40, "s"), (3, ITEM.replace("tres", "otro"), "s"))
    assert rows_of(find_leaks(docs, items).select("doc_id", "item_id")) == [(1, 1), (1, 3), (2, 1), (2, 2)]
    assert rows_of(remove_leaks(docs, items, most_share=1.0).select("doc_id", "n_removed")) == [(1, 24), (2, 42), (2, 42)]


def test_isotonic():
    x, f = isotonic(np.array([3.0, 1, 2, 4]), np.array([1.0, 0, 2, 3]))
    assert list(x) == [1, 2, 3, 4] and list(f) == [0, 1.5, 1.5, 3]
    assert level_bounds(np.arange(10.0), np.repeat([1, 5], 5)).tolist() == [4.5] * 4


def corpus(n=260, seed=1):
    rnd = random.Random(seed)
    easy, hard = [f"ee{chr(97 + i)}" for i in range(20)], [f"hh{chr(97 + i)}" for i in range(20)]
    out = []
    for i in range(n):
        level = i % 5 + 1
        text = []
        for _ in range(12):
            text += [rnd.choice(hard if rnd.random() < (level - 1) / 4 else easy) for _ in range(3 + 2 * level)] + ["."]
        out.append((i, " ".join(text), level))
    return out


def test_reading_levels(table):
    docs = corpus()
    labels = [(i, f"a{k}", None if i % 17 == 0 else v) for i, _, v in docs[:200] for k in (1, 2)]
    df = table("doc_id bigint, text string, reading_level int", *docs, (900, "too short", 1), (901, None, 1), (902, "ee" * 9 + " x" * 5000, 1), (0, docs[0][1], 1))
    lab = table("doc_id bigint, annotator string, reading_level int", *labels, *labels[:20], (None, "a1", 3), (77_777, "a1", 2))
    got = dict(rows_of(reading_levels(df, lab).select("doc_id", "reading_level")))
    assert set(got) == set(range(260)) | {902}
    assert np.mean([got[i] == v for i, _, v in docs[200:]]) > 0.8  # held out
    assert rows_of(reading_levels(df, lab.limit(0)).select("reading_level").distinct()) == [(None,)]
    assert reading_levels(df.limit(0), lab).count() == 0 and fit_reading_model(df.limit(0), lab) is None


def test_tokens():
    assert tokens("El Río &nbsp; 1:02:03 A_12.mov corre?! Sí") == ["el", "río", "corre", ".", "sí"] and tokens(None) == []
