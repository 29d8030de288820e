import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from cutlight.functions import text as tx
from cutlight.operators import text_search as ts

TEXTS = [
    "El Río corre y la cámara graba la noche", "camera on the red car", "Noche de noche, noche!", "a red  car; red car again", "", None, "   ", "camión rojo", "__ ??",
    "the camera and the cameraman", "manera de trabajar", "mano derecha",
]


@pytest.fixture
def rows(table):
    return ts.text_rows(table("id bigint, text string, dl int", *((i, t, 9) for i, t in enumerate(TEXTS))), "id", "text")


def scores(df):
    return {r.row_id: r.score for r in df.collect()}


def fts(pattern):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text, tokenize='unicode61 remove_diacritics 2')")
    for i, t in enumerate(TEXTS):
        if t is not None and t.strip():
            con.execute("insert into t(rowid, text) values (?, ?)", (i, tx.fold_text(t)))
    return {i: -s for i, s in con.execute("select rowid, bm25(t, 10.0) from t where t match ?", (pattern,))}


@pytest.mark.parametrize("patterns,match", [(["noche"], '"noche"'), (["noche", "car"], '"noche" OR "car"'), (["cam*"], '"cam"*'), (["red car"], '"red car"'), (["cámara", "red car", "ro*"], '"camara" OR "red car" OR "ro"*')])
def test_bm25_matches_fts(rows, patterns, match):
    got, want = scores(ts.bm25(rows, patterns)), fts(match)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def test_bm25_edges(rows, table):
    assert scores(ts.bm25(rows, [])) == scores(ts.bm25(rows, ["!!"])) == {}
    assert scores(ts.bm25(ts.text_rows(table("id bigint, text string"), "id", "text"), ["x"])) == {}
    plain = scores(ts.bm25(rows, ["noche", "camera"]))
    index = scores(ts.bm25_from_postings(ts.postings(rows), rows, ["noche", "camera"]))
    assert plain.keys() == index.keys() and all(math.isclose(plain[k], index[k]) for k in plain)


def test_prefixes(table):
    rows = ts.text_rows(table("id bigint, text string", *[(i, "manera de trabajar") for i in range(45)], *[(100 + i, "mano derecha") for i in range(5)]), "id", "text")
    v = ts.vocabulary(rows)
    assert [ts.prefix_breadth(v, p).first()[0] for p in ("man", "manera", "zzz")] == [50, 45, 0]
    assert ts.keep_wildcards(v, ["man", "derecha", "x", "mano derecha"], budget=46) == ["man", "derecha*", "mano derecha"]


def test_grouped_equals_separate(table, rows):
    kinds = table("row_id bigint, kind string", *((i, "ab"[i % 2]) for i in range(len(TEXTS))))
    s = ts.bm25(rows, ["noche", "red", "cam*"]).join(kinds, "row_id")
    both = {(r.kind, r.row_id, r.rank_no) for r in ts.grouped_top_k(s, "kind", 2).collect()}
    assert both == {(k, r.row_id, r.rank_no) for k in "ab" for r in ts.top_k(s.where(F.col("kind") == k), 2).collect()}


def test_fold(table):
    df = table("t string", *((t,) for t in ["Ámbar_ÑU", "été", "a--b", None, "", "ŽLUŤ 9"]))
    assert [r[0] for r in df.select(tx.fold("t")).collect()] == ["ambar nu", "ete", "a b", None, "", "zlut 9"]
    assert [tx.fold_text(t) for t in ("Ámbar_ÑU", "ŽLUŤ 9")] == ["ambar nu", "zlut 9"]


def test_names(table):
    df = table("n string", ("Jorge Álvarez",), ("Marta Gonzalez",), ("",), (None,))
    sim = lambda q: [r[0] for r in df.select(tx.name_similarity(F.lit(q), F.col("n"))).collect()]
    assert sim("jorge alvarez")[0] == 1 and sim("alvarez")[0] == 1
    a, b, empty, null = sim("Alvares")
    assert a > 0.62 > b and empty == 0 and null is None or null == 0
    assert [r[0] for r in df.select(tx.name_overlap(F.lit("donde sale jorge"), F.col("n"))).collect()][:2] == [0.5, 0]
    assert df.select(tx.trigrams("n")).first()[0][:2] == ["jor", "org"]


def test_small_functions(table):
    df = table("s double", (0.0,), (59.6,), (3600.0,), (-1.0,), (float("nan"),), (None,))
    assert [r[0] for r in df.select(tx.timecode(F.col("s"))).collect()] == ["00:00", "01:00", "1:00:00", "00:00", "00:00", "00:00"]
    p = table("p string", ("a/b",), ("/a",), ("a/../b",), ("",), ("ab",), (None,))
    assert [r[0] for r in p.select(tx.safe_path(F.col("p"))).collect()] == [True, False, False, False, True, False]
    assert [r[0] for r in p.select(tx.under_prefix(F.col("p"), "a/")).collect()][:5] == [True, False, True, False, False]
    assert table("t string", ("un vaso 2024:01:02",)).select(ts.snippet(F.col("t"), "vaso", 2)).first()[0] in ("un «vaso»", "«vaso» 2024:01:02")
    d = table("t string", ("2024-05-06T07:08:09",), ("2024:05:06 07:08:09",), ("x",)).select(tx.parse_date(F.col("t")).alias("d")).collect()
    assert d[0].d == d[1].d and d[2].d is None


def test_coverage(table):
    df = table("t string, p int", ("La Cámara roja", 0), ("nada", 10))
    c = tx.term_coverage(F.col("t"), ["camara", "azul", "x"])
    assert [tuple(r) for r in df.select(c, tx.text_confidence(c, F.col("p"))).collect()] == [(0.5, 0.5), (0.0, 0.0)]
    assert df.select(tx.term_coverage(F.col("t"), [])).first()[0] == 1




def test_fold_of_all_latin(table):
    names = ["Timișoara Nguyễn", "Łódź Ünïcode", "Ǆ ǅ ﬁ", "São Tomé é", "Ằ ằ ḁ"]
    got = [r[0] for r in table("i int, t string", *enumerate(names)).orderBy("i").select(tx.fold("t")).collect()]
    assert got[0] == "timisoara nguyen" == tx.fold_text(names[0]) and got[3:] == [tx.fold_text(n) for n in names[3:]]


def test_index_scores_like_the_scan(table):
    rows = ts.text_rows(table("i bigint, t string", (1, "a red car and a red car"), (2, "the car is red"), (3, "redder cars"), (4, " "), (5, None), (6, "red red car, rojo"), (6, "red")), "i", "t").dropDuplicates(["row_id"])
    index = ts.build_index(rows)
    for patterns in (["red"], ["red car", "car"], ["red*"], ["red car*", "the"], [], ["zzz", "of zzz"], ["Rojo"]):
        a = {r.row_id: round(r.score, 9) for r in ts.bm25(rows, patterns).collect()}
        assert a == {r.row_id: round(r.score, 9) for r in ts.search_index(index, patterns).collect()}, patterns
    assert ts.search_index(ts.build_index(rows.limit(0)), ["red"]).count() == 0
