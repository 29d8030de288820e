import random

from cutlight.llm.nearest_time import file_key, match_nearest, nearest_intervals
from pyspark.sql import functions as F
from tests.conftest import rows_of

L, R = "k string, left_id bigint, at_ms bigint, tolerance_ms bigint, x int", "k string, start_ms bigint, row_id bigint, x int"


def test_against_brute_force(table):
    rnd = random.Random(2)
    left = [(rnd.choice("ab"), i, rnd.randrange(-50_000, 3_000_000), rnd.choice([0, 5, 2_000, 30_000, 700_000]), 1) for i in range(300)]
    right = [(rnd.choice("abc"), rnd.randrange(0, 3_000_000), i, 1) for i in range(150)] + [("a", 500, 9000, 1), ("a", 500, 8000, 1)]
    want = []
    for k, i, at, tol, _ in left:
        best = min(((abs(s - at), s, r) for q, s, r, _ in right if q == k), default=None)
        if best and best[0] <= tol:
            want.append((i, best[2], best[0]))
    assert rows_of(match_nearest(table(L, *left, *left[:20]), table(R, *right, *right[:9]), ["k"])) == sorted(want, key=repr)


def test_ties_and_nulls(table):
    right = table(R, ("a", 10, 1, 1), ("a", 20, 2, 1), ("a", None, 3, 1), (None, 15, 4, 1))
    left = table(L, ("a", 1, 15, 5, 1), ("a", 2, 16, 5, 1), ("a", 3, None, 5, 1), ("a", 4, 15, None, 1), ("a", 5, 15, -1, 1), (None, 6, 15, 9, 1), ("a", 7, 10**12, 10**12, 1))
    assert rows_of(match_nearest(left, right, ["k"])) == [(1, 1, 5), (2, 2, 4), (7, 2, 10**12 - 20)]


def test_empty(table):
    assert match_nearest(table(L), table(R, ("a", 1, 1, 1)), ["k"]).count() == 0
    assert match_nearest(table(L, ("a", 1, 1, 1, 1)), table(R), ["k"]).count() == 0


def test_intervals_partition_time(table):
    got = nearest_intervals(table(R, *(("a", t, t, 1) for t in (0, 7, 1_200_000, 1_200_001))), ["k"]).orderBy("start_ms").collect()
    assert got[0].from_ms is None and got[-1].to_ms is None
    assert all(a.to_ms + 1 == b.from_ms for a, b in zip(got, got[1:]))


def test_file_key(table):
    assert [r[0] for r in table("p string", ("A/b/C.mov",), ("c.MOV",), (None,)).select(file_key(F.col("p"))).collect()] == ["c.mov", "c.mov", None]
