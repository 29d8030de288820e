import random

from cutlight.operators.intervals import LATEST_MS, continuous_periods, gaps_between, speech_intervals
from tests.conftest import rows_of

S = "k string, start_ms bigint, end_ms bigint"


def naive(rows):
    out = {}
    for k, s, e in sorted(set(rows), key=lambda r: (r[0], r[1], r[2])):
        p = out.setdefault(k, [])
        if p and s <= p[-1][1]:
            p[-1][1] = max(p[-1][1], e)
        else:
            p.append([s, e])
    return sorted(((k, s, e) for k, ps in out.items() for s, e in ps), key=repr)


def test_touching_nested_and_points(table):
    df = table(S, ("a", 0, 10), ("a", 10, 20), ("a", 21, 30), ("a", 22, 23), ("a", 40, 40), ("b", 5, 6), ("b", 5, 6), ("b", None, 3), ("b", 9, 2))
    p = continuous_periods(df, ["k"])
    assert rows_of(p.select("k", "start_ms", "end_ms")) == [("a", 0, 20), ("a", 21, 30), ("a", 40, 40), ("b", 5, 6)]
    assert rows_of(gaps_between(p, ["k"])) == [("a", 20, 21), ("a", 30, 40)]


def test_against_naive(table):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc"), s := rnd.randrange(0, 4_000_000), s + rnd.randrange(0, 30_000)) for _ in range(600)]
    got = continuous_periods(table(S, *rows, *rows[:50]), ["k"], slice_ms=100_000)
    assert rows_of(got.select("k", "start_ms", "end_ms")) == naive(rows)


def test_empty_and_null_keys(table):
    assert continuous_periods(table(S), ["k"]).count() == 0
    assert rows_of(continuous_periods(table(S, (None, 1, 2), (None, 2, 3)), ["k"])) == [(None, 1, 3, 2)]


def test_speech(table):
    seg = table(
        "asset_id bigint, speaker string, start_seconds double, end_seconds double, n int",
        (1, " A ", 0.0, 1.0, 1), (1, "a", 1.0, 2.5, 1), (1, None, 0.0, 1.0, 1), (1, "  ", 0.0, 1.0, 1), (1, "b", float("nan"), 1.0, 1),
        (1, "b", 2.0, 1.0, 1), (1, "b", -1.0, 1.0, 1), (1, "b", 1.0, float("inf"), 1), (1, "b", None, 1.0, 1), (1, "b", 1e300, 2e300, 1),
    )
    # times beyond what a timestamp holds are clipped, not dropped
    assert rows_of(speech_intervals(seg)) == [(1, "a", 0, 1000), (1, "a", 1000, 2500), (1, "b", LATEST_MS, LATEST_MS)]


def test_far_ends(table):
    """A segment that ends at 1e12 seconds is timed, and covers what comes after its start."""
    seg = table("asset_id bigint, speaker string, start_seconds double, end_seconds double", (1, "a", 0.0, 1.0), (1, "a", 5.0, 1e12), (1, "a", 7.0, 8.0), (1, "a", 2e12, 3e13), (2, "a", 1.0, 2.0), (2, "a", 4e13, 5e13))
    p = continuous_periods(speech_intervals(seg), ["asset_id", "speaker"])
    assert rows_of(p) == [(1, "a", 0, 1000, 1), (1, "a", 2 * 10**15, LATEST_MS, 1), (1, "a", 5000, 10**15, 2), (2, "a", 1000, 2000, 1), (2, "a", LATEST_MS, LATEST_MS, 1)]
    assert rows_of(gaps_between(p, ["asset_id", "speaker"]))[0] == (1, "a", 1000, 5000)


def test_slices_are_stitched(table):
    """Whatever the slices' width, the periods and gaps are those of one slice."""
    import random

    rnd = random.Random(4)
    rows = [(rnd.randrange(3), s, s + rnd.choice((0, 3, 40, 900))) for s in (rnd.randrange(9000) for _ in range(400))] + [(None, 5, 9), (None, 9, 20), (7, 0, 50_000)]
    df = table("k int, start_ms bigint, end_ms bigint", *rows)
    whole = continuous_periods(df, ["k"], 10**9)
    for width in (10, 70, 1000):
        p = continuous_periods(df, ["k"], width)
        assert rows_of(p) == rows_of(whole)
        assert rows_of(gaps_between(p, ["k"], width)) == rows_of(gaps_between(whole, ["k"], 10**9))
