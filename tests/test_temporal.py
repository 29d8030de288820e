import random

from pyspark.sql import functions as F

from cutlight.operators import temporal as te
from tests.conftest import rows_of

A, B = "k bigint, left_id bigint, start_a double, end_a double", "k bigint, right_id bigint, start_b double, end_b double"


def test_overlap_slices_agree(table):
    rnd = random.Random(1)

    def rows(n):
        return [(rnd.randrange(3), i, s := rnd.uniform(0, 900), s + rnd.uniform(0, 200)) for i in range(n)]

    a, b = table(A, *rows(60)), table(B, *rows(60))
    plain = rows_of(te.overlap_join(a, b, "k").withColumn("seconds", F.round("seconds", 6)))
    assert plain and plain == rows_of(te.overlap_join(a, b, "k", 45.0).withColumn("seconds", F.round("seconds", 6)))


def test_voice_proposal_overlap(table):
    a = table(A, (1, 1, 0.0, 60.0))
    b = table(B, (1, 7, 0.0, 55.0), (1, 8, 10.0, 14.0), (2, 9, 0.0, 99.0), (1, 10, 60.0, 70.0))
    assert rows_of(te.overlap_totals(te.overlap_join(a, b, "k"), "left_id", "right_id", 10)) == [(1, 7, 55.0)]


def test_nearest(table):
    req = table("k bigint, request_id bigint, at double", (1, 1, 10.0), (1, 2, 100.0), (2, 3, 5.0))
    rows = table("k bigint, row_id bigint, start double, end double", (1, 5, 12.0, 13.0), (1, 4, 8.0, 9.0), (1, 6, 12.0, 99.0))
    assert rows_of(te.nearest_row(req, rows, "k")) == [(1, 4, 2.0), (2, 5, 88.0)]
    assert rows_of(te.nearest_row(req, rows, "k", 5.0).select("request_id", "row_id")) == [(1, 4), (2, 6)]
    exact = table("request_id bigint, exact_id bigint", (2, 99))
    assert rows_of(te.exact_or_nearest(req, exact, rows, "k")) == [(1, 4, False), (2, 99, True), (3, None, False)]


def test_islands_short_gap_merges(table):
    df = table("p bigint, start double, end double, q double", (1, 0.0, 0.0, 0.8), (1, 12.0, 12.0, None), (1, 24.1, 24.1, 0.2), (2, 0.0, 50.0, None), (2, 1.0, 2.0, None), (2, 55.0, 56.0, None))
    got = rows_of(te.islands(df, ["p"], 12.0, quality="q"))
    assert got == [(1, 0.0, 12.0, 2, 0.65), (1, 24.1, 24.6, 1, 0.2), (2, 0.0, 56.0, 3, 0.5)]


def test_close_and_grid(table):
    f = table("a bigint, t double, d double", (1, 0.0, 9.0), (1, 4.0, 9.0), (2, 7.0, 3.0))
    assert rows_of(te.close_moments(f, "a", "t", "d").select("a", "t", "end_seconds")) == [(1, 0.0, 4.0), (1, 4.0, 9.0), (2, 7.0, 7.0)]
    g = te.sampling_grid(table("a bigint, d double", (1, 12.0), (2, 40000.0), (3, None), (4, 0.0)), "d").groupBy("a").agg(F.count("*"), F.max("at_seconds"))
    assert rows_of(g) == [(1, 3, 10.0), (2, 4000, 39990.0)]


def test_keyframes_compare_with_last_kept(table):
    h = [0, 0b111, 0b111111, 0b111111111111, 0]
    f = table("a bigint, t bigint, h bigint", *((1, i, x) for i, x in enumerate(h)))
    assert [r.t for r in te.changed_frames(f, "a", "t", "h", 6).orderBy("t").collect()] == [0, 2, 3, 4]


def test_chunks(table):
    w = table("asset_id bigint, start double, end double, text string, confidence double", (1, 0.0, 5.0, "a", 0.5), (1, 5.0, 12.0, "b ", None), (1, 12.0, 13.0, "c", None), (2, 0.0, 1.0, None, 0.1))
    assert rows_of(te.chunk_transcript(w)) == [(1, 0.0, 12.0, "a b", 0.5), (1, 12.0, 13.0, "c", None)]


def test_eviction(spark, table):
    df = table("i bigint, b bigint, t string, p boolean", (1, 5, "2025-01-01", False), (2, 5, "2025-01-02", True), (3, 5, "2025-01-02", False), (4, 5, "2025-01-03", False)).withColumn("t", F.to_timestamp("t"))
    assert [r.i for r in te.evict_oldest(df, "b", "t", "i", 10, "p").orderBy("i").collect()] == [1, 3]
    assert te.evict_oldest(df, "b", "t", "i", 99, "p").count() == 0
