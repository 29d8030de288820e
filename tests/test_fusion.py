import random

from pyspark.sql import functions as F

from cutlight.operators import fusion as fu
from tests.conftest import rows_of

C = "asset_id bigint, moment_id bigint, seconds double, end_seconds double, channel string, rank_no int, confidence double"


def test_two_kinds_of_evidence_win(table):
    c = table(
        C, (1, 11, 840.0, 870.0, "visual", 1, 0.8), (3, 12, 840.0, 870.0, "visual", 2, 0.8), (3, None, 856.0, 864.0, "transcript", 1, 0.6), (2, None, 12.0, 20.0, "transcript", 2, 0.6),
        (9, None, 0.0, 0.0, "metadata", 3, 0.5), (3, None, 0.0, 0.0, "metadata", 2, 0.4), (3, None, 0.0, 0.0, "metadata", 7, 0.9),
    )
    out = fu.trim(fu.ordering(fu.fuse(c)), 10).orderBy("position").collect()
    assert [r.asset_id for r in out] == [3, 1, 2, 9]
    best = out[0]
    assert (best.moment_id, best.start_seconds, best.end_seconds) == (12, 840.0, 870.0)
    assert dict(best.ranks) == {"visual": 2, "transcript": 1, "metadata": 2} and abs(best.confidence - (1 - 0.2 * (1 - 0.57) * (1 - 0.28))) < 1e-9


def test_against_naive(table):
    rnd = random.Random(7)
    rows = [(1, i, float(rnd.randrange(300)), 0.0, rnd.choice(fu.TIE_ORDER), i, 0.5) for i in range(80)]
    rows = [(a, m, s, s + 5, c, r, x) for a, m, s, _, c, r, x in rows]
    got = fu.fuse(table(C, *rows)).select("start_seconds", "end_seconds", F.size("ranks").alias("n"))
    order = sorted(rows, key=lambda r: (r[2], fu.TIE_ORDER.index(r[4]), r[5]))
    buckets = []
    for r in order:
        for b in buckets:
            if r[4] not in b["ch"] and abs(b["s"] - r[2]) <= 30:
                b["ch"].add(r[4])
                b["s"], b["e"] = min(b["s"], r[2]), max(b["e"], r[3])
                break
        else:
            buckets.append({"s": r[2], "e": r[3], "ch": {r[4]}})
    assert rows_of(got) == sorted(((b["s"], b["e"], len(b["ch"])) for b in buckets), key=repr)


def test_trim_caps_after_the_first_cut(table):
    r = table("asset_id bigint, moment_id bigint, start_seconds double, score double, confidence double", *((1, i, float(i), 1 - i / 100, 1 - i / 100) for i in range(10)), (2, 90, 0.0, 0.5, 0.5))
    assert [x.moment_id for x in fu.trim(r, 3).orderBy("position").collect()] == [0, 1, 2]
    assert fu.trim(r, 3, least=2.0).count() == 0 and fu.trim(r, 0).count() == 0


def test_learning_only_reorders(table):
    t = table("asset_id bigint, position int, score double, confidence double, ranks map<string,int>", (1, 1, 0.5, 0.5, {"visual": 1}), (2, 2, 0.49, 0.49, {"ocr": 1}), (3, 3, 0.1, 0.1, None))
    got = fu.learned_order(t, table("channel string, multiplier double", ("ocr", 1.1))).orderBy("position").collect()
    assert [r.asset_id for r in got] == [2, 1, 3] and [r.confidence for r in got] == [0.49, 0.5, 0.1]


def test_modes(table):
    f = table("ranks map<string,int>, confidences map<string,double>", ({"visual": 1, "ocr": 3}, {"visual": 0.5, "ocr": 2.0}))
    got = {m: fu.ordering(f, m).first().score for m in ("rank_fusion", "confidence", "blend")}
    assert abs(got["rank_fusion"] - (0.45 / 61 + 0.12 / 63)) < 1e-12 and abs(got["confidence"] - (1 - 0.5 * 0.05)) < 1e-12
    assert abs(got["blend"] - got["rank_fusion"] * (0.25 + 0.75 * got["confidence"])) < 1e-12


def test_filters_and_locations(table):
    a = table("asset_id bigint, media_type string, created_at timestamp", (1, "video", None), (2, "image", None))
    c = table("asset_id bigint", (1,), (2,), (3,))
    import datetime as dt

    assert rows_of(fu.eligible(c, a, "video")) == [(1,)] and rows_of(fu.eligible(c, a)) == [(1,), (2,)]
    assert fu.eligible(c, a, None, (dt.datetime(2020, 1, 1), dt.datetime(2030, 1, 1))).count() == 0
    l = table("asset_id bigint, location_id bigint, availability string", (1, 5, "missing"), (1, 6, "offline"), (2, 7, "odd"), (None, 8, "online"))
    assert rows_of(fu.best_location(l)) == [(1, 6, "offline"), (2, 7, "odd")]
