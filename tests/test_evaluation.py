import json

from pyspark.sql import functions as F

from cutlight.operators import evaluation as ev
from cutlight.sources import evaluation_sets as es
from tests.conftest import rows_of

H = "case_id string, hit_id bigint, rank_no int, asset_name string, start_seconds double, end_seconds double"
J = "case_id string, judgement_id bigint, asset string, at_seconds double, grade int, tolerance_seconds double"


def test_metrics(table):
    hits = table(H, ("a", 1, 1, "x/B.mov", 0.0, 9.0), ("a", 2, 2, "A.MOV", 100.0, 90.0), ("a", 3, 3, "a.mov", 5.0, 50.0), ("a", 4, 60, "c.mov", 0.0, 1.0), ("n", 5, 1, "a.mov", 0.0, 1.0))
    judged = table(J, ("a", 1, "A.mov", 10.0, 3, 2.0), ("a", 2, "a.mov", 110.0, None, None), ("a", 3, "c.mov", None, 1, None))
    g = ev.graded_hits(hits, judged)
    assert rows_of(g.select("hit_id", "judgement_id", "grade")) == [(1, None, 0), (2, 2, 1), (3, 1, 3), (4, 3, 1), (5, None, 0)]
    c = {r.case_id: r for r in ev.case_metrics(g, judged).collect()}
    assert (c["a"].first_rank, round(c["a"].recall10, 4), c["a"].recall50, c["a"].reciprocal_rank) == (2, 0.6667, c["a"].recall10, 0.5)
    assert c["n"].false_positive and c["n"].recall10 == 0 and c["a"].ndcg10 < 1


def test_ndcg_may_exceed_one(table):
    hits = table(H, *(("a", i, i, "a.mov", 0.0, 1.0) for i in (1, 2, 3)))
    judged = table(J, ("a", 1, "a.mov", None, 2, None))
    assert ev.case_metrics(ev.graded_hits(hits, judged), judged).first().ndcg10 > 1


def test_calibration_sweep_median(table):
    s = table("score double, ok boolean", (0.05, False), (0.31, True), (0.35, False), (0.99, True), (1.0, True), (-1.0, False))
    assert rows_of(ev.calibration(s, "score", "ok")) == [(0.0, 2, 0), (0.3, 2, 1), (0.9, 2, 2)]
    best = ev.threshold_sweep(s, "score", "ok").orderBy(F.desc("f1"), "threshold").first()
    assert best.threshold < 0.31 and best.recall == 1 and best.precision == 0.75
    assert ev.upper_median(table("v double", (1.0,), (2.0,), (3.0,), (4.0,), (None,)), "v").first()[0] == 3.0
    assert ev.upper_median(table("v double"), "v").first()[0] is None


def test_changes(table):
    a = table("case_id string, first_rank int", ("x", 1), ("y", None), ("z", None))
    b = table("case_id string, first_rank int", ("x", 1), ("y", 4), ("z", None))
    assert rows_of(ev.changed_cases(a, b)) == [("y", None, 4)]


def test_json(spark, tmp_path):
    p = tmp_path / "set.json"
    p.write_text(json.dumps({"name": "s", "cases": [
        {"id": "1", "query": "q", "lang": "es", "expectedAssets": ["a.mov"], "expect": "any"},
        {"id": "2", "query": "r", "language": "en", "relevant": [{"asset": "b.mov", "at": 3.5, "grade": 2, "toleranceSeconds": 5}]},
    ]}))
    cases = es.read_cases(spark, str(p))
    assert rows_of(cases.select("case_id", "language", "expectation")) == [("1", "es", "any"), ("2", "en", "any")]
    assert rows_of(es.judgements(cases)) == [("1", 0, "a.mov", None, 1, 30.0), ("2", 0, "b.mov", 3.5, 2, 5.0)]
    es.write_report(cases.select("case_id", "language"), str(tmp_path / "r.json"), set_name="s")
    assert json.loads((tmp_path / "r.json").read_text())["cases"][0]["case_id"] == "1"
