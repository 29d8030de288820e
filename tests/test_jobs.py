import numpy as np
from pyspark.sql import functions as F

from cutlight.operators import catalogue as ca
from cutlight.operators import jobs as jb
from cutlight.operators import usage as us
from cutlight.operators import vector_index as vi
from cutlight.sources import synthetic as sy
from tests.conftest import rows_of

J = "job_id bigint, asset_id bigint, task string, state string, priority int, attempts int, last_error string"


def test_queue(table):
    jobs = table(J, (1, 1, "visual", "pending", 5, 0, None), (2, 1, "metadata", "pending", 0, 0, None), (3, 2, "visual", "running", 5, 0, None), (4, 2, "metadata", "pending", 0, 0, None),
                 (5, 3, "visual", "pending", 5, 3, "x"), (6, 4, "ocr", "pending", 1, 0, None))
    head = jb.claimable(jobs, ["visual", "metadata"])
    assert [r.job_id for r in head.collect()] == [2]  # one a file, a busy file waits, three failures stop
    state = {r.job_id: r.state for r in jb.claim(jobs, head).collect()}
    assert state[2] == "running" and state[1] == "pending"
    after = jb.fail(jb.fail(jobs, table("job_id bigint, error string", (1, "a"))), table("job_id bigint, error string", (1, "b"), (3, "c" * 900)))
    got = {r.job_id: r for r in jb.fail(after, table("job_id bigint, error string", (1, "last"))).collect()}
    assert (got[1].state, got[1].attempts, got[1].last_error) == ("failed", 3, "last") and got[3].state == "pending" and len(got[3].last_error) == 500
    done = jb.complete(jobs, table("job_id bigint", (5,)))
    assert [(r.state, r.last_error) for r in done.where("job_id = 5").collect()] == [("done", None)]
    assert jb.requeue_stale(jobs).where("state = 'running'").count() == 0
    again = {(r.asset_id, r.task): r for r in jb.enqueue(done, table("asset_id bigint, task string, priority int", (3, "visual", 5), (9, "visual", 5), (8, "visual", 5))).collect()}
    assert again[3, "visual"].state == "done" and again[8, "visual"].job_id == 7 and again[9, "visual"].job_id == 8
    anew, versions = jb.backfill(done, {}, "ocr", "2", table("asset_id bigint, task string, priority int", (3, "visual", 1)))
    row = anew.where("job_id = 5").first()
    assert (row.state, row.attempts, row.priority) == ("pending", 0, 1) and versions == {"ocr": "2"} and jb.backfill(done, versions, "ocr", "2", jobs)[0] is done
    assert jb.claimable(jobs.limit(0), ["visual"]).count() == 0


def test_daily_window(table):
    m = table("m int", (0,), (100,), (480,), (1320,), (1439,))
    inside = lambda a, b: [r.m for r in m.where(jb.within_daily_window(F.col("m"), a, b)).orderBy("m").collect()]
    assert inside(1320, 480) == [0, 100, 1320, 1439] and inside(100, 480) == [100] and len(inside(7, 7)) == 5


def test_vector_index(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(40, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i bigint, v array<double>")
    index = vi.build(df, "i", "v", "m")
    want = [int(j) for j in np.argsort(-(x @ x[7]))[:10]]
    q = x[7].tolist()
    assert len(set(r.row_id for r in vi.search(index, q, 10).collect()) & set(want)) >= 9
    assert vi.nearest(df, "i", "v", "m", q, 10, index).count() == 10
    less = vi.remove(index, spark.createDataFrame([(7,)], "row_id bigint"))
    assert less.rows.count() == 479 and vi.nearest(df, "i", "v", "m", q, 1, less).first().row_id == 7  # a stale index isn't used
    more = vi.add(less, spark.createDataFrame([(7, q), (3, (-x[7]).tolist())], "row_id bigint, vector array<double>"))
    assert more.rows.count() == 480 and vi.search(more, q, 1).first().row_id == 7
    assert vi.build(df.limit(0), "i", "v", "m") is None


def test_usage_state(spark):
    rows = spark.createDataFrame([], us.INTERACTION)
    off = us.UsageState()
    assert us.record(off, rows, "open", "mar", channels=("ocr",)).count() == 0
    on = off.switched(True)
    one = us.record(on, rows, "open", "El  Mar", asset_id=4, dwell=-3, channels=("ocr", "ocr", "unknown"))
    r = one.first()
    assert (r.id, r.channels, r.dwell_milliseconds, r.query_hash) == (1, "ocr", 0, us.query_hash(on.key, "el mar")) and us.record(on, one, "open", " ", channels=("ocr",)) is one
    assert us.record(on, one, "pin", "x", channels=("visual",)).where("id = 2").count() == 1
    assert us.report(on, one)["interactions"] == 1
    fresh, none = us.forget(on, one)
    assert none.count() == 0 and fresh.key != on.key and fresh.revision == 2


def test_gates_and_pages(table, spark):
    rows = table("id bigint", *((i,) for i in range(10)))
    assert [r.id for r in ca.page_after(rows, "id", 3, 3).collect()] == [4, 5, 6] and ca.page_after(rows, "id", None, 2).count() == 2 and ca.page_after(rows, "id", 99).count() == 0
    labels = table("m int, identifier string, confidence double", *((1, f"l{k}", k / 10) for k in range(10)), (2, "x", None))
    assert [r.identifier for r in ca.best_labels(labels, "m").orderBy(F.desc("confidence")).collect()] == ["l9", "l8", "l7", "l6", "l5"]
    t = table("t string, c double, s double, e double", ("ab", 0.35, 0.0, 1.0), (" a ", 0.9, 0.0, 0.9), (None, None, None, 2.0))
    assert rows_of(t.select(ca.text_gate(F.col("t"), F.col("c")), ca.speech_gate(F.col("s"), F.col("e"), F.col("c")))) == [(False, False), (False, False), (True, False)]
    m = sy.moments(spark, 3, 4)
    assert ca.moments_with_previews(m.drop("preview"), m.select("moment_id", "preview").where("moment_id > 2"), 5).count() == 5
    x = sy.texts(spark, 50, 7, ("uno", "dos", "tres"))
    assert x.count() == 50 and x.select("text").first() == sy.texts(spark, 50, 7, ("uno", "dos", "tres")).repartition(3).orderBy("row_id").select("text").first()
