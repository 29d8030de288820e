import datetime as dt

from cutlight.queries.catalogue import event_sessions
from cutlight.queries.streams import stream_sessions
from cutlight.streaming import catalogue_stream as cs
from tests.conftest import rows_of

T0 = dt.datetime(2025, 1, 1)


def test_files_into_latest_table(spark, table, tmp_path):
    src, state, ck = (str(tmp_path / n) for n in ("src", "state", "ck"))
    schema = "k int, v string, at timestamp"
    table(schema, (1, "a", T0), (2, "b", T0)).coalesce(1).write.parquet(src)
    run = lambda: cs.into_table(cs.file_stream(spark, schema, src), cs.merge_batch(state, ["k"], "at"), ck).start().awaitTermination()
    run()
    table(schema, (2, "c", T0 + dt.timedelta(1)), (3, "d", T0)).coalesce(1).write.mode("append").parquet(src)
    run()
    assert rows_of(spark.read.parquet(state + "/2").select("k", "v")) == [(1, "a"), (2, "c"), (3, "d")]


def test_sessions(spark, table, tmp_path):
    src = str(tmp_path / "ev")
    rows = [(1, T0), (1, T0 + dt.timedelta(minutes=30)), (1, T0 + dt.timedelta(minutes=200)), (2, T0)]
    table("user int, at timestamp", *rows).coalesce(1).write.parquet(src)
    s = cs.event_sessions(spark.readStream.schema("user int, at timestamp").parquet(src), "user", "at", "1 hour", "1 day")
    q = s.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows_of(spark.sql("select user, n, (unix_timestamp(last) - unix_timestamp(start)) div 60 from sessions")) == [(1, 1, 0), (1, 2, 30), (2, 1, 0)]


def test_sessions_of_many_files_in_shuffled_time(spark, table, tmp_path):
    at = str(tmp_path / "events.parquet")
    for k in range(18):  # more than two triggers of eight files; the latest days come first
        day = T0 + dt.timedelta(days=(7 * k + 16) % 18)
        table("user_id bigint, ts timestamp", *((u, day + dt.timedelta(minutes=m)) for u in (1, 2) for m in (0, 50, 300))).coalesce(1).write.mode("append").parquet(at)
    got = rows_of(stream_sessions(spark, str(tmp_path)))
    assert got == rows_of(event_sessions(spark, str(tmp_path))) and sum(r[3] for r in got) == 108
