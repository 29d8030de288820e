import datetime as dt

from cutlight.operators.references import catalogue_references, missing_references, uuid_key
from pyspark.sql import functions as F
from tests.conftest import rows_of

REF = "child_table string, child_column string, row_id bigint, parent_table string, key string, at timestamp"
EV = "parent_table string, key string, at timestamp"


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def ref(i, key, at):
    return ("c", "k", i, "p", key, at)


def test_states(table):
    refs = table(REF, ref(1, "a", day(5)), ref(2, "b", day(5)), ref(3, "c", day(5)), ref(4, "d", day(1)), ref(5, "e", day(9)), ref(6, "f", day(5)), ref(7, None, day(5)))
    loads = table(EV, ("p", "a", day(1)), ("p", "c", day(1)), ("p", "d", day(3)), ("p", "e", day(1)), ("p", "f", day(1)), ("p", "f", day(7)))
    removals = table(EV, ("p", "c", day(8)), ("p", "e", day(4)), ("p", "f", day(3)))
    found = {r.row_id: (r.status, r.period_month) for r in missing_references(refs, loads, removals).collect()}
    assert found == {2: ("missing", "2025-01"), 3: ("deleted", "2025-01"), 4: ("late", "2025-01"), 5: ("deleted_before", "2025-01"), 6: ("late", "2025-01")}


def test_edges(table):
    refs = table(REF, ref(1, "a", day(1)), ref(1, "a", day(1)), ref(2, "a", None))
    at_once = missing_references(refs, table(EV, ("p", "a", day(1)), ("p", None, day(1)), ("p", "a", None)), table(EV))
    assert [(r.row_id, r.status) for r in at_once.collect()] == [(2, "late")]  # live from its load on; no time is before everything
    tie = missing_references(refs, table(EV, ("p", "a", day(1))), table(EV, ("p", "a", day(1))))
    assert {(r.row_id, r.status) for r in tie.collect()} == {(1, "deleted_before"), (2, "deleted_before")}
    assert missing_references(table(REF), table(EV), table(EV)).count() == 0
    assert {r.status for r in missing_references(refs, table(EV), table(EV)).collect()} == {"missing"}


def test_hot_key_is_split(spark):
    refs = spark.range(60_000).select(
        F.lit("c").alias("child_table"), F.lit("k").alias("child_column"), F.col("id").alias("row_id"), F.lit("p").alias("parent_table"),
        F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string")).alias("key"), F.timestamp_seconds(F.col("id")).alias("at"),
    )
    loads = refs.where("key <> 'x'").select("parent_table", "key", F.timestamp_seconds(F.lit(0)).alias("at")).union(spark.sql("select 'p', 'x', timestamp_seconds(30000)"))
    found = missing_references(refs, loads, loads.limit(0))
    assert found.where("status = 'late'").count() == found.count() == 10_000


def test_catalogue(table):
    loc = table(
        "location_id bigint, asset_id bigint, volume_uuid string, loaded_at timestamp, extra string",
        (1, 7, " {AB-1} ", day(3), "x"), (1, 8, "ab-2", day(4), "y"), (2, 0, None, day(1), None), (3, -1, "v", day(1), None),
    )
    maps = table("map_id bigint, snapshot_id string, old_id bigint, loaded_at timestamp", (1, "s", None, day(1)), (2, "s", 4, day(1)), (2, "s", 4, day(1)))
    got = rows_of(catalogue_references(loc, maps).select("child_column", "row_id", "key"))
    assert got == [("asset_id", 1, "7"), ("old_id", 2, "s/4"), ("volume_uuid", 1, "ab-1"), ("volume_uuid", 3, "v")]


def test_uuid_key(table):
    assert [r[0] for r in table("u string", (" {A-b}\t",), ("a-B",), (None,)).select(uuid_key(F.col("u"))).collect()] == ["a-b", "a-b", None]
