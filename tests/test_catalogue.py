import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutlight.operators import catalogue as ca
from cutlight.operators import people as pe
from cutlight.operators import snapshot as sn
from cutlight.operators import usage as us
from cutlight.sources import files as fi
from tests.conftest import rows_of

L = "location_id bigint, asset_id bigint, volume_uuid string, relative_path string, availability string"


def test_upsert_and_replace(table):
    t = table("k int, v string, extra int", (1, "a", 1), (2, "b", 2))
    c = table("k int, v string, at int", (2, "x", 1), (2, "y", 2), (3, "z", 1))
    assert rows_of(ca.upsert(t, c, ["k"], "at").select("k", "v", "extra")) == [(1, "a", 1), (2, "y", None), (3, "z", None)]
    assert rows_of(ca.replace_slices(t, table("k int, v string, extra int", (2, "n", 0), (2, "m", 0)), "k")) == [(1, "a", 1), (2, "m", 0), (2, "n", 0)]


def test_missing_is_not_offline(table):
    l = table(L, (1, 1, "v", "a/x", "online"), (2, 1, "v", "ab/x", "online"), (3, 2, "v", "a/y", "offline"), (4, 3, "w", "a/z", "online"), (5, 1, "w", "q", "missing"))
    seen = table("volume_uuid string, relative_path string", ("v", "zzz"))
    assert {r.location_id: r.availability for r in ca.mark_missing(l, seen, "v", "a").collect()} == {1: "missing", 2: "online", 3: "offline", 4: "online", 5: "missing"}
    after = ca.mark_volumes(l, table("volume_uuid string", ("v",)))
    assert {r.location_id: r.availability for r in after.collect()} == {1: "online", 2: "online", 3: "online", 4: "offline", 5: "missing"}
    assert {r.availability for r in ca.mark_volumes(l, table("volume_uuid string")).collect()} == {"offline", "missing"}
    assert [r.location_id for r in ca.redundant_missing(l).collect()] == [5]


def test_repair_and_volumes(table):
    l = table(L, (1, 1, "v", "a", "online"), (2, 9, "v", "b", "online"), (3, None, "v", "c", "online"), (4, 1, "x", "d", "online"))
    a, v = table("asset_id bigint", (1,)), table("volume_uuid string", ("v",))
    assert [r[0] for r in rows_of(ca.repair(l, [("asset_id", a, "asset_id"), ("volume_uuid", v, "volume_uuid")]).select("location_id"))] == [1, 3]
    assert ca.orphans(l, "asset_id", a, "asset_id").count() == 1
    p = table("path string", ("/m/d1/x.mov",), ("/m/d10/y",), ("/z",))
    m = table("mount string, volume_uuid string", ("/", "r"), ("/m/d1", "d1"), ("/m/", "m"))
    assert rows_of(ca.resolve_volume(p, m)) == [("/m/d1/x.mov", "d1", "x.mov"), ("/m/d10/y", "m", "d10/y"), ("/z", "r", "z")]


def test_scan_outcomes(table):
    t0 = dt.datetime(2025, 1, 1)
    s = "volume_uuid string, relative_path string, file_size bigint, modified_at timestamp, content_key string"
    scan = table(s, ("v", "same", 1, t0, "k1"), ("v", "new", 1, t0, "k9"), ("v", "copy", 1, t0, "k1"), ("v", "moved", 1, t0, "k2"), ("v", "changed", 2, t0, "k1"))
    loc = table(s.replace(", content_key string", "") + ", asset_id bigint, availability string", ("v", "same", 1, t0, 1, "online"), ("v", "changed", 1, t0, 5, "online"), ("v", "gone", 1, t0, 2, "missing"))
    got = {r.relative_path: r.outcome for r in ca.scan_outcomes(scan, loc, table("content_key string, asset_id bigint", ("k1", 1), ("k2", 2))).collect()}
    assert got == {"same": "unchanged", "new": "new_asset", "copy": "new_location", "moved": "renamed", "changed": "rebound"}


def test_coverage(table):
    assert tuple(ca.coverage(table("indexed_levels int", (15,), (1,), (4,), (None,))).first()) == (4, 2, 1, 2, 1)
    assert table("l int", (1,), (None,)).select(ca.add_levels(F.col("l"), 4)).collect()[1][0] == 4


def test_preferences(table):
    rows = [(i, "open", 0, "ocr, ocr,visual") for i in range(100)] + [(100 + i, "reformulate", 0, "label") for i in range(100)] + [(200 + i, "seek", 3000 * (i % 2), "person") for i in range(8)]
    got = {r.channel: r for r in us.channel_preferences(table("id bigint, action string, dwell_milliseconds int, channels string", *rows)).collect()}
    assert got["ocr"].multiplier == 1.15 and got["label"].multiplier == 0.85 and got["person"].multiplier == 1 and got["ocr"].n == 100
    assert us.channel_preferences(table("id bigint, action string, dwell_milliseconds int, channels string", *rows[:150])).count() == 0
    assert us.query_hash(b"k", "Río  ROJO") == us.query_hash(b"k", "rio rojo") != us.query_hash(b"l", "rio rojo")


def test_face_clusters(table):
    one = lambda k: [1.0 if i == k else 0.0 for i in range(64)]
    df = table("i bigint, v array<float>", (1, one(1)), (2, one(1)), (3, one(1)), (4, one(40)), (5, None))
    assert sorted(r["count"] for r in pe.online_clusters(df, "i", "v", 0.45).groupBy("cluster").count().collect()) == [1, 3]
    assert list(pe.assign_in_order(np.eye(3), 0.5)) == [0, 1, 2]


def test_consolidate():
    p = lambda i, v, n=1, named=False: {"person_id": i, "sum": v, "n": n, "named": named}
    assert pe.consolidate([p(1, [1, 0]), p(2, [1, 0.1], 1, True), p(3, [0, 1])], 0.5) == {1: 2, 2: 2, 3: 3}
    assert pe.consolidate([p(1, [1, 0], 1, True), p(2, [1, 0], 1, True)], 0.5) == {1: 1, 2: 2}
    assert pe.consolidate([p(1, [1, 0]), p(2, [1, 0])], 0.5, {frozenset((1, 2))}) == {1: 1, 2: 2}


def test_people(table):
    f = table("w double, q double, y double", (0.1, 0.9, 0.0), (0.001, 0.9, 0.0), (0.1, 0.1, 0.0), (0.1, None, 70.0), (0.1, None, None))
    assert [r[0] for r in f.select(pe.face_gate(F.col("w"), F.lit(1920), F.col("q"), F.col("y"))).collect()] == [True, False, False, False, True]
    v = table("asset_id bigint, voice_id bigint, start double, end double", (1, 5, 0.0, 60.0))
    s = table("asset_id bigint, person_id bigint, start double, end double", (1, 7, 0.0, 55.0), (1, 8, 10.0, 14.0))
    (r,) = pe.link_proposals(v, s).collect()
    assert (r.voice_id, r.person_id) == (5, 7) and r.coverage > 0.8
    names = table("person_id bigint, display_name string", (1, "Jorge Álvarez"), (2, "Marta Gonzalez"), (3, None))
    assert [[r.person_id for r in pe.people_named_like(names, q).collect()] for q in ("jorge alvarez", "Alvares", "zz")] == [[1], [1], []]
    faces = table("face_id bigint, person_id bigint, assigned_by string", (1, 4, "user"), (2, 4, "auto"))
    auto = table("face_id bigint, person_id bigint", (1, 9), (2, 9))
    assert rows_of(pe.reassign_faces(faces, auto)) == [(1, 4, "user"), (2, 9, "auto")]
    assert rows_of(pe.merge_people(faces, table("person_id bigint, survivor bigint", (4, 1))))[0][1] == 1


def _tables(table, disk, key, strong="s", path="p"):
    return {
        "volumes": table("volume_uuid string, is_online boolean, bookmark string", (disk, True, "b")),
        "locations": table(L, (1, 1, disk, path, "online")),
        "assets": table("asset_id bigint, content_key string, strong_key string, indexed_levels int", (1, key, strong, 15)),
        "moments": table("moment_id bigint, asset_id bigint", (5, 1)),
        "transcript_chunks": table("chunk_id bigint, asset_id bigint"),
        "faces": table("face_id bigint, asset_id bigint", (1, 1)),
    }


def test_snapshot(spark, table, tmp_path):
    at = str(tmp_path / "snap")
    sn.export(_tables(table, "disk-A", "k2"), "disk-A", at)
    got = sn.read(spark, at)
    assert set(got) == {"volumes", "locations", "assets", "moments", "transcript_chunks"} and "bookmark" not in got["volumes"].columns
    assert got["assets"].first().indexed_levels == 7 and got["locations"].first().availability == "offline"
    merged = sn.merge(_tables(table, "disk-B", "k1"), got)
    assert rows_of(merged["assets"].select("asset_id", "content_key")) == [(1, "k1"), (2, "k2")]
    assert rows_of(merged["moments"].select("asset_id")) == [(1,), (2,)] and merged["locations"].count() == 2
    with pytest.raises(ValueError, match="conflicts"):
        sn.merge(_tables(table, "disk-A", "k1"), got)
    with pytest.raises(ValueError, match="conflicts"):
        sn.merge(_tables(table, "disk-B", "k2", strong="other"), got)
    part = next((tmp_path / "snap" / "assets").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="checksum"):
        sn.inspect(at)


def test_files(spark, table, tmp_path):
    (tmp_path / ".hidden").mkdir()
    for name, n in (("a.MOV", 70_000), ("b.jpg", 100), (".hidden/c.mov", 70_000), ("d.txt", 70_000), ("e.wav", 9_000_000)):
        (tmp_path / name).write_bytes(b"x" * n)
    scan = fi.scan_folder(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in scan.collect()) == ["a.MOV", "e.wav"]
    keys = [r.content_key for r in fi.with_content_keys(scan).collect()]
    assert all(k.startswith("q1:") for k in keys) and fi.strong_key(str(tmp_path / "b.jpg")).startswith("s1:")
    assert fi.new_files(scan, scan.where("path like '%MOV'")).count() == 1
    probed = fi.with_probe(scan, lambda p: (1.5,) if p.endswith("wav") else None, "duration double")
    assert {r.duration for r in probed.collect()} == {1.5, None}


def test_camera_formats(table):
    names = ["/a/B.MOV", "/a/b.mxf", "/a/b.braw", "/a/b.HEIC", "/a/b.cr3", "/a/b.wav", "/a/b.pdf", "/a.dng/b", "/a/b.heif"]
    got = {r.p: r.k for r in table("p string", *((n,) for n in names)).select("p", fi.media_type(F.col("p")).alias("k")).collect()}
    assert [got[n] for n in names] == ["video", "video", "video", "image", "image", "audio", None, None, "image"]
