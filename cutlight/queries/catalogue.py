"""Queries over time, catalogue state, identities and usage, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutlight.functions import text as tx
from cutlight.operators import catalogue as ca
from cutlight.operators import fusion as fu
from cutlight.operators import people as pe
from cutlight.operators import snapshot as sn
from cutlight.operators import temporal as te
from cutlight.operators import usage as us
from cutlight.operators.intervals import timed
from cutlight.sources import files as fi
from cutlight.sources import load


def _segments(spark, d):
    """Timed voice segments, each once."""
    s = load(spark, d, "voice_segments").where(timed(F.col("start_seconds"), F.col("end_seconds")))
    return s.select("segment_id", "asset_id", F.lower(F.trim("speaker")).alias("speaker"), "voice_id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), "confidence").distinct()


def _moments(spark, d):
    """Evaluated hits as moments of assets."""
    a = load(spark, d, "assets").select("asset_id", F.lower("display_name").alias("file")).distinct()
    h = load(spark, d, "evaluated_hits").where("start_seconds is not null and not isnan(start_seconds) and end_seconds > start_seconds")
    return h.select("hit_id", F.lower(tx.basename(F.col("asset_name"))).alias("file"), "start_seconds", "end_seconds", "score").distinct().join(a, "file")


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Hits and voices that share ten seconds or more, over slices of time."""
    s = _segments(spark, d).where("voice_id is not null").select("asset_id", F.col("voice_id").alias("right_id"), F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    h = _moments(spark, d).select("asset_id", F.col("hit_id").alias("left_id"), F.col("start_seconds").alias("start_a"), F.col("end_seconds").alias("end_a"))
    pairs = te.overlap_join(h, s, "asset_id", 120.0)
    return te.overlap_totals(pairs, "left_id", "right_id", 10.0).select(F.col("left_id").alias("hit_id"), F.col("right_id").alias("voice_id"), F.round("seconds", 3).alias("seconds"))


def nearest_in_time(spark: SparkSession, d: str) -> DataFrame:
    """For each hit the segment of its file that starts nearest."""
    s = _segments(spark, d).select("asset_id", F.col("segment_id").alias("row_id"), "start")
    h = _moments(spark, d).select("asset_id", F.col("hit_id").alias("request_id"), F.col("start_seconds").alias("at"))
    return te.nearest_row(h, s, "asset_id").select("request_id", "row_id", F.round("distance", 3).alias("distance"))


def nearest_in_window(spark: SparkSession, d: str) -> DataFrame:
    """The same within thirty seconds of the segment."""
    s = _segments(spark, d).select("asset_id", F.col("segment_id").alias("row_id"), "start", "end")
    h = _moments(spark, d).select("asset_id", F.col("hit_id").alias("request_id"), F.col("start_seconds").alias("at"))
    return te.nearest_row(h, s, "asset_id", 30.0).select("request_id", "row_id")


def exact_or_nearest(spark: SparkSession, d: str) -> DataFrame:
    """A segment that starts at the very time, else the nearest."""
    s = _segments(spark, d).select("asset_id", F.col("segment_id").alias("row_id"), "start")
    h = _moments(spark, d).select("asset_id", F.col("hit_id").alias("request_id"), F.col("start_seconds").alias("at"))
    exact = h.join(s, "asset_id").where("start = at").groupBy("request_id").agg(F.min("row_id").alias("exact_id"))
    return te.exact_or_nearest(h, exact, s, "asset_id")


def spoken_islands(spark: SparkSession, d: str) -> DataFrame:
    """When each voice speaks in each file, pauses of up to eight seconds bridged."""
    s = _segments(spark, d).where("voice_id is not null")
    i = te.islands(s, ["asset_id", "voice_id"], 8.0, quality="confidence", unknown=0.6)
    return i.select("asset_id", "voice_id", *(F.round(c, 3).alias(c) for c in ("start_seconds", "end_seconds")), "n", F.round("confidence", 5).alias("confidence"))


def appearance_islands(spark: SparkSession, d: str) -> DataFrame:
    """Visits of users, with pauses of up to six hours bridged."""
    e = load(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"))
    i = te.islands(e.withColumn("end", F.col("start")), ["user_id"], 6 * 3600.0)
    return i.select("user_id", F.round("start_seconds", 3).alias("start_seconds"), F.round("end_seconds", 3).alias("end_seconds"), "n")


def moment_closing(spark: SparkSession, d: str) -> DataFrame:
    """Hits as moments that last until the next hit of the file."""
    a = load(spark, d, "assets").groupBy("asset_id").agg(F.max("duration_seconds").alias("duration"))
    m = _moments(spark, d).groupBy("asset_id", "start_seconds").agg(F.min("hit_id").alias("hit_id")).join(a, "asset_id")
    return te.close_moments(m, "asset_id", "start_seconds", "duration").select("hit_id", F.round("end_seconds", 3).alias("end_seconds"))


def sampling_grid(spark: SparkSession, d: str) -> DataFrame:
    """The number of frames to sample from each file, and the last of them."""
    a = load(spark, d, "assets").where("media_type = 'video'").select("asset_id", "duration_seconds").distinct()
    return te.sampling_grid(a, "duration_seconds").groupBy("asset_id").agg(F.count("*").alias("n"), F.round(F.max("at_seconds"), 3).alias("last_seconds"))


def keyframe_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events whose hash differs enough from the last one kept, a fold in order of time."""
    e = load(spark, d, "events").select("user_id", "event_id", F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 15), 16, 10).cast("bigint").alias("h"))
    return te.changed_frames(e, "user_id", "event_id", "h", 30).groupBy("user_id").agg(F.count("*").alias("n"))


def transcript_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Segments gathered into chunks of twelve seconds, a fold in order of time."""
    w = _segments(spark, d).select("asset_id", "start", "end", F.col("speaker").alias("text"), "confidence")
    return te.chunk_transcript(w).groupBy("asset_id").agg(F.count("*").alias("n"), F.round(F.max("end_seconds"), 3).alias("last_seconds"))


def lru_eviction(spark: SparkSession, d: str) -> DataFrame:
    """The orders to evict, oldest first, until half of the total price is left; those of status P are pinned."""
    o = load(spark, d, "orders").withColumn("pinned", F.col("o_orderstatus") == "P").withColumn("bytes", F.round("o_totalprice").cast("bigint"))
    budget = o.agg(F.floor(F.sum("bytes") / 2)).first()[0] or 0
    return te.evict_oldest(o, "bytes", "o_orderdate", "o_orderkey", budget, "pinned").select("o_orderkey")


def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Assets by level of indexing."""
    return ca.coverage(load(spark, d, "assets").select("asset_id", "indexed_levels").distinct())


def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """A2: distinct assets with texts, by kind, and those with a language."""
    return load(spark, d, "documents").groupBy("kind").agg(
        F.count_distinct("asset_id").alias("n_assets"), F.count_distinct(F.when(F.col("lang").isNotNull(), F.col("asset_id"))).alias("n_with_lang")
    )


def upsert_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets with the latest delivery of each."""
    a = load(spark, d, "assets").select("asset_id", "content_key", "loaded_at").distinct()
    return ca.upsert(a.limit(0), a, ["asset_id"], "loaded_at").select("asset_id", "content_key", F.unix_micros("loaded_at").alias("loaded_us"))


def replace_slices(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the judged cases replaced by their judgements."""
    h = load(spark, d, "evaluated_hits").select("case_id", F.col("hit_id").alias("id")).distinct()
    j = load(spark, d, "relevant_moments").where("grade = 3").select("case_id", F.col("judgement_id").alias("id")).distinct()
    return ca.replace_slices(h, j, "case_id")


def metadata_rows(spark: SparkSession, d: str) -> DataFrame:
    """Texts from names, folders and cameras."""
    return ca.metadata_rows(load(spark, d, "assets"), load(spark, d, "locations"))


def mark_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Locations after the volumes' state is known."""
    v = load(spark, d, "volumes").groupBy("volume_uuid").agg(F.max_by("is_online", "loaded_at").alias("on")).where("on").select("volume_uuid")
    return ca.mark_volumes(_locations(spark, d), v).groupBy("availability").agg(F.count("*").alias("n"))


def _locations(spark, d):
    return load(spark, d, "locations").select("location_id", "asset_id", "volume_uuid", "relative_path", "availability", "loaded_at").groupBy("location_id").agg(
        *(F.min_by(c, "loaded_at").alias(c) for c in ("asset_id", "volume_uuid", "relative_path", "availability"))
    )


def mark_missing(spark: SparkSession, d: str) -> DataFrame:
    """Online locations in a folder of a volume that a scan didn't see."""
    l = _locations(spark, d)
    volume = l.groupBy("volume_uuid").count().orderBy(F.desc("count"), "volume_uuid").first()
    seen = l.where("location_id % 2 = 0")
    out = ca.mark_missing(l, seen, volume[0] if volume else "", "voz")
    return out.groupBy("availability").agg(F.count("*").alias("n"), F.sum("location_id").alias("ids"))


def redundant_missing(spark: SparkSession, d: str) -> DataFrame:
    """Missing locations of assets that are elsewhere."""
    return ca.redundant_missing(_locations(spark, d)).select("location_id")


def orphan_repair(spark: SparkSession, d: str) -> DataFrame:
    """Locations whose asset and volume both exist."""
    l = _locations(spark, d)
    return ca.repair(l, [("asset_id", load(spark, d, "assets"), "asset_id"), ("volume_uuid", load(spark, d, "volumes"), "volume_uuid")]).select("location_id")


def best_location(spark: SparkSession, d: str) -> DataFrame:
    """Where to open each asset."""
    return fu.best_location(_locations(spark, d))


def hard_filters(spark: SparkSession, d: str) -> DataFrame:
    """hits in videos made in 2025."""
    import datetime as dt

    a = load(spark, d, "assets").select("asset_id", "media_type", "created_at").distinct()
    span = (dt.datetime(2025, 1, 1, tzinfo=dt.UTC), dt.datetime(2025, 12, 31, 23, 59, 59, tzinfo=dt.UTC))
    return fu.eligible(_moments(spark, d).select("hit_id", "asset_id"), a, "video", span)


def media_types(spark: SparkSession, d: str) -> DataFrame:
    """Type by extension against the type on record."""
    a = load(spark, d, "assets").select("asset_id", "display_name", "media_type").distinct()
    e = F.element_at(F.array(*(F.lit(x) for x in ("MXF", "braw", "r3d", "HEIC", "heif", "cr3", "DNG", "nef", "bmp", "aac", "pdf", "flac"))), (F.pmod("asset_id", F.lit(12)) + 1).cast("int"))
    kind = lambda c: F.coalesce(fi.media_type(c), F.lit("unknown"))
    return a.select("asset_id", kind(F.col("display_name")).alias("by_name"), kind(F.concat_ws(".", "display_name", e)).alias("by_camera"), "media_type")


def path_rules(spark: SparkSession, d: str) -> DataFrame:
    """safe paths, and those in a folder."""
    l = _locations(spark, d)
    return l.select("location_id", tx.safe_path(F.col("relative_path")).alias("safe"), tx.under_prefix(F.col("relative_path"), "export/").alias("inside"))


def volume_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Paths by the longest folder that holds them."""
    p = _locations(spark, d).select("relative_path").distinct().select(F.concat(F.lit("/"), F.col("relative_path")).alias("path"))
    m = spark.createDataFrame([("/", "root"), ("/export", "export"), ("/export/copia/", "copia"), ("/2025", "y2025")], "mount string, volume_uuid string")
    return ca.resolve_volume(p, m)


def snapshot_closure(spark: SparkSession, d: str) -> DataFrame:
    """The part of the catalogue on the busiest volume."""
    l = _locations(spark, d)
    volume = l.groupBy("volume_uuid").count().orderBy(F.desc("count"), "volume_uuid").first()
    a = load(spark, d, "assets").groupBy("asset_id").agg(F.max_by("indexed_levels", "loaded_at").alias("indexed_levels"))
    part = sn.closure({"volumes": load(spark, d, "volumes"), "locations": l, "assets": a}, volume[0] if volume else "")
    return part["assets"].select("asset_id", "indexed_levels")


def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    """Incoming assets with the local asset that they are, or null for new ones."""
    m = sn.asset_map(load(spark, d, "assets"), load(spark, d, "incoming_assets").withColumn("asset_id", F.xxhash64("snapshot_id", "asset_id")))
    i = load(spark, d, "incoming_assets").distinct().withColumn("old_id", F.xxhash64("snapshot_id", "asset_id"))
    return i.join(m, "old_id").select("snapshot_id", "asset_id", F.when(~F.col("is_new"), F.col("new_id")).alias("local_id"))


def channel_preferences(spark: SparkSession, d: str) -> DataFrame:
    """What channels the chosen results came from."""
    e = load(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "pin").when(F.col("event_type") == "click", "open").when(F.col("event_type") == "view", "seek").otherwise("reformulate")
    channels = F.concat_ws(",", "event_type", F.when(F.col("user_id") % 2 == 0, F.lit("visual")).otherwise(F.lit("transcript")), F.when(F.col("user_id") % 3 == 0, F.lit("ocr")))
    rows = e.select(F.col("event_id").alias("id"), kind.alias("action"), (F.col("value") * 100).cast("int").alias("dwell_milliseconds"), channels.alias("channels"))
    return us.channel_preferences(rows).select("channel", "n", "won", F.round("multiplier", 6).alias("multiplier"))


def voice_totals(spark: SparkSession, d: str) -> DataFrame:
    """What each voice says in all."""
    return pe.voice_totals(_segments(spark, d)).select("voice_id", "n_segments", F.round("seconds", 2).alias("seconds"), "n_files")


def link_proposals(spark: SparkSession, d: str) -> DataFrame:
    """The hits' case that mostly coincides with each voice."""
    s = _segments(spark, d).where("voice_id is not null").select("asset_id", "voice_id", "start", "end")
    h = _moments(spark, d).select("asset_id", F.col("hit_id").alias("person_id"), F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    return pe.link_proposals(s, h, 5.0, 0.01).select("voice_id", "person_id", F.round("shared_seconds", 3).alias("shared_seconds"), F.round("coverage", 5).alias("coverage"))


def people_like(spark: SparkSession, d: str) -> DataFrame:
    """People by name, spelled roughly."""
    p = load(spark, d, "people").where("is_named").select("person_id", "display_name").distinct()
    return pe.people_named_like(p, "Rosario", 25).select("person_id", F.round("similarity", 6).alias("similarity"))


def person_locator(spark: SparkSession, d: str) -> DataFrame:
    """When the people proposed for voices are heard, at most twelve times a file."""
    best = load(spark, d, "voice_proposals").distinct().groupBy("voice_id").agg(F.max_by("person_id", F.struct("shared_seconds", "person_id")).alias("person_id"))
    s = _segments(spark, d).join(best, "voice_id")
    w = Window.partitionBy("person_id", "asset_id").orderBy("start", "segment_id")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 12").select("person_id", "asset_id", "segment_id")


def online_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Vectors clustered in order (a fold, so without SQL)."""
    return pe.online_clusters(load(spark, d, "embeddings"), "vec_id", "embedding", 0.45).groupBy("cluster").agg(F.count("*").alias("n"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events with pauses below an hour."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


_SEG = """s as (select distinct segment_id, asset_id, lower(trim(speaker)) speaker, voice_id, start_seconds b, end_seconds e, confidence from voice_segments
  where isfinite(start_seconds) and isfinite(end_seconds) and start_seconds >= 0 and end_seconds > start_seconds)"""
_MOM = """m as (select distinct h.hit_id, a.asset_id, h.start_seconds, h.end_seconds from evaluated_hits h join (select distinct asset_id, lower(display_name) f from assets) a
  on lower(regexp_extract(h.asset_name, '[^/]*$')) = a.f where isfinite(h.start_seconds) and h.end_seconds > h.start_seconds)"""
_LOC = "l as (select location_id, nullif(arg_min(coalesce(asset_id, -99), loaded_at), -99) asset_id, nullif(arg_min(coalesce(volume_uuid, '~'), loaded_at), '~') volume_uuid, arg_min(relative_path, loaded_at) relative_path, arg_min(availability, loaded_at) availability from locations group by 1)"
_TOPV = "t as (select volume_uuid v from l group by 1 order by count(*) desc, 1 limit 1)"


def _islands(src: str, keys: str, gap: float) -> str:
    return (
        f"o as (select *, max(e) over (partition by {keys} order by b, e rows between unbounded preceding and 1 preceding) pe from {src}),"
        f" g as (select *, sum(case when pe is null or b - pe > {gap} then 1 else 0 end) over (partition by {keys} order by b, e rows unbounded preceding) run from o)"
    )


def similarity_sql(query: str) -> str:
    """CTE si: person_id, f (folded name), ws (its words), sim: how much named people resemble a query of one word."""
    fold, n = "trim(regexp_replace(lower(strip_accents(display_name)), '[^a-z0-9]+', ' ', 'g'))", len(query)
    near = lambda x: f"1 - levenshtein('{query}', {x}) / greatest(length({x}), {n})"
    return (
        f"na as (select distinct person_id, {fold} f from people where is_named and display_name is not null), wo as (select *, list_filter(string_split(f, ' '), lambda x: x <> '') ws from na),"
        f" si as (select *, case when f = '' then 0 when contains(f, '{query}') or contains('{query}', f) then 1 else greatest(list_max(list_transform(ws, lambda x: {near('x')})), {near('f')}) end sim from wo)"
    )


SQL = {
    "keyframe_filter": "with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) n, cast('0x' || substr(md5(cast(event_id as varchar)), 1, 15) as bigint) h from events),"
    " k as (select user_id, n, h as kept, true as new from e where n = 1 union all select e.user_id, e.n, case when bit_count(xor(e.h, k.kept)) >= 30 then e.h else k.kept end, bit_count(xor(e.h, k.kept)) >= 30 from k join e on e.user_id = k.user_id and e.n = k.n + 1)"
    " select user_id, count_if(new) n from k group by 1",
    "transcript_chunks": f"with recursive {_SEG}, o as (select asset_id, b, e, row_number() over (partition by asset_id order by b, e) n from s where speaker is not null),"
    " k as (select asset_id, n, 1 as c, b as f, e, e - b >= 12 as full_ from o where n = 1 union all select o.asset_id, o.n, case when k.full_ then k.c + 1 else k.c end, case when k.full_ then o.b else k.f end, o.e,"
    " o.e - case when k.full_ then o.b else k.f end >= 12 from k join o on o.asset_id = k.asset_id and o.n = k.n + 1) select asset_id, cast(max(c) as bigint) n, round(max(e), 3) last_seconds from k group by 1",
    "people_like": f"with {similarity_sql('rosario')} select person_id, round(sim, 6) similarity from si where sim >= 0.62 and (contains('rosario', f) or len(list_intersect(list_transform(range(1, length(f) - 1), lambda i: substring(f, i, 3)), ['ros', 'osa', 'sar', 'ari', 'rio'])) > 0)"
    " order by sim desc, person_id limit 25",
    "interval_overlap": f"with {_SEG}, {_MOM} select hit_id, voice_id, round(sum(least(e, end_seconds) - greatest(b, start_seconds)), 3) as seconds from m join s using (asset_id)"
    " where voice_id is not null and start_seconds < e and end_seconds > b group by 1, 2 having sum(least(e, end_seconds) - greatest(b, start_seconds)) >= 10",
    "nearest_in_time": f"with {_SEG}, {_MOM}, r as (select hit_id, segment_id, abs(b - start_seconds) d, row_number() over (partition by hit_id order by abs(b - start_seconds), b, segment_id) r from m join s using (asset_id))"
    " select hit_id request_id, segment_id row_id, round(d, 3) distance from r where r = 1",
    "nearest_in_window": f"with {_SEG}, {_MOM}, r as (select hit_id, segment_id, row_number() over (partition by hit_id order by abs(b - start_seconds), b, segment_id) r from m join s using (asset_id)"
    " where e >= start_seconds - 30 and b <= start_seconds + 30) select hit_id request_id, segment_id row_id from r where r = 1",
    "exact_or_nearest": f"with {_SEG}, {_MOM}, x as (select hit_id, min(segment_id) i from m join s using (asset_id) where b = start_seconds group by 1),"
    " r as (select hit_id, segment_id, row_number() over (partition by hit_id order by abs(b - start_seconds), b, segment_id) r from m join s using (asset_id))"
    " select m.hit_id request_id, coalesce(i, segment_id) row_id, i is not null is_exact from m left join x on x.hit_id = m.hit_id left join r on r.hit_id = m.hit_id and r.r = 1",
    "spoken_islands": f"with {_SEG}, v as (select * from s where voice_id is not null), {_islands('v', 'asset_id, voice_id', 8)}"
    " select asset_id, voice_id, round(min(b), 3) start_seconds, round(greatest(max(e), min(b) + 0.5), 3) end_seconds, count(*) n, round(avg(coalesce(confidence, 0.6)), 5) confidence from g group by asset_id, voice_id, run",
    "appearance_islands": f"with v as (select user_id, epoch_us(ts) / 1e6 b, epoch_us(ts) / 1e6 e from events), {_islands('v', 'user_id', 21600)}"
    " select user_id, round(min(b), 3) start_seconds, round(greatest(max(e), min(b) + 0.5), 3) end_seconds, count(*) n from g group by user_id, run",
    "moment_closing": f"with {_MOM}, a as (select asset_id, max(duration_seconds) du from assets group by 1), f as (select asset_id, start_seconds b, min(hit_id) hit_id from m group by 1, 2)"
    " select hit_id, round(greatest(coalesce(lead(b) over (partition by asset_id order by b), du), b), 3) end_seconds from f join a using (asset_id)",
    "sampling_grid": "with a as (select distinct asset_id, duration_seconds u from assets where media_type = 'video' and duration_seconds > 0), b as (select asset_id, greatest(5, u / 4000) w, u from a)"
    " select asset_id, cast(greatest(1, ceil(u / w)) as bigint) n, round((greatest(1, ceil(u / w)) - 1) * w, 3) last_seconds from b",
    "lru_eviction": "with o as (select o_orderkey, o_orderdate, o_orderstatus = 'P' pinned, cast(round(o_totalprice) as bigint) b from orders), t as (select sum(b) t, floor(sum(b) / 2) h from o),"
    " f as (select o_orderkey, coalesce(sum(b) over (order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0) gone from o where not pinned) select o_orderkey from f, t where t - gone > h",
    "coverage_stats": "with a as (select distinct asset_id, indexed_levels l from assets) select count(*) assets, count_if(l & 1 <> 0) metadata, count_if(l & 2 <> 0) visual, count_if(l & 4 <> 0) spoken, count_if(l & 8 <> 0) deep from a",
    "distinct_counts": "select kind, count(distinct asset_id) n_assets, count(distinct case when lang is not null then asset_id end) n_with_lang from documents group by 1",
    "upsert_assets": "with r as (select *, row_number() over (partition by asset_id order by loaded_at desc, content_key) r from (select distinct asset_id, content_key, loaded_at from assets)) select asset_id, content_key, epoch_us(loaded_at) loaded_us from r where r = 1",
    "replace_slices": "with j as (select distinct case_id, judgement_id id from relevant_moments where grade = 3) select distinct case_id, hit_id id from evaluated_hits where case_id not in (select case_id from j) union all select case_id, id from j",
    "metadata_rows": "with t as (select asset_id, 'filename' kind, display_name as text from assets union select asset_id, 'metadata', concat_ws(' ', camera_make, camera_model) from assets"
    " union select asset_id, 'folder', regexp_replace(relative_path, '/?[^/]*$', '') from locations where asset_id > 0) select distinct * from t where trim(text) <> ''",
    "mark_volumes": f"with {_LOC}, v as (select volume_uuid from volumes group by 1 having arg_max(is_online, loaded_at)) select case when availability in ('online', 'offline') then"
    " case when volume_uuid in (select volume_uuid from v) then 'online' else 'offline' end else availability end availability, count(*) n from l group by 1",
    "mark_missing": f"with {_LOC}, {_TOPV} select case when volume_uuid = v and (relative_path = 'voz' or starts_with(relative_path, 'voz/')) and availability = 'online' and not exists"
    " (select 1 from l x where x.location_id % 2 = 0 and x.volume_uuid = l.volume_uuid and x.relative_path = l.relative_path) then 'missing' else availability end availability, count(*) n, cast(sum(location_id) as bigint) ids from l, t group by 1",
    "redundant_missing": f"with {_LOC} select location_id from l where availability = 'missing' and asset_id in (select asset_id from l where availability in ('online', 'offline') and asset_id is not null)",
    "orphan_repair": f"with {_LOC} select location_id from l where (asset_id is null or asset_id in (select asset_id from assets)) and (volume_uuid is null or volume_uuid in (select volume_uuid from volumes))",
    "best_location": f"with {_LOC}, r as (select *, row_number() over (partition by asset_id order by list_position(['online', 'offline', 'moved', 'missing'], availability), location_id) r from l where asset_id is not null) select asset_id, location_id, availability from r where r = 1",
    "hard_filters": f"with {_MOM} select hit_id, asset_id from m where asset_id in (select asset_id from assets where media_type = 'video' and created_at between timestamptz '2025-01-01 00:00:00+00' and timestamptz '2025-12-31 23:59:59+00')",
    "media_types": "with m(e, kind) as (select unnest(string_split('mov mp4 m4v avi mkv mxf mts m2ts mpg mpeg webm braw r3d', ' ')), 'video'"
    " union all select unnest(string_split('jpg jpeg png heic heif tif tiff dng cr2 cr3 nef arw raf orf webp gif', ' ')), 'image' union all select unnest(string_split('wav aiff aif m4a mp3 caf flac', ' ')), 'audio'),"
    " a as (select distinct asset_id, media_type, lower(regexp_extract(display_name, '\\.([^./]+)$', 1)) e,"
    " ['mxf', 'braw', 'r3d', 'heic', 'heif', 'cr3', 'dng', 'nef', 'bmp', 'aac', 'pdf', 'flac'][asset_id % 12 + 1] x from assets)"
    " select asset_id, coalesce(m.kind, 'unknown') by_name, coalesce(n.kind, 'unknown') by_camera, media_type from a left join m using (e) left join m n on n.e = a.x",
    "path_rules": f"with {_LOC} select location_id, relative_path <> '' and not starts_with(relative_path, '/') and not list_contains(string_split(relative_path, '/'), '..') as safe, relative_path = 'export' or starts_with(relative_path, 'export/') inside from l",
    "volume_resolution": f"with {_LOC}, p as (select distinct '/' || relative_path path from l), x(mount, v) as (values ('', 'root'), ('/export', 'export'), ('/export/copia', 'copia'), ('/2025', 'y2025')),"
    " r as (select path, mount, v, row_number() over (partition by path order by length(mount) desc) r from p join x on path = mount or starts_with(path, mount || '/'))"
    " select path, v volume_uuid, regexp_replace(substring(path, length(mount) + 1), '^/+', '') relative_path from r where r = 1",
    "snapshot_closure": f"with {_LOC}, {_TOPV} select asset_id, cast(arg_max(indexed_levels, loaded_at) & ~8 as int) indexed_levels from assets where asset_id in (select asset_id from l, t where volume_uuid = v and asset_id is not null) group by 1",
    "snapshot_merge": "with k as (select content_key, min(asset_id) a from assets group by 1) select distinct snapshot_id, asset_id, a local_id from incoming_assets left join k using (content_key)",
    "channel_preferences": "with r as (select event_id, case when event_type in ('purchase', 'click') then 1 when event_type = 'view' and cast(trunc(value * 100) as int) >= 3000 then 1 else 0 end won,"
    " list_filter([event_type, case when user_id % 2 = 0 then 'visual' else 'transcript' end, case when user_id % 3 = 0 then 'ocr' end], lambda x: x is not null) ch from events order by event_id desc limit 2000),"
    " t as (select count(*) an, sum(won) aw from r), p as (select unnest(ch) channel, won from r), c as (select channel, count(*) n, sum(won) w from p group by 1)"
    " select channel, n, cast(w as bigint) won, round(case when n < 10 then 1 else least(1.15, greatest(0.85, ((w + 20 * ((aw + 10) / (an + 20))) / (n + 20)) / ((aw + 10) / (an + 20)))) end, 6) multiplier from c, t where an >= 200 and aw > 0 and aw < an",
    "voice_totals": f"with {_SEG} select voice_id, count(*) n_segments, round(sum(e - b), 2) as seconds, count(distinct asset_id) n_files from s where voice_id is not null group by 1",
    "link_proposals": f"with {_SEG}, {_MOM}, v as (select distinct asset_id, voice_id, b, e, segment_id from s where voice_id is not null), p as (select voice_id, hit_id, sum(least(e, end_seconds) - greatest(b, start_seconds)) q from v join m using (asset_id) where b < end_seconds and e > start_seconds group by 1, 2),"
    " t as (select voice_id, sum(e - b) z from v group by 1), r as (select p.*, least(1, q / z) c, row_number() over (partition by voice_id order by q desc, hit_id) r from p join t using (voice_id) where q >= 5 and least(1, q / z) >= 0.01)"
    " select voice_id, hit_id person_id, round(q, 3) shared_seconds, round(c, 5) coverage from r where r = 1",
    "person_locator": f"with {_SEG}, pr as (select voice_id, person_id, row_number() over (partition by voice_id order by shared_seconds desc, person_id desc) r from (select distinct * from voice_proposals)),"
    " q as (select person_id, asset_id, segment_id, row_number() over (partition by person_id, asset_id order by b, segment_id) n from s join pr using (voice_id) where r = 1) select person_id, asset_id, segment_id from q where n <= 12",
    "event_sessions": "with o as (select user_id, epoch_us(ts) t, lag(epoch_us(ts)) over (partition by user_id order by ts) p from events), g as (select *, sum(case when p is null or t - p > 3600000000 then 1 else 0 end) over (partition by user_id order by t rows unbounded preceding) run from o)"
    " select user_id, min(t) start_us, max(t) last_us, count(*) n from g group by user_id, run",
}

QUERIES = {
    f.__name__: f
    for f in (
        interval_overlap, nearest_in_time, nearest_in_window, exact_or_nearest, spoken_islands, appearance_islands, moment_closing, sampling_grid, keyframe_filter, transcript_chunks,
        lru_eviction, coverage_stats, distinct_counts, upsert_assets, replace_slices, metadata_rows, mark_volumes, mark_missing, redundant_missing, orphan_repair, best_location,
        hard_filters, media_types, path_rules, volume_resolution, snapshot_closure, snapshot_merge, channel_preferences, voice_totals, link_proposals, people_like, person_locator,
        online_clusters, event_sessions,
    )
}
