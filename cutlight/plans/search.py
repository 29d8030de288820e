"""The composed search: channels, fusion, ranking, hydration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlight.functions.text import clamp, fold_text, name_overlap, term_coverage, text_confidence, timecode, tokens
from cutlight.functions.vectors import visual_confidence, z_score
from cutlight.operators.fusion import best_location, eligible, fuse, ordering, trim
from cutlight.operators.people import people_named_like
from cutlight.operators.text_search import TextIndex, bm25, grouped_top_k, label_frequency, search_index, text_rows
from cutlight.operators.vector_search import exact_top_k, library_statistics, rerank, stride_sample
from cutlight.plans.planner import SearchPlan

# The channel that each kind of text feeds.
CHANNEL_OF_KIND = {"transcript": "transcript", "ocr": "ocr", "filename": "metadata", "folder": "metadata", "metadata": "metadata", "note": "metadata", "label": "label"}


@dataclass(frozen=True)
class Options:
    limit: int = 20
    depth: int = 300
    window: float = 30.0
    mode: str = "confidence"
    least_confidence: float = 0.0
    visual_floor: float = 0.18
    visual_ceiling: float = 0.26
    z_floor: float = 3.0
    z_ceiling: float = 6.0


def text_candidates(rows: DataFrame, patterns: list[str], terms: list[str], depth: int, index: TextIndex | None = None) -> DataFrame:
    """Candidates of all text channels from one scan, or from a stored index of the rows.

    rows: row_id, asset_id, moment_id, kind, text, start_seconds, end_seconds. Scores use
    the statistics of all kinds; the split by channel comes after them.
    """
    channel = F.create_map(*(F.lit(x) for kv in CHANNEL_OF_KIND.items() for x in kv))
    scored = search_index(index, patterns) if index is not None else bm25(text_rows(rows, "row_id", "text"), patterns)
    full = scored.join(rows.withColumn("channel", F.try_element_at(channel, F.col("kind"))), "row_id").where("channel is not null")
    best = grouped_top_k(full, "channel", depth)
    confidence = text_confidence(term_coverage(F.col("text"), terms), F.col("rank_no") - 1)
    return best.select(
        "asset_id", "moment_id", F.coalesce("start_seconds", F.lit(0.0)).alias("seconds"), F.coalesce("end_seconds", "start_seconds", F.lit(0.0)).alias("end_seconds"),
        "channel", "rank_no", confidence.alias("confidence"),
    )


def label_candidates(hits: DataFrame, labels: DataFrame, phrases: list[str], least_rarity: float = 0.35) -> DataFrame:
    """Confidence of label hits: words of the label that the phrases hold, decayed by rank, times its rarity.

    hits: asset_id, moment_id, identifier, rank_no. labels: identifier, asset_id, of the
    whole library. Labels that are common in it, or share no word, don't come out.
    """
    heard = " ".join(map(fold_text, phrases))
    words = tokens(F.replace(F.col("identifier"), F.lit("_"), F.lit(" ")))
    share = F.size(F.filter(words, lambda w: F.contains(F.lit(heard), w))) / F.greatest(F.size(words), F.lit(1))
    rare = label_frequency(labels, "identifier", "asset_id").select("identifier", "rarity")
    scored = hits.join(rare, "identifier", "left").withColumn("rarity", F.coalesce("rarity", F.lit(1.0)))
    confidence = text_confidence(share, F.col("rank_no") - 1) * F.col("rarity")
    return scored.where((F.col("rarity") >= least_rarity) & (share > 0)).withColumn("confidence", confidence).select("asset_id", "moment_id", "identifier", "rank_no", "confidence")


def person_candidates(query: str, people: DataFrame, appearances: DataFrame, depth: int = 10) -> DataFrame:
    """Candidates of the person channel: where people whose name resembles the query appear.

    people: person_id, display_name. appearances: person_id, asset_id, start_seconds,
    end_seconds, confidence.
    """
    found = people_named_like(people, query, depth)
    found = found.withColumn("rank_no", F.row_number().over(Window.orderBy(F.desc("similarity"), "person_id")))
    strength = F.greatest(term_coverage(F.col("name"), [query]), name_overlap(F.lit(query), F.col("name")))
    seen = F.broadcast(found).join(appearances, "person_id")  # at most `depth` people
    confidence = F.least(F.lit(1.0), text_confidence(strength, F.col("rank_no") - 1) * clamp(F.col("confidence")))
    return seen.select(
        "asset_id", F.lit(None).cast("bigint").alias("moment_id"), F.col("start_seconds").alias("seconds"), "end_seconds", F.lit("person").alias("channel"), "rank_no", confidence.alias("confidence")
    )


def evidence_label(channel: Column, text: Column, seconds: Column, most: int = 60) -> Column:
    """What a result says about itself, per channel; long texts are cut."""
    short = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)
    return F.format_string("%s: %s (%s)", channel, F.coalesce(short, F.lit("")), timecode(seconds))


def visual_candidates(moments: DataFrame, query: Column, options: Options, by_surprise: bool = False) -> DataFrame:
    """Candidates of the visual channel.

    moments: moment_id, asset_id, start_seconds, end_seconds, embedding. With by_surprise
    the floor is on deviations above this query's mean similarity to a sample.
    """
    hits = exact_top_k(moments, "moment_id", "embedding", query, options.depth)
    if by_surprise:
        stats = library_statistics(stride_sample(moments, "moment_id", 1024), "embedding", query)
        hits = hits.join(F.broadcast(stats)).withColumn("s", z_score(F.col("similarity"), F.col("mean"), F.col("deviation")))
        floor, ceiling = options.z_floor, options.z_ceiling
    else:
        hits = hits.withColumn("s", F.col("similarity"))
        floor, ceiling = options.visual_floor, options.visual_ceiling
    kept = hits.where(F.col("s") >= floor).withColumnRenamed("row_id", "moment_id").join(moments.drop("embedding"), "moment_id")
    return kept.select(
        "asset_id", "moment_id", F.col("start_seconds").alias("seconds"), "end_seconds", F.lit("visual").alias("channel"), "rank_no",
        visual_confidence(F.col("s"), floor, ceiling).alias("confidence"),
    )


def ranked(candidates: DataFrame, assets: DataFrame, plan: SearchPlan, options: Options) -> DataFrame:
    """Filters (after the channels' top-k, as earlier would give other rows), fusion, order and trim."""
    kept = eligible(candidates, assets, plan.media_type, plan.created)
    return trim(ordering(fuse(kept, options.window), options.mode), options.limit, options.least_confidence)


def hydrate(results: DataFrame, assets: DataFrame, locations: DataFrame, volumes: DataFrame) -> DataFrame:
    """Results with file name, best location and whether its volume is online. Offline files stay."""
    few = F.broadcast(results)  # at most `limit` rows
    named = assets.select("asset_id", "display_name", "media_type").dropDuplicates(["asset_id"]).join(few, "asset_id")
    place = best_location(locations.join(F.broadcast(results.select("asset_id").distinct()), "asset_id", "left_semi"))
    where = locations.select("location_id", "volume_uuid", "relative_path").dropDuplicates(["location_id"]).join(F.broadcast(place), "location_id")
    online = volumes.groupBy("volume_uuid").agg(F.max("is_online").alias("is_online"))
    return named.join(where, "asset_id", "left").join(online, "volume_uuid", "left")


def search(plan: SearchPlan, text: DataFrame, assets: DataFrame, patterns: list[str], moments: DataFrame | None = None, query_vector: Column | None = None, options: Options = Options(), index: TextIndex | None = None) -> DataFrame:
    """The ranked moments for a plan; without vectors the text channels alone answer."""
    candidates = text_candidates(text, patterns, list(plan.literal), options.depth, index)
    if moments is not None and query_vector is not None and plan.visual:
        candidates = candidates.unionByName(visual_candidates(moments, query_vector, options))
    return ranked(candidates, assets, plan, options)


def reranked(results: DataFrame, second: DataFrame, share: float = 0.35, depth: int = 40) -> DataFrame:
    """Results in the order of confidences blended with a second opinion (moment_id, confidence2) on the first `depth`."""
    opinion = results.join(second, "moment_id").select(F.col("position").alias("row_id"), "confidence2")
    new = rerank(results.select(F.col("position").alias("row_id"), "confidence", F.col("position").alias("rank_no")), opinion, share, depth)
    moved = results.drop("confidence").join(new.select(F.col("row_id").alias("position"), "confidence", "rank_no"), "position")
    return moved.withColumn("position", F.col("rank_no")).drop("rank_no")


def progressive(plan: SearchPlan, text: DataFrame, assets: DataFrame, patterns: list[str], moments: DataFrame | None = None, query_vector: Column | None = None, options: Options = Options(), second: DataFrame | None = None) -> Iterator[tuple[str, bool, DataFrame]]:
    """(phase, final, results): first by text, then with vectors, then reranked if there is a second opinion. Each is computed when it is read, so a caller may stop."""
    more = moments is not None and query_vector is not None and bool(plan.visual)
    yield "fast", not more and second is None, search(plan, text, assets, patterns, options=options)
    best = search(plan, text, assets, patterns, moments, query_vector, options) if more or second is not None else None
    if more:
        yield "refined", second is None, best
    if second is not None:
        yield "reranked", True, reranked(best, second)
