"""References to records that do not exist.

References and the loads and removals of their parent keys go through one shuffle,
are sorted by key and time, and are merged in one linear pass: each reference takes
the state that its key has at that moment. A key that holds many references is split
over several salts, and its (few) parent rows are copied to each of them; how many
keys that concerns is bounded by four times the number of shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlight.session import shuffle_width


def uuid_key(c: Column) -> Column:
    """A UUID without regard to case, outer blanks and braces."""
    return F.regexp_replace(F.lower(c), r"^[\s{]+|[\s}]+$", "")


def missing_references(references: DataFrame, loads: DataFrame, removals: DataFrame) -> DataFrame:
    """References whose key was not live when they were made, or is not live at the end.

    references: child_table, child_column, row_id, parent_table, key, at.
    loads and removals: parent_table, key, at.

    Returns child_table, child_column, row_id, period_month (UTC, yyyy-MM) and status:
    ``missing`` (the key was never loaded), ``late`` (not live then, live at the end),
    ``deleted`` (live then, not at the end) or ``deleted_before`` (loaded once, but
    live at neither time). One row for each distinct row_id of a column.

    A key is live at a time if the latest record for it up to and including that time
    is a load; a removal at the very time of a load wins. Rows with a null key are no
    references; a null time of a reference counts as before everything, and a load or
    removal without a time is no event. Repeated rows count once. Empty inputs give an
    empty result, or, without parents, every reference as missing.
    """
    spark = references.sparkSession
    width = 4 * shuffle_width(spark)
    key = ["parent_table", "key"]
    refs = references.select("child_table", "child_column", "row_id", *key, "at").where("key is not null").distinct()

    counts = refs.groupBy(*key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # at most `width` keys can hold more than total / width rows each
    hot = (
        counts.join(F.broadcast(total))
        .where(F.col("n") > F.greatest(F.lit(10_000), F.col("total") / width))
        .select(*key, F.ceil(F.col("n") * width / F.col("total")).cast("int").alias("salts"))
    )
    hot = F.broadcast(hot)

    none = F.lit(None)
    events = (
        loads.select(*key, "at", F.lit(1).alias("state"))
        .unionByName(removals.select(*key, "at", F.lit(0).alias("state")))
        .where("key is not null and at is not null")
        .distinct()
    )
    final = events.groupBy(*key).agg(F.max_by("state", F.struct("at", -F.col("state"))).alias("final"), F.max("state").alias("ever"))
    parents = (
        events.select(*key, "at", "state", none.cast("int").alias("final"), none.cast("int").alias("ever"))
        .unionByName(final.select(*key, none.cast("timestamp").alias("at"), F.lit(0).alias("state"), "final", "ever"))
        .join(hot, key, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .drop("salts")
    )
    children = (
        refs.join(hot, key, "left")
        .withColumn("salt", F.pmod(F.xxhash64("row_id"), F.coalesce("salts", F.lit(1))).cast("int"))
        .drop("salts")
    )
    stream = parents.withColumns({"child_table": none.cast("string"), "child_column": none.cast("string"), "row_id": none.cast("bigint")}).withColumn(
        # at one time: the summary, loads, removals, then references
        "turn", F.when(F.col("final").isNotNull(), 0).when(F.col("state") == 1, 1).otherwise(2)
    ).unionByName(children.withColumns({"state": none.cast("int"), "final": none.cast("int"), "ever": none.cast("int"), "turn": F.lit(3)}))
    so_far = (
        Window.partitionBy(*key, "salt")
        .orderBy(F.col("at").asc_nulls_first(), "turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = stream.select(
        "child_table", "child_column", "row_id", "at", "turn",
        *(F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(0)).alias(c) for c in ("state", "final", "ever")),
    )
    # a reference without a time sorts among the summaries, which come first
    return (
        seen.where("turn = 3 and (state = 0 or final = 0)")
        .select(
            "child_table", "child_column", "row_id",
            F.date_format("at", "yyyy-MM").alias("period_month"),
            F.when(F.col("ever") == 0, "missing")
            .when(F.col("final") == 1, "late")
            .when(F.col("state") == 1, "deleted")
            .otherwise("deleted_before")
            .alias("status"),
        )
    )


def catalogue_references(locations: DataFrame, asset_map: DataFrame) -> DataFrame:
    """The references of a catalogue, in the form that missing_references takes.

    Of a location or map row with several load times the earliest counts. Numbers that
    are null, 0 or negative are no references.
    """
    first = locations.groupBy("location_id").agg(
        F.min_by(F.struct("asset_id", "volume_uuid"), "loaded_at").alias("row"), F.min("loaded_at").alias("at")
    )
    by_asset = first.where("row.asset_id > 0").select(
        F.lit("locations").alias("child_table"), F.lit("asset_id").alias("child_column"), F.col("location_id").alias("row_id"),
        F.lit("assets").alias("parent_table"), F.col("row.asset_id").cast("string").alias("key"), "at",
    )
    by_volume = first.where("row.volume_uuid is not null").select(
        F.lit("locations").alias("child_table"), F.lit("volume_uuid").alias("child_column"), F.col("location_id").alias("row_id"),
        F.lit("volumes").alias("parent_table"), uuid_key(F.col("row.volume_uuid")).alias("key"), "at",
    )
    mapped = (
        asset_map.groupBy("map_id").agg(F.min_by(F.struct("snapshot_id", "old_id"), "loaded_at").alias("row"), F.min("loaded_at").alias("at"))
        .where("row.old_id > 0")
        .select(
            F.lit("wf_asset_map").alias("child_table"), F.lit("old_id").alias("child_column"), F.col("map_id").alias("row_id"),
            F.lit("incoming_assets").alias("parent_table"),
            F.concat_ws("/", "row.snapshot_id", F.col("row.old_id").cast("string")).alias("key"), "at",
        )
    )
    return by_asset.unionByName(by_volume).unionByName(mapped)


def catalogue_parents(assets: DataFrame, volumes: DataFrame, incoming: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loads and removals of the parent keys of a catalogue."""
    loads = (
        assets.select(F.lit("assets").alias("parent_table"), F.col("asset_id").cast("string").alias("key"), F.col("loaded_at").alias("at"))
        .unionByName(volumes.select(F.lit("volumes").alias("parent_table"), uuid_key(F.col("volume_uuid")).alias("key"), F.col("loaded_at").alias("at")))
        .unionByName(
            incoming.select(
                F.lit("incoming_assets").alias("parent_table"),
                F.concat_ws("/", "snapshot_id", F.col("asset_id").cast("string")).alias("key"),
                F.col("loaded_at").alias("at"),
            )
        )
    )
    removals = removed.select(
        "parent_table",
        F.when(F.col("parent_table") == "volumes", uuid_key(F.col("parent_key"))).otherwise(F.col("parent_key")).alias("key"),
        F.col("removed_at").alias("at"),
    )
    return loads, removals
