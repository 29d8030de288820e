"""Identities: online clustering, consolidation, appearances, proposals, names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlight.functions.text import fold, name_similarity, trigrams
from cutlight.operators.temporal import islands, overlap_join


def face_gate(width: Column, frame_width: Column, quality: Column, yaw: Column) -> Column:
    """F8: at least 64 pixels wide; quality and yaw count if known."""
    return F.coalesce((width * frame_width >= 64) & (F.coalesce(quality, F.lit(1.0)) >= 0.35) & (F.abs(F.coalesce(yaw, F.lit(0.0))) <= 45), F.lit(False))


def assign_in_order(vectors: np.ndarray, least: float) -> np.ndarray:
    """For each row the number of its cluster: the best centroid so far if near enough, else a new one."""
    sums: list[np.ndarray] = []
    cents = np.zeros((0, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i, v in enumerate(vectors):
        s = cents @ v if len(cents) else np.zeros(0)
        k = int(s.argmax()) if len(s) else -1
        if k < 0 or s[k] < least:
            k = len(sums)
            sums.append(np.zeros_like(v))
            cents = np.vstack([cents, np.zeros_like(v)[None]])
        sums[k] = sums[k] + v
        n = np.linalg.norm(sums[k])
        cents[k] = sums[k] / n if n > 1e-12 else sums[k]
        out[i] = k
    return out


def online_clusters(rows: DataFrame, row_id: str, vector: str, least: float, group: str | None = None) -> DataFrame:
    """row_id, cluster: clusters in order of row_id, numbered by their first row.

    The result depends on that order, so a group (a model or dimension) is one task; for
    collections beyond a task use clusters that don't depend on it.
    """
    g = F.col(group) if group else F.size(vector)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        x = np.stack(pdf["v"].map(lambda a: np.asarray(a, np.float64)).tolist())
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.where(n > 1e-12, x / np.maximum(n, 1e-12), x)
        ids = pdf["row_id"].to_numpy()
        k = assign_in_order(x, least)
        first = pd.Series(ids).groupby(k).transform("min")
        return pd.DataFrame({"row_id": ids, "cluster": first.to_numpy()})

    chosen = rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(vector).cast("array<double>").alias("v"), g.alias("g")).where("size(v) > 0")
    return chosen.groupBy("g").applyInPandas(run, "row_id bigint, cluster bigint")


def consolidate(people: list[dict], least: float, split: set[frozenset] = frozenset()) -> dict[int, int]:
    """Person -> survivor, merging pairs of similar centroids one after the other.

    people: person_id, sum (vector), n, named. Pairs that are both named, or that a user has
    split, stay apart; a named person survives, else the larger; centroids are refreshed
    after each merge. For the driver: the table of people is small beside their faces.
    """
    alive = {p["person_id"]: dict(p, sum=np.asarray(p["sum"], float)) for p in people}
    to = {i: i for i in alive}
    apart = set(split)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    moved = True
    while moved:
        moved = False
        ids = sorted(alive)
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                if a not in alive or b not in alive or frozenset((a, b)) in apart or alive[a]["named"] and alive[b]["named"]:
                    continue
                if float(unit(alive[a]["sum"]) @ unit(alive[b]["sum"])) >= least:
                    keep, gone = (b, a) if alive[b]["named"] and not alive[a]["named"] or (alive[a]["named"] == alive[b]["named"] and alive[b]["n"] > alive[a]["n"]) else (a, b)
                    alive[keep]["sum"] = alive[keep]["sum"] + alive[gone]["sum"]
                    alive[keep]["n"] += alive[gone]["n"]
                    alive[keep]["named"] |= alive[gone]["named"]
                    apart |= {frozenset((keep, x)) for p in list(apart) if gone in p for x in p if x != gone}
                    del alive[gone]
                    to = {k: keep if v == gone else v for k, v in to.items()}
                    moved = True
    return to


def appearances(rows: DataFrame, person: str, asset: str, gap: float, unknown: float) -> DataFrame:
    """When each person can be seen or heard in each file. rows: person, asset, start, end, quality."""
    return islands(rows, [person, asset], gap, quality="quality", unknown=unknown)


def link_proposals(voice: DataFrame, people: DataFrame, least_seconds: float = 10.0, least_share: float = 0.6) -> DataFrame:
    """For each voice the person who is seen most while it speaks: voice_id, person_id, shared_seconds, coverage.

    voice: asset_id, voice_id, start, end (disjoint for a voice). people: asset_id, person_id, start, end.
    """
    v = voice.select("asset_id", F.col("voice_id").alias("left_id"), F.col("start").alias("start_a"), F.col("end").alias("end_a"))
    p = people.select("asset_id", F.col("person_id").alias("right_id"), F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    shared = overlap_join(v, p, "asset_id").groupBy("left_id", "right_id").agg(F.sum("seconds").alias("shared_seconds")).where(F.col("shared_seconds") >= least_seconds)
    spoken = v.groupBy("left_id").agg(F.sum(F.col("end_a") - F.col("start_a")).alias("spoken"))
    scored = shared.join(spoken, "left_id").withColumn("coverage", F.least(F.lit(1.0), F.col("shared_seconds") / F.col("spoken"))).where(F.col("coverage") >= least_share)
    w = Window.partitionBy("left_id").orderBy(F.desc("shared_seconds"), "right_id")
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("left_id").alias("voice_id"), F.col("right_id").alias("person_id"), "shared_seconds", "coverage")


def people_named_like(people: DataFrame, query: str, limit: int = 10, least: float = 0.62) -> DataFrame:
    """person_id, name, similarity of the people whose name resembles a query.

    People that share a trigram with the query are compared (all, if it is shorter than
    three letters); the best `limit` of `least` or more come out.
    """
    q = F.lit(query)
    named = people.where("display_name is not null")
    near = named.where((F.length(fold(q)) < 3) | F.arrays_overlap(trigrams("display_name"), trigrams(q)) | F.contains(fold(q), fold("display_name")))
    scored = near.select("person_id", F.col("display_name").alias("name"), name_similarity(q, F.col("display_name")).alias("similarity"))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "person_id").limit(limit)


def merge_people(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Faces with the surviving person. mapping: person_id, survivor."""
    m = mapping.select("person_id", "survivor").distinct()
    return faces.join(m, "person_id", "left").withColumn("person_id", F.coalesce("survivor", "person_id")).drop("survivor").select(*faces.columns)


def reassign_faces(faces: DataFrame, automatic: DataFrame) -> DataFrame:
    """Faces (face_id, person_id, assigned_by) with new automatic persons; what a user assigned stays."""
    a = automatic.select("face_id", F.col("person_id").alias("_auto"))
    kept = (F.col("assigned_by") == "user") | F.col("_auto").isNull()
    return faces.join(a, "face_id", "left").withColumn("person_id", F.when(kept, F.col("person_id")).otherwise(F.col("_auto"))).drop("_auto").select(*faces.columns)


def voice_totals(segments: DataFrame) -> DataFrame:
    """voice_id, n_segments, seconds, n_files."""
    return segments.where("voice_id is not null").groupBy("voice_id").agg(
        F.count("*").alias("n_segments"), F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count_distinct("asset_id").alias("n_files")
    )
