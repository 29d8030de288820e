import numpy as np
import pytest
from pyspark.sql import functions as F

from cutlight.llm import cells as ce
from cutlight.llm import graph as gr
from cutlight.llm import neighbours as nb
from cutlight.llm.clusters import communities, components, describe_clusters, similarity_clusters
from cutlight.llm.neighbours import nearest
from tests.conftest import rows_of

SCHEMA = "segment_id bigint, model_id string, dimensions int, embedding array<float>, voice_id bigint, cell int, space int"


def made(seed=0, groups=12, each=25, noise=30, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    x = [c / np.linalg.norm(c) + 0.06 * rng.normal(size=d) for c in centres for _ in range(each)] + list(rng.normal(size=(noise, d)))
    voice = [k + 1 for k in range(groups) for _ in range(each)] + [None] * noise
    return np.array(x, np.float32) * rng.uniform(0.5, 3, (len(x), 1)).astype(np.float32), voice


@pytest.fixture
def segments(spark):
    x, voice = made()
    rows = [(i, "m" if i % 7 else "n", x.shape[1], v.tolist(), k, 1, 1) for i, (v, k) in enumerate(zip(x, voice))]
    bad = [(9001, "m", 24, None, 1, 1, 1), (9002, "m", 24, [], 1, 1, 1), (9003, "m", 24, [1.0] * 23, 1, 1, 1), (9004, "m", 24, [0.0] * 24, 1, 1, 1), (9005, "m", 24, [float("nan")] * 24, 1, 1, 1),
           (9006, "m", 24, [float("inf")] + [1.0] * 23, 1, 1, 1), (9007, None, 24, [1.0] * 24, 1, 1, 1), (9008, "o", 2, [1.0, 1.0], None, 1, 1)]
    return spark.createDataFrame(rows + rows[:40] + bad, SCHEMA), rows


def groups(rows):
    """row numbers by model, unit rows."""
    for m in "mn":
        own = [r for r in rows if r[1] == m]
        x = np.array([r[3] for r in own], np.float64)
        yield own, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_is_exact(segments, spark):
    df, rows = segments
    asked = df.where("segment_id % 5 = 0").select("segment_id").union(spark.range(9001, 9009).toDF("segment_id"))
    got = {}
    for r in nearest(df, asked).collect():
        got.setdefault(r["query"], {})[r["rank_no"]] = (r["id"], r["sim"])
    want = {}
    for own, u in groups(rows):
        s = u @ u.T
        np.fill_diagonal(s, -9)
        for i, r in enumerate(own):
            if r[0] % 5 == 0:
                want[r[0]] = [own[j][0] for j in np.lexsort(([o[0] for o in own], -s[i]))[:5]]
    assert {k: [v[n][0] for n in range(1, 6)] for k, v in got.items()} == want


def test_nearest_meets_all_vectors(spark, monkeypatch):
    """Lone vectors, equal ones under many ids and repeated rows, over several products and rounds: as by brute force."""
    monkeypatch.setattr(nb, "TILE", (16, 64))
    monkeypatch.setattr(nb, "HELD", 40)
    x = np.random.default_rng(5).normal(size=(3_000, 48)).astype(np.float32)
    x[2_000:2_030] = x[7]
    rows = [(i, "m", 48, v.tolist(), None, 1, 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:200], SCHEMA).repartition(3)
    got = {}
    for r in nb.nearest(df, df.where("segment_id % 25 = 7").select("segment_id")).collect():
        got.setdefault(r["query"], {})[r["rank_no"]] = r["id"]
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert len(got) == 120 and sorted(got[7].values()) == list(range(2_000, 2_005))
    for q, own in got.items():
        s = np.round(y @ y[q], 12)
        s[q] = -9
        assert [own[n] for n in range(1, 6)] == np.lexsort((np.arange(len(s)), -s))[:5].tolist()


def test_few_rows(table):
    one = table(SCHEMA, (1, "m", 2, [1.0, 0.0], None, 1, 1), (2, "m", 2, [1.0, 0.1], None, 1, 1))
    assert rows_of(nearest(one, one.select("segment_id")).select("query", "id", "rank_no")) == [(1, 2, 1), (2, 1, 1)]
    empty = table(SCHEMA)
    assert nearest(empty, empty.select("segment_id")).count() == 0 == similarity_clusters(empty).count() == describe_clusters(empty).count()
    assert nearest(one, empty.select("segment_id")).count() == 0


def test_clusters(segments):
    df, rows = segments
    want = set()
    for own, u in groups(rows):
        near = u @ u.T >= 0.8
        label = np.arange(len(own))
        for _ in range(20):
            label = np.array([label[near[i]].min() for i in range(len(own))])
        for k in np.unique(label):
            at = np.flatnonzero(label == k)
            votes = [own[i][4] for i in at if own[i][4] is not None]
            if len(at) > 1:
                key = min(set(votes), key=lambda v: (-votes.count(v), v)) if votes else -min(own[i][0] for i in at)
                want |= {(own[i][0], key, len(at)) for i in at}
    assert set(rows_of(similarity_clusters(df))) == want
    report = describe_clusters(df).collect()
    assert sum(r.size for r in report) == len(want) and all(len(r.typical) == min(3, r.size) and 0.5 < r.centrality <= 1 for r in report)


def test_cluster_without_votes(table):
    df = table(SCHEMA, (5, "m", 2, [1.0, 0.0], None, 1, 1), (3, "m", 2, [2.0, 0.1], None, 1, 1), (9, "m", 2, [0.0, 1.0], 4, 1, 1))
    assert rows_of(similarity_clusters(df)) == [(3, -3, 2), (5, -3, 2)]


def test_packing_and_codes():
    x = np.random.default_rng(1).normal(size=(7, 5)).astype(np.float32)
    assert (ce.unpack(ce.pack(x), 7) == x).all()
    u = ce.unit(np.array([[1e30, 1e30], [1e-30, 0]], np.float32))
    assert np.allclose(u, [[0.5**0.5] * 2, [1, 0]])
    assert np.abs(gr.decode([gr.code(r) for r in x]) - ce.unit(x)).max() < 0.01
    sizes = [len(g) for g in ce.leaders(ce.unit(np.repeat(np.eye(3, dtype=np.float32), 400, 0)), 0.8)]
    assert sizes == [400, 400, 400]


def test_descent_finds_neighbours(segments):
    df, rows = segments
    r = ce.prepared(df)
    pivots = ce.fit_pivots(r, 400, 0.99)
    nodes = gr.coded(ce.build_cells(r, pivots, 0.99))
    graph = gr.descend(nodes, pivots, k=6, least=0.2)
    v = {x.cell: (x.space, gr.decode([x.v])[0]) for x in nodes.collect()}
    have = {}
    for e in graph.collect():
        have.setdefault(e.a, set()).add(e.b)
    hit = total = 0
    for a, (sp, x) in v.items():
        best = sorted(((float(x @ y), b) for b, (s2, y) in v.items() if b != a and s2 == sp), reverse=True)[:4]
        want = {b for s, b in best if s >= 0.25}
        hit, total = hit + len(want & have.get(a, set())), total + len(want)
    assert hit / total > 0.9


def test_components_and_communities(table):
    pairs = table("a bigint, b bigint", *((i, i + 1) for i in range(1, 30)), (40, 41), (50, 50))
    assert {(r.node, r.root) for r in components(pairs).collect()} == {(i, 1) for i in range(1, 31)} | {(40, 40), (41, 40)}
    clique = lambda o: [(o + i, o + j, 1.0) for i in range(5) for j in range(i + 1, 5)]
    links = table("a bigint, b bigint, w double", *clique(0), *clique(10), (4, 10, 0.1))
    label = {r.node: r.label for r in communities(links, links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("w", F.lit(0.0))).collect()}
    assert label[0] == label[1] == label[2] and label[12] == label[13] and label[0] != label[13]
