import math
import random

from pyspark.sql import functions as F

from cutlight.functions import vectors as vx
from cutlight.operators import vector_search as vs
from cutlight.sources import synthetic


def test_codec_round_trip(table):
    rnd = random.Random(3)
    df = table("v array<float>", *(([rnd.gauss(0, 1) for _ in range(128)],) for _ in range(5)), ([0.0] * 128,))
    v = F.col("v")
    back = df.select(vx.cosine(v, vx.int8_decode(vx.unpack_int8(vx.pack_int8(vx.int8_values(v))), vx.int8_scale(v)))).collect()
    assert all(r[0] > 0.999 for r in back[:5]) and back[5][0] is None


def test_products(table):
    df = table("a array<float>, b array<float>", ([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]))
    got = df.select(vx.dot(F.col("a"), F.col("b")), vx.norm(F.col("a")), vx.normalise(F.col("a"))).collect()
    assert got[0][0] == 3 and got[0][1] == 5 and got[0][2] == [0.6, 0.8] and got[1][2] == [0, 0] and got[2][0] is None


def test_hamming_and_validity(table):
    assert table("a bigint, b bigint", (5, 6)).select(vx.hamming(F.col("a"), F.col("b"))).first()[0] == 2
    df = table("d int, q string, n int, s double", (4, "int8", 4, 0.1), (4, "float32", 16, 1.0), (4, "int8", 5, 0.1), (0, "int8", 0, 0.1), (4, "x", 4, 0.1), (4, "int8", 4, None))
    assert [r[0] for r in df.select(vx.valid_embedding(*map(F.col, "dqns"))).collect()] == [True, True, False, False, False, False]


def test_top_k_ties(table):
    df = table("i bigint, v array<float>", (3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None))
    got = vs.exact_top_k(df, "i", "v", F.array(F.lit(1.0), F.lit(0.0)), 2).orderBy("rank_no").collect()
    assert [r.row_id for r in got] == [1, 3]
    assert vs.use_graph("m", 3, "m", 3) and not vs.use_graph("m", 3, "m", 4) and not vs.use_graph("m", 0, "m", 0)


def test_statistics_and_centroids(table):
    df = table("i bigint, k string, v array<float>", (0, "x", [1.0, 0.0]), (1, "x", [0.0, 1.0]), (2, "y", [0.0, 2.0]))
    s = vs.library_statistics(df, "v", F.array(F.lit(1.0), F.lit(0.0))).first()
    assert math.isclose(s["mean"], 1 / 3) and math.isclose(s["deviation"], math.sqrt(2) / 3)
    c = {r.k: [round(x, 6) for x in r.centroid] for r in vs.centroids(df, "k", "v").collect()}
    assert c == {"x": [0.707107, 0.707107], "y": [0.0, 1.0]}
    assert vs.stride_sample(df, "i", 2).count() == 2
    assert vs.dimension_conflicts((df.withColumn("d", F.size("v")), "k", "d"), (df.withColumn("d", F.lit(3)), "k", "d")).count() == 2


def test_rerank(table):
    first = table("row_id bigint, confidence double, rank_no int", (1, 0.9, 1), (2, 0.8, 2), (3, 0.1, 3))
    second = table("row_id bigint, confidence2 double", (1, 0.0), (3, 1.0))
    assert [r.row_id for r in vs.rerank(first, second, 0.5, depth=2).orderBy("rank_no").collect()] == [2, 1, 3]


def test_synthetic_vectors(spark):
    v = synthetic.vectors(spark, 40, 16, 0.8, scenes=2)
    again = synthetic.vectors(spark, 40, 16, 0.8, scenes=2).repartition(5)
    assert sorted(map(tuple, v.select("vec_id", "scene").collect())) == sorted(map(tuple, again.select("vec_id", "scene").collect()))
    assert all(abs(r[0] - 1) < 1e-5 for r in v.select(vx.norm(F.col("embedding"))).collect())
    assert synthetic.assets(spark, 5).select("content_key").distinct().count() == 5
