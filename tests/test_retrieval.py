import pytest
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators import retrieval as R
from clauseloom.operators.containment import stretch_pairs


def test_bm25_prefers_rare_and_heading_terms(spark):
    items = spark.createDataFrame([(1, "Leave", "teachers receive sick leave days"), (2, "Pay", "teachers receive pay"), (3, None, None), (4, "x", "unrelated words only")], "id long, heading string, text string")
    q = spark.createDataFrame([("a", ["sick", "leave"]), ("b", ["nothing"])], "q string, terms array<string>")
    got = R.bm25(items.union(items.limit(1)), "id", "heading", "text", q, "q").collect()
    assert [(r.q, r.id) for r in got] == [("a", 1)] and got[0]["rank"] < 0


def test_interleave_takes_turns(spark):
    rows = [("q", i, 1, p) for p, i in enumerate([10, 20, 30], 1)] + [("q", i, 2, p) for p, i in enumerate([20, 40, 50], 1)]
    df = spark.createDataFrame(rows, "q string, item long, src int, pos long")
    got = R.interleave(df, "q", "item", "src", "pos", 3, 4).orderBy("place").collect()
    assert [r.item for r in got] == [10, 20, 40, 30]


def test_cosine_ties_nulls_and_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [0.0, 1.0])], "id long, v array<float>")
    got = R.cosine_top_k(df.where("id = 2"), df, "id", "v", 2).orderBy("position").collect()
    assert [(r.id, r.similarity) for r in got] == [(1, 1.0), (3, 1.0)]
    several = R.cosine_top_k(df, df, "id", "v", 1, block=2)
    assert {r.query_id for r in several.collect()} == {1, 2, 3, 7}
    assert R.cosine_top_k(df.where("false"), df, "id", "v", 2).count() == 0


def test_cosine_within_a_scope_and_missing_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "b", [1.0, 0.0]), (4, "a", [0.0, 1.0])], "id long, d string, v array<float>")
    got = R.cosine_top_k(df.where("id = 1"), df, "id", "v", 5, scope="d").orderBy("position").collect()
    assert [r.id for r in got] == [2, 4]
    assert [r.id for r in R.cosine_top_k(df.where("id = 1"), df, "id", "v", 2, itself=True).orderBy("position").collect()] == [1, 3]
    assert R.with_vectors(df.select("d"), df, "d").count() == 4
    with pytest.raises(Exception, match="no vectors for d x"):
        R.with_vectors(spark.createDataFrame([("x",)], "d string"), df, "d").collect()


def test_densest_falls_back_to_all(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("b", 1, 5), ("b", 2, 7), ("b", 3, 7)], "g string, o int, s int")
    got = {(r.g, r.o) for r in R.densest(df, ["g"], "s", "o", 2).collect()}
    assert got == {("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3)}


@pytest.mark.parametrize("pairs", [4096, 2, 0])
def test_containment_is_the_same_on_every_way(spark, pairs):
    import random

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    hay = [(f"d{i % 3}", i, " ".join(rng.choices(words, k=30))) for i in range(40)] + [("d0", 90, None), (None, 91, "alpha beta gamma")]
    needles = [(f"d{i % 3}", i, h[5 + i : 60 + i // 2]) for i, (_, _, h) in enumerate(hay[:40])] + [("d0", 77, "alphabetagamma"), ("d1", 78, "x"), ("d2", 79, None), ("d1", 80, hay[1][2][:9])]
    n = spark.createDataFrame(needles, "k string, n long, needle string")
    h = spark.createDataFrame(hay, "k string, h long, hay string")
    got = {(r.n, r.h) for r in stretch_pairs(n, h, "k", (n.select("k"), h.select("k")), pairs=pairs).collect()}
    want = {(i, j) for k, i, x in needles for k2, j, y in hay if k is not None and k == k2 and x is not None and y is not None and x in y}
    assert got == want


def test_snippet(spark):
    df = spark.createDataFrame([("x" * 100 + " sick leave " + "y" * 300, ["leave"])], "t string, w array<string>")
    s = df.select(R.snippet("t", "w")).first()[0]
    assert "leave" in s and len(s) == 240
    assert df.select(T.estimated_tokens(F.lit("abcd"))).first()[0] == 2
