import math

import pytest
from pyspark.sql import functions as F

from docloom.functions import filters, scores
from docloom.functions import text as tx
from docloom.functions.udfs import _cover, blake2b_hash64, nfc


def one(spark, col, **vals):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in vals.items()]) if vals else spark.range(1)
    return df.select(col.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, tx.tokens("t"), t="blood pressure: 145/90") == ["blood", "pressure", "145", "90"]
    assert one(spark, tx.tokens(F.lit(None).cast("string"))) == []


def test_ngrams(spark):
    assert one(spark, tx.word_ngrams(tx.tokens("t"), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, tx.word_ngrams(tx.tokens("t"), 3), t="a b") == []
    assert one(spark, tx.char_ngrams(tx.tokens("t")), t="abcd") == ["abc", "bcd", "abcd"]


def test_set_scores(spark):
    a, b = tx.tokens(F.lit("a b c")), tx.tokens(F.lit("b c d"))
    assert one(spark, tx.jaccard(a, b)) == 0.5
    assert one(spark, tx.jaccard(a, tx.tokens(F.lit("")))) == 0.0
    assert one(spark, tx.overlap(a, b)) == pytest.approx(2 / 3)
    assert one(spark, tx.f1(a, b)) == pytest.approx(2 / 3)


@pytest.mark.parametrize("raw,iso", [("03/14/2024", "2024-03-14"), ("25/12/23", "2023-12-25"), ("2024-1-5", "2024-01-05"),
                                     ("Mar 5, 2024", "2024-03-05"), ("5 March 2024", "2024-03-05"), ("soon", "soon")])
def test_iso_date(spark, raw, iso):
    assert one(spark, tx.iso_date("t"), t=raw) == iso


def test_repetition_key(spark):
    assert one(spark, tx.repetition_key("t"), t="Page 3 of 12  Ref 44") == "page <n> ref <n>"


def test_sentences_and_nfc(spark):
    assert one(spark, tx.sentences("t"), t="One. Two! Three") == ["One.", "Two!", "Three"]
    assert one(spark, nfc("t"), t="é") == "é"


def test_hash64_matches_digest(spark):
    import hashlib

    want = int(hashlib.blake2b(b"3:abc", digest_size=8).hexdigest(), 16)
    assert int(one(spark, blake2b_hash64("t", F.lit(3)), t="abc")) == want


@pytest.mark.parametrize("cond,keep", [
    ({"a": 1}, [0]), ({"a": [1, 2]}, [0, 1]), ({"a": {"$gte": 2}}, [1]), ({"a": {"$lte": 1}}, [0]), ({"a": {"$ne": 1}}, [1, 2]),
    ({"a": {"$eq": 1}}, [0]), ({"b": {"$contains": "one"}}, [0, 2]), ({"b": {"$in": ["x"]}}, []), ({}, [0, 1, 2]), ({"zz": 1}, []),
])
def test_filters(spark, cond, keep):
    df = spark.createDataFrame([(0, 1, "one"), (1, 2, "two"), (2, None, None)], "i int, a int, b string")
    got = [r.i for r in df.filter(filters.compile_filters(cond, columns=df.columns)).orderBy("i").collect()]
    assert got == keep


def test_vector_dialect_rejects_contains():
    with pytest.raises(ValueError):
        filters.compile_filters({"b": {"$contains": "x"}}, "vector")


def test_minmax_and_rrf(spark):
    df = spark.createDataFrame([(0, 1, 0.0), (0, 2, 0.5), (0, 3, 1.0), (1, 1, 0.7), (1, 2, 0.7), (2, 1, 0.0)], "q int, d int, s double")
    got = {(r.q, r.d): r.n for r in df.withColumn("n", scores.minmax(F.col("s"), ["q"])).collect()}
    assert got == {(0, 1): 0.0, (0, 2): 0.5, (0, 3): 1.0, (1, 1): 1.0, (1, 2): 1.0, (2, 1): 0.0}
    r = spark.createDataFrame([(0, 5, 1), (0, 6, 2), (0, 6, 1)], "query_id long, doc_idx long, rank int")
    top = scores.rrf(r, ["doc_idx"]).filter("rank = 1").first()
    assert top.doc_idx == 6 and top.score == pytest.approx(1 / 61 + 1 / 62, abs=1e-6)


def test_range_join_matches_brute_force(spark):
    import random

    rnd = random.Random(3)
    mk = lambda n: [(i, s, s + rnd.randint(1, 90)) for i, s in enumerate(rnd.randint(0, 500) for _ in range(n))]
    a, b = mk(60), mk(60)
    l = spark.createDataFrame([(1, *x) for x in a], "k int, i int, s int, e int")
    r = spark.createDataFrame([(1, *x) for x in b], "k int, j int, rs int, re int")
    got = sorted((x.i, x.j) for x in scores.range_join(l, r, ["k"], "s", "e", "rs", "re", 32).collect())
    assert got == sorted((i, j) for i, s, e in a for j, rs, re in b if re > s and rs < e)


def test_islands(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 5, 9), (0, 20, 30), (0, 22, 25)], "k int, s int, e int")
    assert sorted((r.s, r.e) for r in scores.islands(df, ["k"], "s", "e").collect()) == [(0, 9), (20, 30)]


def test_min_cover_brute_force():
    import itertools
    import random

    rnd = random.Random(1)
    for _ in range(50):
        lists = [sorted(rnd.sample(range(60), rnd.randint(1, 6))) for _ in range(rnd.randint(2, 4))]
        want = min(max(c) - min(c) + 1 for c in itertools.product(*lists))
        assert _cover(lists) == want
    assert _cover([[1, 2]]) is None and math.isclose(1.0, 1.0)
