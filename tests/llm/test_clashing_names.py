"""Columns of the user's that carry names an operator uses inside, and empty tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import decontaminate, linear, minmax, mixing, quality, repeats, secrets, simhash, toxicity, urls
from docloom.llm.common import aside

CLASH = ["m", "_m", "_row", "_key", "_at", "_spans", "_live", "_cut", "_hits", "_items", "_words", "_first", "_p", "_url", "_day", "x", "y", "key", "period",
         "text_key", "leaf", "full", "cutoff", "_id", "_text", "__owner", "__repository", "value_hash", "stays", "name", "rep", "node"]
RESULT = {"score", "lang_pred", "held_out", "predicted", "top", "whole"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards box a sphinx of black quartz by the old mill"
ROWS = [(1, PROSE, "en", "src1", 0), (2, PROSE, "en", "src1", 0), (3, "password = aab2c3d4 and " + PROSE[::-1], "en", "src2", 0), (4, None, None, None, None), (None, "", "en", None, 0)]


def docs(spark, rows=ROWS, names=CLASH):
    d = spark.createDataFrame(rows, SCHEMA)
    return d.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(0))).alias(c) for c in names])


def bench(spark):
    return spark.createDataFrame([(7, "lazy dog while seven wizards box a sphinx of black")], "item_id long, text string")


def labels(spark, name):
    return spark.createDataFrame([(1, 0), (2, 1), (3, 1)], f"doc_id long, {name} int")


STAGES = {
    "language": lambda s, d: linear.identify(d, linear.fit(d.select("text", "lang"), dim=64), min_score=0.0),
    "near_duplicates": lambda s, d: minmax.deduplicate(d, one_row=True, size=5),
    "near_duplicates_by_id": lambda s, d: minmax.deduplicate(d),
    "benchmarks": lambda s, d: decontaminate.decontaminate(d, bench(s)),
    "benchmark_spans": lambda s, d: decontaminate.decontaminate(d, bench(s), remove="spans"),
    "credentials": lambda s, d: secrets.redact(d),
    "repeats": lambda s, d: repeats.remove(d, length=40, gram=16, bits=16),
    "repeats_keep_first": lambda s, d: repeats.remove(d, keep="first", length=40, gram=16, bits=16),
}


def values(df, names):
    return sorted((r.doc_id or 0, *[r[c] for c in names]) for r in df.collect())


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns_of_any_name(spark, stage):
    names = [*CLASH, *sorted(RESULT)]
    d = docs(spark, names=names)
    got = STAGES[stage](spark, d)
    assert got.columns == d.columns
    rows = values(got, names)
    assert rows and all(r[1:] == tuple(f"{c}-{r[0]}" for c in names) for r in rows)
    assert values(got, ["text"]) == values(STAGES[stage](spark, docs(spark, names=[])), ["text"])


@pytest.mark.parametrize("stage", STAGES)
def test_stages_of_an_empty_table(spark, stage):
    if stage == "language":
        m = linear.fit(docs(spark, [], []).select("text", "lang"), dim=64)
        assert linear.identify(docs(spark, [], []), m).count() == 0
    else:
        assert STAGES[stage](spark, docs(spark, [])).count() == 0


def test_classifiers_keep_columns_of_any_name(spark):
    d = docs(spark)
    for got in (quality.classify(d, labels(spark, "quality")), toxicity.classify(d, labels(spark, "toxic"))):
        assert set(got.columns) - RESULT == set(d.columns) - {"text"} and RESULT - {"lang_pred", "top", "whole"} <= set(got.columns)
        assert all(r[1:] == tuple(f"{c}-{r[0]}" for c in CLASH) for r in values(got, CLASH)) and got.count() == 5
    for f, name in ((quality.classify, "quality"), (toxicity.classify, "toxic")):
        assert f(docs(spark, []), labels(spark, name)).count() == 0
        assert f(docs(spark, [], []), labels(spark, name).limit(0)).count() == 0


def test_mix_keeps_columns_of_any_name(spark):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(docs(spark), levels, {}, share=1.0, max_epochs=1, keep=["doc_id", *CLASH])
    rows = values(got, CLASH)
    assert [r[0] for r in rows] == [1, 2, 3] and all(r[1:] == tuple(f"{c}-{r[0]}" for c in CLASH) for r in rows)
    assert got.columns == ["doc_id", *CLASH, "lang", "source", "n_tokens", "epoch"]


def test_url_lists_keep_columns_of_any_name(spark):
    day = datetime.date(2024, 3, 1)
    c = spark.createDataFrame([(1, "http://bad.example/x", day), (2, None, day), (3, "http://ok.example/", None)], "doc_id long, url string, fetched date")
    c = c.select("*", *[F.concat(F.lit(f"{k}-"), "doc_id").alias(k) for k in CLASH])
    entries = spark.createDataFrame([("d:bad.example", datetime.date(2024, 1, 1), "add")], "key string, day date, action string")
    got = urls.evaluate(c, entries)
    assert {r.doc_id: r.blocked for r in got.collect()} == {1: True, 2: False, 3: False}
    assert all(r[1:] == tuple(f"{k}-{r[0]}" for k in CLASH) for r in values(got, CLASH))
    renamed = c.select("doc_id", F.col("url").alias("key"), F.col("fetched").alias("period"))
    assert {r.doc_id: r.blocked for r in urls.evaluate(renamed, entries, "key", "period").collect()} == {1: True, 2: False, 3: False}


def test_digests_of_an_empty_table(spark):
    none = docs(spark, [], [])
    assert secrets.digest(secrets.scan(none)).count() == 0
    assert repeats.digest(none).count() == 0
    assert decontaminate.digest(none, bench(spark)).count() == 0
    assert simhash.digest(none.select("doc_id", "text")).count() == 0


def test_aside_gives_names_back(spark):
    d = spark.createDataFrame([(1, "a", "b")], "id long, text string, __aside_0 string")
    named, back = aside(d, t="text", more={"n": F.length("text")})
    assert named.columns == ["__aside_0", "t", "__aside_2", "n"]
    assert back(named).columns == d.columns and back(named, ("id",), text=F.upper("t")).first().asDict() == {"__aside_0": "b", "text": "A"}


def test_pipeline_stages_of_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "/root/testdata/sf0.001").count() == 0
