"""Small tests of the training-data operators: brute force, planted and odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import components, decontaminate, linear, minmax, mixing, quality, queries, repeats, secrets, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, _x int"


def frame(spark, texts, ids=None, lang="en", source="src1"):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, source, None if t is None else len(t), "clash", 7, 1) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n))


ODD = [None, "", " ", "x", "tie", "tie", "Äö " * 3, words(30000, 1)]


# 1 secrets

def brute_spans(text):
    kinds = ((r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
             ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("[0-9a-f]+", lambda m: len(m[0]) >= 32))
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))


def test_secret_spans(spark):
    texts = [*ODD[:7], "é token = 'abcdefgh12' password: secret: abcdefghijk", "AKIA" + "A1" * 6 + " " + "0a" * 16 + " AKIA1", "API_KEY=\"aaaaaaa\" apikey:bbbbbbbb0",
             "tOkEn==" + "ab12" * 10, "ä" * 5 + "0f" * 20 + "token:12345678"]
    got = secrets.scan(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert [(s.start, s.kind, s.stop) for s in r.spans if s.kind < 3] == brute_spans(t)
    assert secrets.scan(frame(spark, [])).count() == 0


def test_ownership_splits_examples_from_live(spark):
    example, live = "token = abcd1234efgh", "token = zyx98765wvut"
    docs = frame(spark, [example, example, example, live, live]).withColumn("source", F.concat(F.lit("s"), F.least("doc_id", F.lit(3)).cast("string")))
    v = {r.doc_id: r.verdicts[0] for r in secrets.scan(docs).collect()}
    assert [v[0].n_owners, v[0].live, v[3].n_owners, v[3].n_repositories, v[3].live] == [3, False, 1, 2, True]
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert out[0].text == example and out[3].text == "[secret]" and out[3].n_chars == 8 and len(out) == 5
    nulls = docs.withColumn("source", F.lit(None).cast("string"))
    assert secrets.redact(nulls).count() == 5 and secrets.redact(frame(spark, ODD)).exceptAll(frame(spark, ODD)).count() == 0


def test_redact_asks_short_values_for_ownership(spark):
    live = ["password = aab2c3d4", "token: deadbeef01", "secret=correcthorse", "api_key = Tr0ub4do", "password: Passwort", "AKIA" + "QWERTYQWERTY"]
    idle = ["token = " + "token" * 2000, "password = your_password_here", "token = changeme", "secret: xxxxxxxxxxxx", "token = aaaaaaaa1", "password=password123"]
    out = {r.doc_id: r.text for r in secrets.redact(frame(spark, [*live, *idle])).collect()}
    assert all(out[i] == "[secret]" for i in range(len(live))), out
    assert all(out[i + len(live)] == t for i, t in enumerate(idle)), out
    docs = frame(spark, ["token: deadbeef01"] * 3).withColumn("source", F.col("doc_id").cast("string"))  # three owners: an example
    assert secrets.redact(docs).filter("text like 'token%'").count() == 3


# 2 mixing

def test_budget_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 5)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r.source: r.alloc for r in mixing.budgets(leaves, ["domain", "lang", "source"], {}, F.lit(400), 1, 1.0).collect()}
    assert got["4"] == 5 and got["1"] == 10 and got["2"] == 187 and got["3"] == 197


def test_mix_edges(spark):
    docs = frame(spark, ODD).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    levels = {"domain": F.lit("d"), "lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(docs, levels, {"lang": {"en": -1.0}}, share=2.0, max_epochs=2).collect()
    assert sorted({r.doc_id for r in got}) == [3, 4, 5, 6, 7] and len(got) == 10
    assert mixing.mix(frame(spark, []), levels, {}).count() == 0
    part = mixing.mix(docs, levels, {}, total_tokens=100, keep=["doc_id", "text"]).collect()
    assert sum(r.n_tokens for r in part) <= 100 and {"text", "epoch"} <= set(part[0].asDict())


# 3, 7, 10 classifiers: held-out accuracy and odd rows

def labelled(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_quality(spark):
    r = np.random.default_rng(3)
    texts = [words(60, i) + "." if i % 2 else "".join(w.upper() + "!!### " for w in words(60, i).split()) for i in range(200)]
    lab = labelled(spark, [(i, i % 2) for i in range(200)] + [(5, None), (9999, 1)], "quality")
    out = {x.doc_id: x for x in quality.classify(frame(spark, [*texts, *ODD]), lab).collect()}
    held = [x for i, x in out.items() if i < 200 and x.held_out]
    assert held and all(x.predicted == x.doc_id % 2 for x in held) and all(0 <= x.score <= 1 for x in out.values()) and len(out) == 208
    assert quality.classify(frame(spark, ODD), lab.limit(0)).filter("score = 0.5").count() == 8
    g = quality.Gaussians(np.array([50.0, 50.0]), *[np.zeros((2, quality.P)), np.zeros((2, quality.P, quality.P))])
    assert np.allclose(g.score(r.normal(size=(4, quality.P))), 0.5)


def test_toxicity(spark):
    vocab = words(1000, 0).split()

    def say(i):  # insults stand anywhere, as in the labelled table
        r = random.Random(i)
        w = r.choices(vocab, weights=[1 / (k + 1) for k in range(1000)], k=60)
        for _ in range(4 if i % 3 == 0 else 0):
            w.insert(r.randrange(60), r.choice(["vile", "scum", "rot"]))
        return " ".join(w)

    texts = [say(i) for i in range(240)]
    lab = labelled(spark, [(i, int(i % 3 == 0)) for i in range(240)] + [(7, None)], "toxic")
    docs = frame(spark, [*texts, *ODD])
    out = {x.doc_id: x for x in toxicity.classify(docs, lab).collect()}
    held = [x for i, x in out.items() if i < 240 and x.held_out]
    assert held and all(x.predicted == int(x.doc_id % 3 == 0) for x in held) and len(out) == 248 and all(0 <= x.score <= 1 for x in out.values())
    diff, _ = toxicity.learn(docs, lab)
    a = toxicity.measured(docs.select("doc_id", "text"), diff).toPandas().sort_values("doc_id")
    b = toxicity.measured(docs.select("doc_id", "text"), diff, held_rows=0).toPandas().sort_values("doc_id")
    assert np.allclose(a[["top", "whole"]], b[["top", "whole"]], atol=1e-5)
    assert toxicity.classify(docs, lab.limit(0)).filter("score = 0 and predicted = 0").count() == 248


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = linear.fit(linear.train_rows(d), per_lang=60)
    got = linear.predict(d.withColumn("score", F.lit("x")), m).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in linear.predict(frame(spark, [*ODD, "123 !?"]), m).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 8)] == ["und"] * 4 and odd[3].lang_pred != "und"
    assert linear.identify(frame(spark, [*ODD, "123"]), m).columns == frame(spark, []).columns
    none = linear.fit(frame(spark, ODD, lang=None).select("text", "lang"))
    assert linear.predict(frame(spark, ODD), none).filter("lang_pred = 'und' and score = 0").count() == 8


def test_language_learns_different_texts_of_every_language(spark, monkeypatch):
    monkeypatch.setattr(linear, "Model", lambda langs, x, families, dim: (langs, x))
    langs, x = linear.fit(frame(spark, [words(20, i % 30) for i in range(600)]).select("text", "lang"), per_lang=10, dim=64)
    assert len(langs) == 10 and len(np.unique(x, axis=0)) == 10
    many = spark.range(5003).select(F.concat(F.lit("text of "), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    assert len(set(linear.fit(many, dim=64)[0])) == 5003


# 4 near-duplicates

def brute_groups(rows, size=2):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((up(i), up(j)), key=lambda k: rows[k][0])
                root[b] = a
    return {i: (len(sets[k]), min(rows[m][0] for m in range(len(rows)) if up(m) == up(k))) for k, (i, _) in enumerate(rows)}


def test_near_duplicates_against_brute_force(spark):
    r, rows = random.Random(4), []
    for g in range(4):
        base = words(80, g).split()
        for c in range(30):
            w = list(base)
            for _ in range(r.randrange(0, 9)):  # straddles the threshold, with and without a shared original
                w[r.randrange(80)] = words(1, r.random())
            rows.append((g * 100 + c, " ".join(w)))
    rows += [(900 + i, t) for i, t in enumerate([*ODD[:7], "A b", "a B", "one\ttwo three", words(20000, 8), words(20000, 8) + " end"])]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minmax.near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    assert got == brute_groups(rows)
    docs = frame(spark, ["a b c", "a b c", None, "q"], [5, 5, None, 6])
    assert minmax.near_duplicates(docs).count() == 4 and minmax.deduplicate(docs).count() == 4
    assert minmax.near_duplicates(frame(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    x, y, z = words(30, 1), words(30, 2), words(30, 3)
    docs = frame(spark, [x, x, x, x.upper(), y, y, z, z, z, None, None, ""], [3, 3, 7, 7, 7, 9, None, None, 11, 5, 5, None])
    got = sorted(((r.doc_id, r.text) for r in minmax.deduplicate(docs, one_row=True).collect()), key=str)
    assert got == sorted([(3, x), (7, y), (11, z), (5, None), (5, None), (None, "")], key=str)
    no_ids = frame(spark, [z, z], [None, None]).withColumn("source", F.lit("s"))
    assert minmax.deduplicate(no_ids, one_row=True).count() == 1
    byid = sorted(((r.doc_id, r.text) for r in minmax.deduplicate(docs).filter("text <> ''").collect()), key=str)
    assert byid == sorted([(3, x), (3, x), (7, y), (None, z), (None, z), (11, z)], key=str)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(3, 3), (2, 1)], "a long, b long")
    got = components.components(links).collect()
    assert {r.node: r.root for r in got} == {i: i // 10 * 10 for i in range(40)}


# 5 URL lists

def test_url_intervals(spark):
    e = spark.createDataFrame([("d:bad.com", "2023-01-05", "add"), ("d:bad.com", "2023-03-01", "remove"), ("d:bad.com", "2023-03-01", "add"), ("d:bad.com", "2023-05-01", "add"),
                               ("p:ok.org/x", "2023-01-01", "add"), (None, "2023-01-01", "add"), ("d:n.com", None, "add")], "key string, day string, action string").withColumn("day", F.to_date("day"))
    c = [("http://a.bad.com/q", "2023-01-04", False), ("http://a.bad.com/q", "2023-01-05", True), ("HTTPS://u@A.BAD.com:80", "2023-02-28", True), ("http://bad.com", "2023-03-01", False),
         ("http://bad.com", "2024-01-01", True), ("http://notbad.com", "2023-02-01", False), ("http://ok.org/x/y?z", "2023-02-01", True), ("http://ok.org/xy", "2023-02-01", False),
         (None, "2023-02-01", False), ("", "2023-02-01", False), ("http://bad.com", None, False), ("no url", "2023-02-01", False)]
    df = spark.createDataFrame([(i, *x, 1) for i, x in enumerate(c)], "page_id int, url string, fetched string, want boolean, blocked int").withColumn("fetched", F.to_date("fetched"))
    assert urls.evaluate(df, e).filter("blocked <> want").count() == 0 and urls.evaluate(df, e).count() == 12
    assert urls.evaluate(df.limit(0), e).count() == 0 and urls.evaluate(df, e.limit(0)).filter("blocked").count() == 0


# 6 SimHash

def test_simhash_next_and_search(spark):
    texts = {i * 3: words(5 + i, i) for i in range(60)} | {200: "", 201: None, 202: "x", 203: words(12, 2)}
    docs = frame(spark, list(texts.values()), list(texts))
    got = {r.doc_id: r for r in simhash.fingerprints(docs, range_chars=300).collect()}
    ids = sorted(texts)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i] or "", texts[nxt] or ""
        k = len(t) // 4
        new = t[:len(t) - k] + n[:k]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == simhash.fingerprint(t).hex() and got[i].edited_fingerprint == simhash.fingerprint(new).hex()
    one = simhash.fingerprints(frame(spark, ["abc def"])).first()
    assert one.near_next == 1 and simhash.fingerprints(frame(spark, [])).count() == 0
    assert simhash.fingerprints(frame(spark, ["a", "b", None], [None, 1, 1])).count() == 3
    r = random.Random(1)
    base = [r.getrandbits(128) for _ in range(20)]
    fps = base + [b ^ sum(1 << k for k in r.sample(range(128), d)) for b in base for d in (1, 3, 5, 6)]
    df = spark.createDataFrame([(f"{f:032x}",) for f in fps], "fingerprint string")
    near = {(x.asked, x.known): x.distance for x in simhash.within(df.limit(30), df, 5).collect()}
    want = {(f"{a:032x}", f"{b:032x}"): (a ^ b).bit_count() for a in fps[:30] for b in fps if (a ^ b).bit_count() <= 5}
    assert near == want


# 8 repeats

def brute_repeats(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen: dict = {}
    for i, b in enumerate(raw):
        for k in range(len(b) - n + 1):
            seen.setdefault(b[k:k + n], []).append((i, k))
    hit = [np.zeros(len(b) + 1, dtype=bool) for b in raw]
    for at in seen.values():
        for i, k in at if len(at) > 1 else ():
            hit[i][k:k + n] = True
    return [(len(b), int(h.sum()), int((np.diff(h.astype(int)) == 1).sum() + h[0]), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~h[:-1]])).hexdigest()) for b, h in zip(raw, hit)]


@pytest.mark.parametrize("hot", [1, 192])
def test_repeats_against_brute_force(spark, hot):
    a, b = words(40, 1), words(60, 2)
    texts = [words(20, 10 + i) + " " + a[i:] + " é" + words(9, 30 + i) for i in range(12)] + [b, b, b + b, "ab" * 200, "ab" * 90, "é" * 150, *ODD[:7], words(50, 77)]
    got = repeats.digest(frame(spark, texts).select("doc_id", "text"), length=80, gram=24, hot=hot, bits=16).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(texts, 80)
    assert repeats.remove(frame(spark, [b, b, "short"]), hot=hot).filter("text = ''").count() == (2 if len(b) >= 400 else 0)
    assert repeats.digest(frame(spark, []).select("doc_id", "text")).count() == 0


def brute_first(texts, n):
    raw, seen, out = [t.encode() for t in texts], {}, []
    for i, b in enumerate(raw):
        for k in range(len(b) - n + 1):
            seen.setdefault(b[k:k + n], []).append((i, k))
    for i, b in enumerate(raw):
        late, first = np.zeros(len(b), dtype=bool), np.zeros(len(b), dtype=bool)
        for k in range(len(b) - n + 1):
            at = seen[b[k:k + n]]
            if len(at) > 1:
                (first if at[0] == (i, k) else late)[k:k + n] = True
        if b in raw[:i] and len(b) >= n:
            first[:], late[:] = False, True
        out.append(bytes(np.frombuffer(b, np.uint8)[~late | first]).decode())
    return out


@pytest.mark.parametrize("hot", [1, 192])
def test_repeats_keep_the_first_copy(spark, hot):
    a, b = words(40, 1), words(60, 2)
    texts = [words(20, 10 + i) + " " + a[i % 5:] + " " + words(9, 30 + i) for i in range(8)] + [b, b, b + b, "ab" * 200, a + b, "short", words(50, 77)]
    docs = frame(spark, texts[::-1], range(len(texts))[::-1])
    got = {r.doc_id: r.text for r in repeats.remove(docs, keep="first", length=80, gram=24, hot=hot, bits=16).collect()}
    assert [got[i] for i in range(len(texts))] == brute_first(texts, 80)
    same = repeats.remove(frame(spark, [b, b, b], [4, 4, None]), keep="first", length=80, gram=24, hot=hot, bits=16).collect()
    assert sorted((r.doc_id is None, r.text) for r in same) == [(False, ""), (False, b), (True, "")]


# 9 decontamination

@pytest.mark.parametrize("block", [7, 500_000])
def test_decontaminate_against_brute_force(spark, block):
    long = words(40, 5)
    items = [(1, long), (2, "Short ITEM"), (3, ""), (4, None), (10, words(15, 6)), (11, words(15, 6)), (None, "no id here")]
    texts = [*ODD[:7], "x " + long[25:90] + " y", "a short-item b", words(15, 6).upper() + "!", "No Id here", long + " " + long, words(200, 9)]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.digest(docs, bench, block_windows=block).collect()}
    want = decontaminate.brute(list(enumerate(texts)), [(i, t) for i, t in items if i is not None])
    for i in range(len(texts)):
        if i != 10:
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == want[i], i
    assert (got[10].n_hit, got[10].n_items) == (3, 0)
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert left[8] == "a  b" and left[12] == texts[12] and len(left) == len(texts)
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_blocks_are_written_one_by_one(spark, monkeypatch):
    from docloom.operators import semantic

    told = []
    for module in (decontaminate, semantic):
        monkeypatch.setattr(module, "stored", lambda df: told.append(1) or df.cache(), raising=False)
    decontaminate.mark(frame(spark, [words(40, 5)]), spark.createDataFrame([(1, words(40, 5))], "item_id long, text string"), block_windows=11).count()
    assert len(told) == 2  # 31 windows, three blocks
    r = np.random.default_rng(2)
    vec = lambda n, name: spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(n)], f"{name} long, vector array<double>")
    q, v = vec(9, "query_id").cache(), vec(30, "doc_idx").cache()
    one = semantic.dense(q, v, 3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(semantic, "MAX_QUERY_BLOCK", 6)
    assert semantic.dense(q, v, 3).orderBy("query_id", "rank").collect() == one and len(told) > 2


# pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "benchmarks", "credentials", "mixture"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.toPandas()
        kept = spark.createDataFrame(stage(spark, kept, SF).toPandas(), docs.schema)
        after = kept.toPandas()
        assert kept.columns == docs.columns
        if name == "near_duplicates":
            want = brute_groups(list(zip(before.doc_id, before.text)), 5)
            assert set(after.doc_id) == {i for i, (_, c) in want.items() if c == i}
        if name == "benchmarks":
            want = decontaminate.brute(list(zip(before.doc_id, before.text)), list(zip(bench.item_id, bench.text)))
            assert set(after.doc_id) == {i for i, w in want.items() if w[1] == 0}
        if name == "credentials":
            assert set(after.doc_id) == set(before.doc_id)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).toPandas()
    assert len(last) and set(last.doc_id) <= set(after.doc_id)
    got = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "epoch"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), last.sort_values(key).reset_index(drop=True))


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
