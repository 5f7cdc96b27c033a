"""Ranked search, licence notices and collocations against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import collocations, fptree, licenses

DOCS = "doc_id long, text string, lang string, score string, rank int, n long, q long, places int"


def frame(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, g, "clash", 1, 2, 3, 4) for i, t, g in zip(ids, texts, langs)], DOCS)


def items(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(range(len(texts)) if ids is None else ids, texts)), "item_id long, text string")


def prose(r, n, size=40):
    return " ".join(r.choice("abcdefgh") * r.randint(1, 3) + str(int(r.random() ** 3 * size)) for _ in range(n))


# 11 ranked search

def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", low)


def brute_ranks(docs, asked, k):
    rows = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(rows), sum(sum(c.values()) for _, c in rows)
    out = []
    for item, text in asked:
        hits = []
        for i, c in rows:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = 0
            for t in set(terms(text)):
                df = sum(t in x for _, x in rows)
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if s > 0:
                hits.append((-s, math.inf if i is None else i, i))
        out += [(item, rk, i, -s) for rk, (s, _, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kw", [{}, {"tree_rows": 16, "leaf_rows": 2}, {"block_terms": 20, "leaf_rows": 1}])
def test_ranked_search_equals_brute_force(spark, kw):
    r = random.Random(3)
    texts = [prose(r, r.randint(1, 60)) for _ in range(150)] + ["A1 b2 É! a1"] * 40 + [None, "", " .", prose(r, 5000), "Ünï ünï c3"]
    ids = [*range(len(texts) - 1), None]
    asked = [prose(r, 12) for _ in range(7)] + ["a1 a1 B2", "none such", None, "", "ÜNÏ É c3", "a1 a1 B2"]
    got = fptree.search(frame(spark, texts, ids), items(spark, asked), k=10, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranks(list(zip(ids, texts)), list(enumerate(asked)), 10)


def test_ranked_search_of_repeats_and_nothing(spark):
    docs = frame(spark, ["x y", "x y", "x", "z"], [5, 5, 5, 1])
    got = fptree.search(docs, items(spark, ["x", "y"], [None, None]), k=3).collect()
    assert sorted((r.rank, r.doc_id) for r in got) == [(1, 5), (1, 5), (2, 5), (2, 5), (3, 5)]
    for d, i in ((frame(spark, []), items(spark, ["x"])), (docs, items(spark, [])), (frame(spark, [None, "."]), items(spark, ["x"]))):
        assert fptree.search(d, i).collect() == []


def test_bounds_hold_in_every_node(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        path = sorted(r.sample(range(30), r.randint(1, 8)))
        rows.append((b"".join(t.to_bytes(4, "big") for t in path), b"".join(r.randint(1, 9).to_bytes(4, "big") for _ in path), r.randint(50, 200), i))
    tree = fptree.Tree(sorted(rows), 30, 4)
    leaves = [(a, b) for a, b, c in zip(tree.first, tree.last, tree.children) if not c]
    assert sorted(x for a, b in leaves for x in range(a, b)) == list(range(300)) and len(tree.first) > 50
    for t in range(30):
        for node, best in zip(tree.node[tree.of_term[t]:tree.of_term[t + 1]], tree.best[tree.of_term[t]:tree.of_term[t + 1]]):
            i, j = tree.at[tree.first[node]], tree.at[tree.last[node]]
            assert tree.gain[i:j][tree.term[i:j] == t].max() <= best


# 12 licence notices

def distance_ends(notice, text):
    """Least edits of ``notice`` against a substring that ends at each place."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return row


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(old[j - 1] + (c != d), old[j] + 1, row[j - 1] + 1))
    return row[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s))
        s[i:i + r.randint(0, 1)] = [r.choice(["", "x", "q"])]
    return "".join(s)


def test_notices_equal_brute_force(spark):
    r = random.Random(9)
    every = {**licenses.NOTICES, **licenses.BASE}
    texts = []
    for _ in range(150):
        bits = []
        for _ in range(r.randint(1, 6)):
            n = r.choice(sorted(every))
            bits += [r.choice(["", "foo ", "é bar ", "x "]), edited(r, n, r.choice([0, 0, 1, 2, 3])).replace(" ", r.choice([" ", "\n", " -- "])), r.choice([" ", ".\n", " the "])]
        texts.append("".join(bits).title())
    places = {x.doc_id: x for x in licenses.scan(frame(spark, texts)).collect()}
    known = licenses.notices(licenses.BASE, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    assert sum(p.edits > 0 for x in places.values() for p in x.places) > 60
    for i, text in enumerate(texts):
        got = places[i]
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
        assert got.n_words == len(words)
        for n in known:
            own = [p for p in got.places if p.notice == n.text]
            w = n.text.split()
            exact = [j for j in range(len(words)) if words[j:j + len(w)] == w]
            assert [p.word for p in own if p.edits == 0] == exact
            assert all(p.base == (n.base and p.edits == 0) for p in own)
            for p in own:  # sound: the words told are within the edits
                assert distance(n.text, " ".join(words[p.word:p.word + p.words])) == p.edits <= n.edits
                assert re.findall("[0-9a-z\x80-\U0010ffff]+", text[p.start:p.stop].lower()) == words[p.word:p.word + p.words]
            for a in range(len(words)):  # whole: every run of words within the edits meets a place
                for b in range(a + 1, min(len(words), a + len(w) + 3) + 1):
                    if distance(n.text, " ".join(words[a:b])) <= n.edits:
                        assert any(p.word < b and a < p.word + p.words for p in own), (text, n.text, words[a:b])


def test_notice_digest_and_odd_rows(spark):
    texts = [None, "", "é!", "CC-BY, mit\tLicense; GNU General  Public License", "Apache Licens 2", "mit license mit license", "word " * 50000 + "cc by"]
    got = {r.doc_id: r for r in licenses.digest(frame(spark, [*texts, texts[3]], [*range(7), 3])).collect()}
    assert [(got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels) for i in range(7)] == [
        (0, 0, None, None, "", ""), (0, 0, None, None, "", ""), (1, 0, None, None, "", ""), (8, 3, 0, 4, "cc-by,gpl,mit", "cc-by,gpl,mit"),
        (3, 0, None, None, "", "apache"), (4, 2, 0, 2, "mit", "mit"), (50002, 1, 50000, 50000, "cc-by", "cc-by")]
    assert got[4].score == pytest.approx(1 - 1 / 14) and got[3].score == 1.0 and got[0].score == 0.0
    assert licenses.digest(frame(spark, [])).collect() == []
    assert licenses.scan(frame(spark, ["a a a"]), base={"a a": "x"}, more={}).selectExpr("size(places) n").first().n == 2
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, []), base={"Two  Words": "x"})


# 13 collocations

def brute_phrases(rows, min_count, first):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        top = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            top.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(top)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize("kw", [{}, {"budget": 40, "chunk": 60}, {"budget": 300, "chunk": 7}])
def test_collocations_equal_brute_force(spark, kw):
    r = random.Random(11)
    vocab = [*"abcdefgh", "Ée", "ä-ö", "x'y", " z"]
    texts, langs = [], []
    for i in range(120):
        texts.append("".join(r.choice(vocab[:1 + int(r.random() ** 2 * len(vocab))]) + r.choice([" ", " ", " ", "\t ", ". ", "\n", ";", "  "]) for _ in range(r.randint(0, 80))))
        langs.append(r.choice(["en", "en", "de", None]))
    texts += [None, "", " ", "...", "THE the the " * 400, "THE the the " * 400]
    langs += ["en"] * 6
    got = collocations.mine(frame(spark, texts, langs=langs).withColumn("phrase", F.lit(1)), first=25, **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(list(zip(langs, texts)), 10, 25)


def test_collocations_of_nothing(spark):
    assert collocations.mine(frame(spark, [])).collect() == []
    assert collocations.mine(frame(spark, [None, "a b"])).collect() == []
