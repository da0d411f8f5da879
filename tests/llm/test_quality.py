from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evidloom.llm import quality_rank as R
from evidloom.llm import quality_rules as Q
from evidloom.llm import toxicity as T


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(zip(w, w[1:], w[2:]))
    cover = {j for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


def cases(words):
    rng = random.Random(21)
    rows = []
    for i in range(150):
        w = rng.choices(words, k=rng.randint(0, 120))
        if i % 3 == 0:
            w += w[:rng.randint(0, len(w))]
        if i % 4 == 0:
            w = [x.upper() + "%%" for x in w]
        rows.append((i, rng.choice([" ", "\n", "\t\x0b "]).join(w)))
    return rows + [(200, None), (201, ""), (202, "a a a"), (203, "a b\na b\n\n \n a b"), (204, "x " * 5000), (205, "\x1fé ü"),
                   (206, "a b c a b c"), (None, "k"), (207, "#*$%&|<>"), (5, "again")]


def test_base_counts_and_verdicts(spark, make_docs, words):
    rows = cases(words)
    docs = make_docs(rows)
    trusted = docs.where("doc_id < 150 AND doc_id % 4 <> 0")
    got = Q.quality_rules(docs, trusted, bits=12).collect()
    want = sorted(((i, *base(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got), key=repr) == want
    for r in got:
        if r.doc_id is not None and r.doc_id < 150 and not r.base_failed:
            assert r.kept == (r.doc_id % 4 != 0)
    assert Q.quality_rules(docs, docs.where("false")).where("kept <> (NOT base_failed)").count() == 0
    assert Q.quality_rules(docs.where("false"), trusted).collect() == []


def test_ratio_is_the_smoothed_log_ratio(spark):
    raw = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    model = {r.bucket: r.ratio for r in Q.llr_model(raw, raw.where("doc_id = 1"), bits=16).collect()}
    a = spark.range(1).select(F.xxhash64(F.lit("a")).bitwiseAND(F.lit(0xFFFF)).alias("h")).first().h
    size = 0.5 * 65536
    assert math.isclose(model[a], math.log(1.5 / (3 + size)) - math.log(2.5 / (6 + size)), rel_tol=1e-12)


def test_every_trusted_text_is_counted(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "a"), (0, "a")], "doc_id long, text string"))
    labels = docs.select("doc_id").union(docs.select("doc_id").limit(10))
    seen = {}

    def keep(df, name):
        seen[name] = df.collect()
        return df, ""

    write, Q.write_table = Q.write_table, keep
    try:
        Q.quality_rules(docs, labels, bits=8)
    finally:
        Q.write_table = write
    assert [(r.n_raw, r.n_trusted) for r in seen["gram_counts"]] == [(60_002, 60_001)]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_ranking_on_held_out_rows(spark, make_docs, words):
    rng = random.Random(4)
    rows, truth = [], []
    for i in range(400):
        w = rng.choices(words, k=rng.randint(20, 90))
        good = i % 4 != 0
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w[:10]) + " " + " ".join(w)))
        truth.append((i, int(good), None))
    docs = make_docs(rows + [(900, None), (901, ""), (None, "x"), (902, "y " * 50000)])
    labels = spark.createDataFrame(truth + [(7, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.score, r.predicted) for r in R.score_quality(docs, R.fit_ranking(docs, labels)).collect()}
    assert len(got) == 404 and all(0 <= s <= 1 and p == (s >= 0.3) for s, p in got.values())
    rate = np.mean([got[i][1] == q for i, q, _ in truth if held(i)])
    assert rate > 0.97
    flat = R.score_quality(docs, R.fit_ranking(docs, labels.where("quality = 1"))).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.3]
    assert R.score_quality(docs.where("false"), R.fit_ranking(docs.where("false"), labels)).collect() == []


def test_bradley_terry_orders_by_strength():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(500, 4)), np.array([1.0, -2.0, .5, 0])
    a, b = rng.integers(500, size=(2, 4000))
    wins = rng.random(4000) < 1 / (1 + np.exp(-(x[a] - x[b]) @ w))
    found = R.bradley_terry(x[np.where(wins, a, b)], x[np.where(wins, b, a)], ridge=1e-3)
    assert np.allclose(found, w, atol=0.2)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(7)
    make = lambda n: "".join(rng.choices("abcd", k=n))
    terms = sorted({make(rng.randint(1, 8)) for _ in range(60)})
    for edits in (0, 1, 2):
        automaton = T.TrieAutomaton(terms, edits)
        for word in [make(rng.randint(0, 9)) for _ in range(400)]:
            want = {(i, distance(word, t)) for i, t in enumerate(terms) if distance(word, t) <= edits}
            assert set(automaton.matches(word)) == want
    stems = T.TrieAutomaton(["ab*", "abc"], 1)
    assert set(stems.matches("abzzz")) == {(0, 0)} and set(stems.matches("abc")) == {(0, 0), (1, 0)}


def test_edit_bound_follows_the_longer_of_term_and_word():
    terms = ["worthless", "idiot", "loser", "absolutely", "scum", "craz*"]
    model = T.ToxicityModel(terms, [3.0] * len(terms))
    match = model.matcher()
    near = {"w0rthl3ss": 0, "worthles": 0, "wrthlss": 0, "idot": 1, "lser": 2, "idi0t": 1, "absoltly": 3, "absolutexyly": 3,
            "scumm": 4, "crazier": 5}
    assert {w: (match[w] or [None])[0] for w in near} == near
    assert [match[w] for w in ("iot", "scm", "w0rthl3s5", "losersss", "quiet")] == [None] * 5

    rng = random.Random(6)
    terms = ["".join(rng.choices("ab", k=rng.randint(2, 11))) for _ in range(40)]
    model = T.ToxicityModel(terms, [1.0] * len(terms))
    match = model.matcher()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(600):
        word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
        reach = [e for t in terms for e in [distance(word, t)]
                 if e <= max(k for n, k in model.bounds if max(len(t), len(word)) >= n)]
        assert (match[word] or (0, None))[1] == (0.5 ** min(reach) if reach else None)


def test_quotation_is_told_from_abuse():
    model = T.ToxicityModel(["idiot"], [5.0], ([5.0], [5.0]))
    match = model.matcher()
    direct = model.features("you are an idiot and more", match)
    quoted = model.features('they wrote "you are an idiot" and more', match)
    assert direct[1:3] == [5.0, 0] and quoted[1:3] == [0, 5.0]
    assert model.features("you idiott you", match)[1] == 2.5
    assert model.features("an idiot, then much later " + "x " * 30 + 'a "quote" here', match)[1] == 5.0


def test_toxicity_on_held_out_rows(spark, make_docs, words):
    rng = random.Random(4)
    bad = ["worthless", "pathetic", "disgust", "moronic"]
    rows, truth = [], []
    for i in range(500):
        w = rng.choices(words, k=rng.randint(20, 90))
        toxic = i % 5 == 1
        for x in rng.sample(bad, 2) if toxic else []:
            if held(i):
                x = x[:2] + "q" + x[3:]  # misspelled where it was never seen
            w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
        truth.append((i, int(toxic)))
    docs = make_docs(rows + [(900, None), (901, ""), (None, "x"), (902, "y " * 50000)])
    labels = spark.createDataFrame(truth + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = T.fit_toxicity(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in T.score_toxicity(docs, model).collect()}
    assert len(got) == 504 and all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())
    assert all(got[i][1] == y for i, y in truth if not held(i))
    assert np.mean([got[i][1] == y for i, y in truth if held(i)]) > 0.9
    assert got[900][1] == got[901][1] == got[902][1] == 0
    none = T.fit_toxicity(docs, labels.where("toxic = 0"))
    assert T.score_toxicity(docs, none).where("score > 0").count() == 0
