from __future__ import annotations

import random

import numpy as np

from evidloom.llm.near_dup import Circulant, _hopeful_rows, _last_links, connected_components, near_duplicates, shingle_sets


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def edited(rng, words, text, n):
    out = text.split()
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(words)
    return " ".join(out)


def test_against_brute_force(make_docs, words):
    rng = random.Random(3)
    base = " ".join(rng.choices(words, k=150))
    rows = [(i, edited(rng, words, base, rng.randint(0, 14))) for i in range(90)]  # many just under the threshold
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    passage = " ".join(rng.choices(words, k=30))
    rows += [(200 + i, passage + " " + " ".join(rng.choices(words, k=20))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "ONE two"), (305, "one two three")]
    rows += [(400 + i, base) for i in range(30)]
    rows += [(500, " ".join(rng.choices(words, k=30000)))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_defined_cases(spark, make_docs):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(make_docs(rows)).collect()), key=repr)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=repr)
    assert near_duplicates(make_docs([(1, "x")]).where("false")).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 299), (299, 301)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 299: 299, 300: 299, 301: 299}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(1 << 62, size=900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(1 << 62, size=100).astype(np.uint64)])
    hasher = Circulant(50, 5, 512)
    x, y = hasher.signature(a), hasher.signature(b)
    assert abs(np.mean(x == y) - 800 / 1000) < 0.08
    assert len(set(hasher.keys(x).tolist())) == 50
    whole = next(iter(shingle_sets([" ".join(map(str, range(3000)))], 5)))
    assert len(whole) == 2996 and (hasher.signature(whole) == hasher.signature(whole[::-1])).all()


MET = "key long, i int, j int, block int, id long, c long, n long, low_bytes binary"


def test_last_step_loses_no_pair_with_a_common_band(spark):
    rng, hasher = np.random.default_rng(8), Circulant(50, 5, 1024)
    rows, want, close = [], set(), set()
    for i in range(1500):
        # similarity 92 / 121: several common bands, many near misses in the bands before them
        pool = rng.integers(1 << 62, size=121).astype(np.uint64)
        parts = [np.sort(pool[at]) for at in (slice(0, 107), slice(15, 121))]
        signed = [hasher.signature(p) for p in parts]
        keys = [hasher.keys(s) for s in signed]
        common = np.intersect1d(*keys).view(np.int64)
        for k, s in enumerate(signed):
            low = (s & 255).astype(np.uint8).tobytes()
            rows += [(int(key), 0, 0, 0, 2 * i + k, 2 * i + k, 107 - k, low, parts[k].view(np.int64).tolist()) for key in common]
        t = 75 / 100
        if len(common) and (signed[0] == signed[1]).sum() >= 1024 * (t - 4.5 * (t * (1 - t) / 1024) ** 0.5):
            want |= {2 * i, 2 * i + 1}
            close.add((2 * i, 2 * i + 1))
    met = spark.createDataFrame(rows, MET + ", shingles array<long>")
    met = met.repartition(3, "key").sortWithinPartitions("key", "i", "j")
    assert {r.id for r in _hopeful_rows(met.drop("shingles"), length=1024, percent=75).collect()} == want
    for rows in (met, met.drop("low_bytes")):
        assert {(r.a, r.b) for r in _last_links(rows, length=1024, percent=75).collect()} == close
    assert len(close) > 1000


def test_hub_just_under_the_threshold_gives_out_rows_not_pairs(spark):
    rng, hasher = np.random.default_rng(4), Circulant(50, 5, 1024)
    core = rng.integers(1 << 62, size=84).astype(np.uint64)
    rows = []
    for i in range(3000):
        # any two share 84 of 116 shingles; every hundredth row and the one after it share 4 more
        own = rng.integers(1 << 62, size=16).astype(np.uint64)
        if i % 100 == 1:
            own[:4] = last[:4]
        last = own
        whole = np.concatenate([core, own])
        low = (hasher.signature(whole) & 255).astype(np.uint8).tobytes()
        rows.append((1, 0, 0, 0, i, i, 100, low, np.sort(whole).view(np.int64).tolist()))
    met = spark.createDataFrame(rows, MET + ", shingles array<long>").coalesce(1).sortWithinPartitions("key", "i", "j")
    hopeful = _hopeful_rows(met.drop("shingles"), length=1024, percent=75).collect()
    assert 2900 < len(hopeful) == len({r.id for r in hopeful})
    assert sorted((r.a, r.b) for r in _last_links(met, length=1024, percent=75).collect()) == [(i, i + 1) for i in range(0, 3000, 100)]
