from __future__ import annotations

import random
from collections import Counter

from evidloom.llm.decontaminate import blocks, drop_leaks, find_leaks


def fold(text):
    return (text or "").encode().lower().split()


def grams(w, k):
    return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]


def brute(docs, items, percent=75):
    """Best window of every document and item, by plain counting."""
    out = {}
    for d, text in docs:
        w = fold(text)
        for item, passage in items:
            p = fold(passage)
            if not p:
                continue
            k = min(5, len(p))
            want, best = Counter(grams(p, k)), 0
            for s in range(max(1, len(w) - len(p) + 1)):
                have = Counter(grams(w[s:s + len(p)], k))
                low, high = sum((have & want).values()), sum((have | want).values())
                if high and 100 * low >= percent * high:
                    best = max(best, low / high)
            if best:
                out[d, item] = round(best, 9)
    return out


def test_against_brute_force(spark, make_docs, words):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(15, 60))) for i in range(25)] + [
        (30, None), (31, ""), (32, "qqq www"), (33, "zzz"), (34, "aa bb " * 12), (35, items_dup := text(20)), (36, items_dup)]
    docs = []
    for i in range(120):
        body = text(rng.randint(0, 150)).split()
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(items[:25])[1].split()
            cut = rng.choice([0, 0, 1, 3, 6])
            p = p[cut:] if rng.random() < .5 else p[:len(p) - cut]
            if rng.random() < .3:
                p[rng.randrange(len(p))] = rng.choice(words)
            if rng.random() < .2:
                p.insert(rng.randrange(len(p)), "extra")
            at = rng.randint(0, len(body))
            body[at:at] = [x.upper() if rng.random() < .2 else x for x in p]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(body)))
    docs += [(200, None), (201, ""), (202, "say QQQ www now"), (203, "a zzz b"), (204, "bb aa " * 40), (205, items_dup),
             (206, " ".join(items_dup.split()[:-1])), (207, text(20000) + " " + items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in find_leaks(make_docs(docs), bench).collect()}
    assert got == brute(docs, items)
    dirty = {d for d, _ in got}
    kept = {r.doc_id for r in drop_leaks(make_docs(docs), bench).collect()}
    assert kept == {d for d, _ in docs} - dirty


def test_defined_cases(spark, make_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    leak = "x one two three four five six seven y"
    rows = [(None, leak), (1, leak), (1, leak), (1, "clean text"), (None, None)]
    got = find_leaks(make_docs(rows), bench).collect()
    assert sorted([r.doc_id for r in got], key=repr) == [1, None]
    assert sorted([(r.doc_id, r.text) for r in drop_leaks(make_docs(rows), bench).collect()], key=repr) == [
        (1, "clean text"), (None, None)]
    assert find_leaks(make_docs(rows), bench.where("false")).collect() == []
    assert find_leaks(make_docs(rows).where("false"), bench).collect() == []


def test_blocks_find_every_print_within_the_radius():
    rng = random.Random(3)
    for radius in (3, 7, 23):
        parts = blocks(radius)
        assert sum(mask.bit_length() for _, mask in parts) == 64
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), radius):
                y ^= 1 << b
            assert any((x >> lo) & mask == (y >> lo) & mask for lo, mask in parts)


def test_clashing_columns(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, passage, 5, "x", 1), (2, "clean text", 6, "y", 2)],
                                 "doc_id long, text string, r1 int, r2 string, __r1 int")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(2, "clean text", 6, "y", 2)]
