from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from evidloom.llm.simhash_dedup import _links, fingerprint, forest, simhash_duplicates, within_radius

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    some = [words[i:i + size] for i in range(len(words) - size + 1)] or [words]
    hashed = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def components(prints, radius):
    """Least position of each component, from all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def flipped(rng, value, n):
    for b in rng.sample(range(64), n):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    prints = [flipped(rng, rng.choice(base), rng.randint(0, radius + 2)) for _ in range(300)]
    cuts = sorted(rng.sample(range(1, 300), 8)) + [300]
    ends = np.array([next(c for c in cuts if c > i) for i in range(300)])
    got = {(int(i), int(j)) for a, b in within_radius(np.array(prints, dtype=np.uint64), ends, radius) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, int(ends[i])) if (prints[i] ^ prints[j]).bit_count() <= radius}
    one = np.full(300, 300)
    assert forest(np.array(prints, dtype=np.uint64), one, radius).tolist() == components(prints, radius)


def documents(words, rng):
    rows, n = [], 0
    for _ in range(25):
        body = rng.choices(words, k=rng.randint(1, 400))
        for _ in range(rng.choice([1, 1, 4])):
            copy = list(body)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, rng.choice([" ", "\n", " \t"]).join(copy).title()))
            n += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "é" * 999), (None, "one two"), (None, None)]
    return rows + rows[:3]


def test_against_brute_force(spark, make_docs, words):
    rows = documents(words, random.Random(7))
    prints = [plain_fingerprint(t) for _, t in rows]
    for block in (5, 32_768):
        got = simhash_duplicates(make_docs(rows), block=block).select("doc_id", "fingerprint", "component_id").collect()
        named = [k for k, (i, _) in enumerate(rows) if i is not None]
        root = components([prints[k] for k in named], 3)
        least = {}
        for k, r in zip(named, root, strict=True):
            least[r] = min(least.get(r, 1 << 60), rows[k][0])
        want = [(rows[k][0], f"{prints[k]:016x}", least[r]) for k, r in zip(named, root, strict=True)]
        want += [(None, f"{prints[k]:016x}", None) for k, (i, _) in enumerate(rows) if i is None]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({r[2] for r in want}) < len(want) - 20


def test_hub_of_near_fingerprints_gives_out_a_forest(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = list({flipped(rng, centre, rng.randint(0, 3)) for _ in range(3000)})
    rows = [(1, 0, 0, k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    frame = spark.createDataFrame(rows, "key long, i int, j int, id long, simhash long").coalesce(1).sortWithinPartitions("key")
    links = _links(frame, 3).collect()
    assert len(links) == len(prints) - 1
    assert {r.b for r in links} == {0}


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_duplicates(none).collect() == []
    odd = spark.createDataFrame([(1, "a b c d", 5, "x", 2), (2, "a b c d", 6, "y", 1)],
                                "doc_id long, text string, key int, id string, component int")
    assert {r.component_id for r in simhash_duplicates(odd).collect()} == {1}


def test_long_text_counts_like_one_list(words):
    rng = random.Random(3)
    text = " ".join(rng.choices(words, k=400_000)) + "\n" + "x" * 100_000 + " End"
    assert fingerprint(text.encode()) == plain_fingerprint(text)
