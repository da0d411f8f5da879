from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from evidloom.llm.common import word_pieces
from evidloom.llm.importance import WORD_BYTES, crc_matrices, importance_resample, importance_weights

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest=1):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    found = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in found]


def brute(rows, target, percent=10, longest=1):
    docs = [(i, *features(t, longest)) for i, t in rows]
    s = Counter(b for _, _, fs in docs for b in fs)
    t = Counter(b for x in target for b in features(x, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))

    out, able = [], []
    for i, n, fs in docs:
        weight = sum(map(gain, fs)) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None])
        if n >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] or -1))
    for place, row in enumerate(able[:percent * len(able) // 100], 1):
        row[4] = place
    return sorted(map(tuple, out), key=repr)


def texts(words, n, seed=3):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))).title() for _ in range(n)]


@pytest.mark.parametrize(("percent", "longest"), [(10, 1), (60, 1), (25, 3), (0, 1)])
def test_against_brute_force(spark, make_docs, words, percent, longest):
    rows = list(enumerate(texts(words, 150)))
    rows += [(900, None), (901, ""), (902, " .,;!"), (903, "É" * 900 + " a" * 30), (904, "ab" * 90 + "-x1" * 25), (None, "zz " * 25)]
    rows += rows[:3]
    target = [*texts(words[:40], 12, 8), None, ""]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resample(make_docs(rows), wanted, percent=percent, longest=longest)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, target, percent, longest)


def test_empty_tables_and_clashing_columns(spark, make_docs, words):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance_resample(none, target).collect() == []
    rows = list(enumerate(texts(words, 30)))
    plain = importance_resample(make_docs(rows), none, percent=50)
    assert sorted(map(tuple, plain.collect())) == sorted(brute(rows, [], 50), key=lambda r: r[0])
    odd = spark.createDataFrame([(1, "x " * 30, "q", 7, 1.5)], "doc_id long, text string, score string, rank int, weight double")
    assert importance_resample(odd, target, percent=100).first().rank == 1


def test_equal_scores_by_id(spark):
    # equal ids have equal scores: all places are given out once
    rows = spark.createDataFrame([(1, "w " * 20)] * 6 + [(2, "w " * 20)] * 2, "doc_id long, text string")
    got = importance_resample(rows, rows, percent=50).where("rank is not null").collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4]


def test_crc_matrices_equal_the_plain_function():
    rng = random.Random(1)
    some = [rng.randbytes(rng.randint(0, 80)) for _ in range(500)]
    assert crc_matrices(some).tolist() == [zlib.crc32(x) for x in some]
    assert crc_matrices([]).tolist() == []


def test_long_text_in_pieces_counts_like_one_list(spark):
    data = ("ab cd-ef " * 5000 + "x" * 9000 + " y" * 100).encode()
    pieces = list(word_pieces(data, WORD_BYTES, 700))
    assert len(pieces) > 20
    assert [w for p in pieces for w in p] == data.translate(WORD_BYTES).split()
    text = "lorem ipsum dolor " * 200_000
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for longest in (1, 2):
        out, _ = importance_weights(frame, frame, longest)
        assert out.first().n_features == 600_000 * longest - (longest - 1)
