from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidloom.llm.mixture_pack import Windows, mixture_pack
from evidloom.llm.token_counts import count_tokens
from evidloom.llm.token_output import CapacityTree, best_fit_decreasing, pack_matrix
from evidloom.llm.tokens import byte_encoder, library, word_counter

names = pytest.importorskip("public_tokenizers")
BYTES, RANKS = names.path("byte_bpe_50k.json"), names.path("byte_bpe_50k.tiktoken")
WORDS = names.path("word_bpe_49k.json")
ODD = ["", "a", "  a  b", "it's O'Re's <|endoftext|> x", "\x1c!\x1c! x\x85y", "É È ﬁ 日本語", "x" * 3000, "a\n\n\nb  \n c ",
       "Σας ΟΔΟΣ", "İstanbul", "<|STARTOFTEXT|> 12345 --- $$$%%%", "a b c", "👍🏽 ok é"]


def ids_of(text):
    return library(BYTES).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_same_ids_and_counts_as_the_library(text):
    assert np.frombuffer(byte_encoder(BYTES, RANKS)(text), dtype="<u2").tolist() == ids_of(text)
    assert word_counter(WORDS)(text) == len(library(WORDS).encode(text, add_special_tokens=False).ids)


def test_counts(make_docs):
    rows = list(enumerate(ODD)) + [(None, None), (50, "word " * 5000), (3, ODD[3])]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(make_docs(rows), WORDS).collect()), key=repr)
    want = []
    for i, t in rows:
        n = len(library(WORDS).encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=repr)
    assert count_tokens(make_docs(rows).where("false"), WORDS).collect() == []


def check_sequences(spans, window):
    """Sequences are gapless from 0; all but full ones have a length that is a power of two."""
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        used = own[-1][1]
        assert used == window or used < window and used & (used - 1) == 0
    assert sorted(spans) == list(range(len(spans)))


def test_windows_are_gapless_for_any_lengths():
    rng = random.Random(4)
    for _ in range(150):
        window = rng.choice([16, 64, 2048])
        lengths = [rng.randint(1, rng.choice([5, 500, 30_000])) for _ in range(rng.randint(1, 40))]
        windows, spans, place = Windows(sum(lengths), window), {}, 0
        for n in lengths:
            seq, off, start = windows.pieces(place, n)
            ends = np.append(start[1:], n)
            assert start[0] == 0 and (ends > start).all() and len(start) <= n // window + 2 + window.bit_length()
            for s, o, a, e in zip(seq.tolist(), off.tolist(), start.tolist(), ends.tolist()):
                spans.setdefault(s, []).append((o, o + e - a))
            place += n
        check_sequences(spans, window)


def round_robin(queues, quanta):
    """Sequential deficit round-robin over queues of (document, length): the order of the documents."""
    queues, deficit, out = [list(q) for q in queues], [0.0] * len(queues), []
    while any(queues):
        for i, queue in enumerate(queues):
            deficit[i] += quanta[i]
            while queue and queue[0][1] <= deficit[i] + 1e-6:
                doc, n = queue.pop(0)
                deficit[i] -= n
                out.append(doc)
    return out


@pytest.mark.parametrize("shares", [None, {"s0": .5, "s1": .25, "s2": .25}])
def test_documents_come_in_the_order_of_a_sequential_round_robin(spark, shares):
    rng = random.Random(12)
    rows = [(i, " ".join(["a"] * rng.choice([0, 5, 40, 300, 3000 if i % 50 == 0 else 90])), f"s{i % 3 if i % 5 else 0}")
            for i in range(400)]
    rows += [(400 + i, "a b c", f"t{i}") for i in range(3)]  # below a token of a window: one queue
    window = 256
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixture_pack(docs, BYTES, RANKS, window=window, shares=shares, part_rows=50).collect()
    start = {r.doc_id: (r.sequence_id, r.offset) for r in got if r.start == 0}
    size = {r.doc_id: r.doc_tokens for r in got}
    source = {i: s for i, _, s in rows}
    total, tokens = sum(size.values()), Counter()
    for i, n in size.items():
        tokens[source[i]] += n
    share = {s: tokens[s] / total for s in tokens} if shares is None else shares
    names = sorted(s for s in tokens if share.get(s, 0) * window >= 1)
    pool = [s for s in tokens if s not in names]
    order = sorted(size, key=start.get)
    queues = [[(i, size[i]) for i in order if source[i] in own] for own in [*([n] for n in names), pool]]
    quanta = [share[n] * window for n in names] + [sum(share.get(s, 0) for s in pool) * window]
    if not quanta[-1]:  # without a share: after all others
        assert order[-len(queues[-1]):] == [i for i, _ in queues.pop()]
        order, quanta = order[:-len(pool)], quanta[:-1]
    assert order == round_robin(queues, quanta)
    # documents are cut at ends of windows only
    assert len(got) <= len(rows) + total // window + window.bit_length()
    if shares is None:
        # what a queue has got differs from its share by the deficits, each at most the longest document
        most = {s: max(size[i] for i in size if source[i] == s) for s in tokens}
        for w in range(0, total // window - 50, 7):
            seen = Counter()
            for r in got:
                if w <= r.sequence_id < w + 50:
                    seen[source[r.doc_id]] += r.length
            for s in names:
                assert abs(seen[s] - share[s] * 50 * window) <= most[s] + share[s] * sum(most.values()) + window


def test_mixture_pack_round_trip(make_docs, words):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 300)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "x y"), (5, rows[5][1]), (300, " ".join(rng.choices(words, k=9000)))]
    docs = make_docs(rows).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    got = mixture_pack(docs, BYTES, RANKS, part_rows=20).collect()
    spans, ids = {}, {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
        ids.setdefault(r.doc_id, []).append(r)
    check_sequences(spans, 2048)
    for i, text in rows:
        whole = np.array([*ids_of(text), 1], dtype="<u4")
        own = [r for r in ids[i] if r.doc_tokens == len(whole)]
        assert {r.start for r in own} and sum(r.length for r in own) == len(whole) * (2 if i == 5 else 1)
        for r in own:
            assert zlib.crc32(whole[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert mixture_pack(make_docs(rows).where("false"), BYTES, RANKS).collect() == []


def packed_tokens(spark, sizes, shares=None, window=64):
    """Tokens of each source in each full window."""
    rows = [(i, " ".join(["a"] * n), s) for i, (s, n) in enumerate((s, n) for s, m in sizes.items() for n in [20] * m)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    got = mixture_pack(docs, BYTES, RANKS, window=window, shares=shares).collect()
    out = {}
    for r in got:
        seen = out.setdefault(r.sequence_id, Counter())
        seen[source[r.doc_id]] += r.length
    assert sum(r.length for r in got) == sum(c.total() for c in out.values())
    return [out[k] for k in sorted(out) if out[k].total() == window]


def test_each_source_that_reaches_a_token_has_its_quantum(spark):
    sizes = {f"s{i}": 30 for i in range(160)}  # 1/160 each: 1.6 tokens of 256; documents have 21 tokens
    full = packed_tokens(spark, sizes, window=256)
    for w in range(1, len(full)):
        taken = sum(full[:w], Counter())
        assert all(abs(taken[s] - 1.6 * w) <= 42 for s in sizes)


def test_target_shares_of_small_sources_are_kept(spark):
    def kept(full, source, quantum):
        return all(abs(sum(c[source] for c in full[:w]) - w * quantum) <= 42 for w in range(1, len(full) + 1))

    # under a token of a window in the corpus, a quarter of each in the mixture
    full = packed_tokens(spark, {"big": 600, "tiny": 2}, {"big": .75, "tiny": .25})
    assert kept(full[:2], "tiny", 16) and sum(c["tiny"] for c in full[:5]) == 42
    # targets under a token each: their sum is kept
    many = {f"t{i}": 1 for i in range(40)}
    full = packed_tokens(spark, {"big": 200} | many, {"big": .75} | {s: .25 / 40 for s in many})
    assert kept(full[:40], "big", 48)
    # what the targets leave of 1 goes to the others by their tokens
    full = packed_tokens(spark, {"a": 100, "b": 50, "c": 50}, {"a": .5})
    assert kept(full[:-2], "a", 32) and kept(full[:-2], "b", 16)


def test_best_fit_against_a_scan():
    rng = random.Random(8)
    for _ in range(40):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 120))]
        rows = best_fit_decreasing(lengths, 100)
        free: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(100 - n)
        used = {}
        for n, r in zip(lengths, rows):
            used[r] = used.get(r, 0) + n
        assert sorted(100 - u for u in used.values()) == sorted(free)
    assert CapacityTree(10).take(3) is None


def test_matrix_round_trip(make_docs, words):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 200)))) for i in range(60)]
    rows += [(70, None), (71, " ".join(rng.choices(words, k=4000))), (None, "a b")]
    packed = pack_matrix(make_docs(rows), BYTES, RANKS, end_id=50256, pad_id=0, width=256, shard_tokens=4000).collect()
    found = {}
    for r in packed:
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == r.cu_seqlens[:-1] and not ids[r.n_tokens:].any()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            found.setdefault(doc, {})[start] = ids[a:b].tolist()
    for i, text in rows:
        assert [x for s in sorted(found[i]) for x in found[i][s]] == [*ids_of(text), 50256]
    assert len({r.sequence_id for r in packed}) == len(packed)
