from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidloom.operators import blocks as BL
from evidloom.operators import retrieval as R
from evidloom.operators.neighbours import NeighbourIndex

CORPUS = [
    ("c1", "Term weighting uses BM25 with document length and term frequency."),
    ("c2", "A hybrid of BM25 and vectors gives better retrieval recall."),
    ("c3", "Nearest neighbour search over stored vector embeddings."),
    ("c4", "Weakest links decide how far confidence can be trusted."),
    ("c5", "émigré data: mixed ASCII and accents, BM25 bm25 BM25"),
]


def frames(spark, queries):
    chunks = spark.createDataFrame(CORPUS, "chunk_id string, text string")
    return chunks, spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")


def words(text):
    import re

    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]


def brute_scores(query):
    docs = [words(t) for _, t in CORPUS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    q = words(query)
    for (cid, _), d in zip(CORPUS, docs):
        tf = Counter(d)
        lex = 0.0
        for w in q:
            df = sum(w in set(x) for x in docs)
            if tf[w]:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                lex += idf * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avg))
        common = set(q) & set(d)
        sem = len(common) / math.sqrt(len(set(q)) * len(set(d)))
        if common:
            out[cid] = (lex, sem)
    return out


QUERIES = ["BM25 term frequency", "BM25 hybrid retrieval recall", "bm25 bm25 accents", "nothing shared zzz"]


def test_pair_scores_match_brute_force(spark):
    chunks, queries = frames(spark, QUERIES)
    got = {(r.query_id, r.chunk_id): (r.lexical, r.semantic) for r in R.score_pairs(chunks, queries).collect()}
    want = {(i, c): s for i, q in enumerate(QUERIES) for c, s in brute_scores(q).items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_large_query_side_gives_the_same_scores(spark, monkeypatch):
    chunks, queries = frames(spark, QUERIES)
    want = sorted(R.score_pairs(chunks, queries).collect())
    monkeypatch.setattr(BL, "fits", lambda *a, **k: False)
    got = sorted(R.score_pairs(chunks, queries).collect())
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r.lexical for r in got], [r.lexical for r in want])


def test_top_result_per_mode(spark):
    chunks, queries = frames(spark, QUERIES)
    pairs = R.score_pairs(chunks, queries)
    lexical = {r.query_id: r.chunk_id for r in R.top_k(pairs, "lexical", 1).collect()}
    hybrid = {r.query_id: r.chunk_id for r in R.top_k(R.hybrid_scores(pairs, queries, score="m"), "m", 1).collect()}
    assert lexical[0] == "c1" and hybrid[1] == "c2" and 3 not in lexical


def test_top_k_bounds_and_weight(spark):
    chunks, queries = frames(spark, QUERIES)
    pairs = R.score_pairs(chunks, queries)
    assert R.top_k(pairs, "lexical", 0).count() == 0
    assert R.top_k(pairs, "lexical", 1).groupBy("query_id").count().agg(F.max("count")).first()[0] == 1
    with pytest.raises(ValueError):
        R.hybrid_scores(pairs, queries, 1.5)


def test_hashed_embedding(spark):
    import hashlib

    text = "alpha beta alpha"
    rows = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    got = {r.id: r.vector for r in R.hashed_embedding(rows, "id").collect()}
    want = [0.0] * 64
    counts = Counter(int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % 64 for w in words(text))
    for b, n in counts.items():
        want[b] = 1 + math.log(n)
    length = math.sqrt(sum(x * x for x in want))
    assert got[1] == pytest.approx([x / length for x in want])
    assert got[2] == [0.0] * 64


@pytest.mark.parametrize("query_rows", [1000, 7])
def test_vector_top_k_is_exact_in_both_forms(spark, query_rows):
    rng = random.Random(3)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(8)]
    # a third of the chunks are copies of one vector
    chunks = [(i, [1.0] * 8 if i % 3 == 0 else vec()) for i in range(150)] + [(900, [0.0] * 8)]
    queries = [(i, vec()) for i in range(40)]
    queries = [q for q in queries if any(q[1])]
    c = spark.createDataFrame(chunks, "chunk_id int, vector array<double>")
    q = spark.createDataFrame(queries, "query_id int, vector array<double>")
    got = {}
    for r in R.vector_top_k(c, q, k=4, query_rows=query_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
    for i, v in queries:
        scored = sorted(
            (-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, w in chunks if any(w))
        assert [(x[1], x[2]) for x in sorted(got[i])] == [(j, -s) for s, j in scored[:4]]


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 16))
    rows = [(i, (base[i % 20] + rng.normal(scale=0.05, size=16)).tolist()) for i in range(300)]
    c = spark.createDataFrame(rows, "chunk_id int, vector array<double>")
    q = spark.createDataFrame([(i, base[i].tolist()) for i in range(20)], "query_id int, vector array<double>")
    exact = R.vector_top_k(c, q, k=5)
    recall = R.recall_at_k(R.approximate_top_k(c, q, k=5), exact).agg(F.avg("recall")).first()[0]
    assert recall > 0.9


def test_inverted_lists_on_clustered_vectors(spark):
    """Recall of .9 or more from under 5 % of all pairs; copies, null and zero vectors, long lists."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 24))
    rows = [(i, (base[i % 60] + rng.normal(scale=0.08, size=24)).tolist()) for i in range(3000)]
    rows += [(5000 + i, base[0].tolist()) for i in range(400)] + [(9000, [0.0] * 24), (9001, None)]
    c = spark.createDataFrame(rows, "chunk_id int, vector array<double>")
    q = spark.createDataFrame([(i, base[i].tolist()) for i in range(60)] + [(99, [0.0] * 24)], "query_id int, vector array<double>")
    index = NeighbourIndex(c, k=5)
    probes = index.tuned_probes(c, q)
    exact = R.vector_top_k(c, q, k=5)
    got = index.top_k(q, probes)
    assert R.recall_at_k(got, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert index.candidate_share(q, probes).first().share < 0.05
    assert [r.chunk_id for r in got.where("query_id = 0").orderBy("rank").collect()] == [5000, 5001, 5002, 5003, 5004]
    # with every list probed the search is exact, parts of a list or not
    whole = index.top_k(q, len(index.centroids))
    assert sorted(whole.collect()) == sorted(exact.select(whole.columns).collect())
    none = NeighbourIndex(c.limit(0), k=5)
    assert none.top_k(q).collect() == []


def test_partitioning_does_not_change_results(spark):
    chunks, queries = frames(spark, QUERIES)
    a = R.top_k(R.score_pairs(chunks.repartition(1), queries), "lexical").collect()
    b = R.top_k(R.score_pairs(chunks.repartition(5), queries.repartition(3)), "lexical").collect()
    assert sorted(a) == sorted(b)


def test_quote_outcomes(spark):
    rows = spark.createDataFrame(
        [("äbcdef", "bc", 1, 3), ("abc", "b", 2, 2), ("abc", "b", -1, 2), ("abc", "bc", 1, 9), ("abc", "x", 1, 2)],
        "t string, q string, s int, e int")
    got = [r[0] for r in rows.select(R.quote_outcome(F.col("t"), F.col("q"), F.col("s"), F.col("e"))).collect()]
    assert got == [None, "invalid_offset_range", "invalid_offset_range", "offset_out_of_bounds", "quote_does_not_match_asset"]


def test_no_text_crosses_an_exchange(spark):
    import re

    chunks, queries = frames(spark, ["bm25 retrieval", "vector search"])
    pairs = R.score_pairs(chunks, queries)

    def moved_by(df):
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
            df._jdf.queryExecution(), "formatted")
        return re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\n", plan)

    for df in (R.top_k(R.hybrid_scores(pairs, queries), "score"), R.term_statistics(chunks)):
        moved = moved_by(df)
        assert moved and not any(re.search(r"\btext#", columns) for columns in moved), moved
    many = chunks.repartition(spark.sparkContext.defaultParallelism)
    for df in (BL.embedded(many, "chunk_id"), BL.chunk_blocks(many)):
        assert all("chunk_id" not in columns or "text" in columns for columns in moved_by(df))
        assert len(moved_by(df)) == len(moved_by(many.select("text").mapInArrow(lambda b: b, "text string")))


def test_index_is_built_from_one_reading_of_the_texts(spark, tmp_path):
    chunks, queries = frames(spark, QUERIES)
    chunks.write.parquet(str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    index = BL.Retrieval(stored, queries, BL.HashedEmbedding())
    for mode in BL.MODES:
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
            index.top(mode)._jdf.queryExecution(), "formatted")
        assert "/chunks]" not in plan and plan.count("MapInArrow") >= 1


def large_case(seed=6):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    chunks = [(f"c{i:03d}", " ".join(rng.choices(pool[:rng.choice([5, 20, 60])], k=rng.randint(0, 30)))) for i in range(300)]
    chunks += [("n1", None), ("n2", ""), ("n3", "..."), *((f"d{i}", "w1 w2 w2 w3") for i in range(20))]
    asks = [" ".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(25)] + ["w1 w2", "", "zzz", "w3 zzz", None]
    return chunks, list(enumerate(asks))


@pytest.mark.parametrize(("query_rows", "block_rows", "vocabulary_rows"), [(2048, 512, 200_000), (2048, 16, 0), (7, 40, 200_000)])
def test_every_ranking_equals_brute_force(spark, query_rows, block_rows, vocabulary_rows):
    chunks, asks = large_case()
    c = spark.createDataFrame(chunks, "chunk_id string, text string")
    q = spark.createDataFrame(asks, "query_id int, text string")
    embed = BL.HashedEmbedding()
    index = BL.Retrieval(c, q, embed, query_rows, vocabulary_rows, block_rows)
    docs = {i: words(t or "") for i, t in chunks}
    vectors = dict(zip(docs, embed([t or "" for _, t in chunks]), strict=True))
    n, known = len(docs), [len(words(t)) for _, t in chunks if t is not None]
    avg = sum(known) / len(known)
    df = Counter(w for d in docs.values() for w in set(d))
    half_up = lambda x: math.floor(x * 1e6 + 0.5) / 1e6
    want = {mode: {} for mode in BL.MODES}
    for number, text in asks:
        own = words(text or "")
        lex, sem, full = {}, {}, {}
        for i, d in docs.items():
            common = set(own) & set(d)
            if common:
                tf = Counter(d)
                lex[i] = sum(math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * tf[w] * 2.5
                             / (tf[w] + 1.5 * (.25 + .75 * len(d) / avg)) for w in own if tf[w])
                sem[i] = len(common) / math.sqrt(len(set(own)) * len(set(d)))
                if len(common) == len(set(own)):
                    full[i] = lex[i]
        v = embed([text or ""])[0]
        cos = {i: half_up(float(v @ x)) for i, x in vectors.items() if x.any() and v.any()}
        scores = {"lexical": lex, "semantic": sem, "all_terms": full, "vector": cos,
                  "mixed": {i: .3 * sem[i] / max(sem.values()) + .7 * lex[i] / max(lex.values()) for i in lex},
                  "vector_plus_lexical": {i: .5 * full.get(i, 0.0) + .5 * x for i, x in cos.items()}}
        for mode, found in scores.items():
            best = sorted((-half_up(s), i) for i, s in found.items() if s > 0 or mode.startswith("vector"))[:4]
            want[mode][number] = [(rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    for mode in BL.MODES:
        got = {number: [] for number, _ in asks}
        for r in index.top(mode, k=4, weight=0.3).collect():
            got[r.query_id].append((r["rank"], r.chunk_id, r.score))
        for number, rows in got.items():
            assert [x[:2] for x in sorted(rows)] == [x[:2] for x in want[mode][number]], (mode, number)
            assert [x[2] for x in sorted(rows)] == pytest.approx([x[2] for x in want[mode][number]], abs=2e-6)


def test_blocks_out_of_reach_are_skipped():
    posts = [("x", [0, 1, 2], [9, 8, 7]), ("y", [0], [1])]

    def block(rows, ids):
        return BL.Block({
            "ids": pa.scalar(ids, pa.list_(pa.int64())), "dl": pa.scalar([10, 10, 10], pa.list_(pa.int32())),
            "nd": pa.scalar([5, 5, 5], pa.list_(pa.int32())), "terms": pa.scalar([r[0] for r in rows], pa.list_(pa.string())),
            "counts": pa.scalar([len(r[1]) for r in rows], pa.list_(pa.int32())), "totals": pa.scalar([0] * len(rows), pa.list_(pa.int32())),
            "slots": pa.scalar([s for r in rows for s in r[1]], pa.list_(pa.int32())),
            "tfs": pa.scalar([t for r in rows for t in r[2]], pa.list_(pa.int32())), "vectors": pa.scalar([], pa.list_(pa.float64()))})

    asks = BL.Queries(pa.table({"query_id": [1, 2], "nq": [1, 1], "terms": [["x"], ["y"]], "weights": [[1.0], [1.0]], "avg_len": [10.0, 10.0]}))
    first = BL._top_of_block(asks, block(posts, [1, 2, 3]), "lexical", 2, 0.5, 6)
    assert first.column("chunk_id").to_pylist() == [1, 2, 1]
    # weaker for x: only the query that has not filled its places looks at it
    second = BL._top_of_block(asks, block([("x", [0, 1], [1, 1]), ("y", [2], [1])], [4, 5, 6]), "lexical", 2, 0.5, 6)
    assert second.column("query_id").to_pylist() == [2]
    assert BL._top_of_block(asks, block([("x", [0], [1])], [7, 8, 9]), "lexical", 2, 0.5, 6) is None


def test_embed_function_is_a_parameter(spark):
    chunks = spark.createDataFrame([(1, "aa"), (2, "b"), (3, None)], "chunk_id int, text string")
    queries = spark.createDataFrame([(9, "bb")], "query_id int, text string")
    lengths = lambda texts: np.array([[len(t), t.count("b")] for t in texts], dtype=float)
    got = R.vector_plus_lexical(chunks, queries, embed=lengths).collect()
    assert [(r.chunk_id, r.score) for r in got] == [(2, 0.5), (1, round(0.5 * round(1 / math.sqrt(2), 6), 6))]


def test_products_with_all_lists_are_cut(spark):
    """Filing and fitting hold the products of few rows at a time, however many lists there are."""
    import tracemalloc

    from evidloom.operators import neighbours as N

    vectors = np.random.default_rng(3).normal(size=(10_000, 64))
    vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    tracemalloc.start()
    centroids = N.fit_centroids(vectors, N.MOST_LISTS, steps=1)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    own, most = N.nearest(vectors[:3_000], centroids)
    whole = vectors[:3_000] @ centroids.T
    assert np.allclose(whole[np.arange(3_000), own], whole.max(axis=1)) and np.allclose(most, whole.max(axis=1))
