"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions import text as T
from evidloom.functions import vectors as V
from evidloom.operators import blocks as BL
from evidloom.operators import retrieval as R
from evidloom.operators.neighbours import NeighbourIndex
from evidloom.plans.registry import query
from evidloom.session import through_table

_TOK = r"list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))"

# (query_id, chunk_id, nq, overlap, lexical, semantic) for all pairs with a shared term
PAIRS = f"""
WITH dt AS (SELECT chunk_id, section, source_span_id, text, {_TOK} AS toks FROM v_chunks),
dlen AS (SELECT chunk_id, len(toks) AS dl, len(list_distinct(toks)) AS nd FROM dt),
post AS (SELECT chunk_id, term, count(*) AS tf
         FROM (SELECT chunk_id, unnest(toks) AS term FROM dt) GROUP BY ALL),
dfreq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dlen),
qt AS (SELECT query_id, term, count(*) AS qtf
       FROM (SELECT query_id, unnest({_TOK}) AS term FROM v_queries) GROUP BY ALL),
qn AS (SELECT query_id, count(*) AS nq FROM qt GROUP BY query_id),
pairs AS (
  SELECT qt.query_id, post.chunk_id, any_value(qn.nq) AS nq, count(*) AS overlap,
         sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
             / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avgdl, 1e-9::DOUBLE)))) AS lexical,
         count(*) / sqrt(any_value(qn.nq) * any_value(nd)::DOUBLE) AS semantic
  FROM qt JOIN post USING (term) JOIN dfreq USING (term) JOIN dlen USING (chunk_id)
  JOIN qn USING (query_id), stat
  GROUP BY qt.query_id, post.chunk_id)
"""


def _ranked(score: str, source: str = "pairs", k: int = 5, where: str = "true") -> str:
    return f"""{PAIRS}
SELECT query_id, chunk_id, score, rank FROM (
  SELECT query_id, chunk_id, round({score}, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, chunk_id) AS rank
  FROM {source} WHERE {where}) WHERE rank <= {k}"""


def _embed(view: str, id_col: str, name: str) -> str:
    """CTEs computing the hashed embedding ``name``(id, vector) of a view."""
    return f"""
{name}_c AS (
  SELECT {id_col}, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS b, sum(n) AS n
  FROM (SELECT {id_col}, term, count(*) AS n
        FROM (SELECT {id_col}, unnest({_TOK}) AS term FROM {view}) GROUP BY ALL) GROUP BY ALL),
{name}_w AS (
  SELECT {id_col}, b, (1 + ln(n)) AS w, sqrt(sum((1 + ln(n)) * (1 + ln(n))) OVER (PARTITION BY {id_col})) AS len
  FROM {name}_c),
{name} AS (
  SELECT {id_col}, list(coalesce(round(w / len, 6), 0::DOUBLE) ORDER BY i) AS vector
  FROM (SELECT s.{id_col}, i, w, len
        FROM (SELECT {id_col}, unnest(range(0, 64)) AS i FROM {view}) s
        LEFT JOIN {name}_w e ON e.{id_col} = s.{id_col} AND e.b = s.i)
  GROUP BY {id_col})"""


VECTORS = "WITH" + _embed("v_chunks", "chunk_id", "cv") + "," + _embed("v_queries", "query_id", "qv") + """,
vpairs AS (
  SELECT query_id, chunk_id, round(list_cosine_similarity(qv.vector, cv.vector), 6) AS cosine
  FROM qv, cv
  WHERE list_max(list_transform(qv.vector, lambda x: abs(x))) > 0
    AND list_max(list_transform(cv.vector, lambda x: abs(x))) > 0)
"""


@query("f1_tokenise", f"""
SELECT chunk_id, len({_TOK}) AS n_tokens, md5(array_to_string({_TOK}, ' ')) AS token_hash FROM v_chunks""")
def f1(v):
    toks = T.tokens(F.col("text"))
    return v("v_chunks").select(
        "chunk_id", F.size(toks).cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(toks, " ")).alias("token_hash"),
    )


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("f2_text_normalise", f"""
SELECT doc_id, md5(norm) AS norm_hash, length(norm) AS n_chars FROM (
  SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '{_SPACE}', ' ', 'g'), '^ | $', '', 'g') AS norm
  FROM documents)""")
def f2(v):
    norm = T.normalise(F.col("text"))
    return (
        v("documents").select("doc_id", norm.alias("norm"))
        .select("doc_id", F.md5("norm").alias("norm_hash"),
                F.char_length("norm").cast("bigint").alias("n_chars"))
    )


@query("r1_corpus_statistics", f"""{PAIRS}
SELECT term, df, (SELECT sum(tf) FROM post p WHERE p.term = dfreq.term)::BIGINT AS cf,
       (SELECT n FROM stat) AS n_docs, round((SELECT avgdl FROM stat), 6) AS avg_len FROM dfreq""")
def r1(v):
    size = R.corpus_size(v("v_chunks"))
    return R.term_statistics(v("v_chunks")).select(
        "term", "df", "cf", size.select("n_docs").scalar().alias("n_docs"),
        F.round(size.select("avg_len").scalar(), 6).alias("avg_len"),
    )


@query("j11_query_postings", f"""{PAIRS}
SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS occurrences
FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term""")
def j11(v):
    return _index(v).term_counts()


def _index(v, embed=None):
    return BL.Retrieval(v("v_chunks"), v("v_queries"), embed)


@query("r2_bm25_scores", f"""{PAIRS}
SELECT query_id, count(*) AS chunks, round(sum(lexical), 4) AS total, round(max(lexical), 6) AS best
FROM pairs GROUP BY query_id""")
def r2(v):
    return _index(v).sums().select(
        "query_id", F.col("n").alias("chunks"), F.round("total", 4).alias("total"), F.round("best", 6).alias("best"))


@query("w1_bm25_top_k", _ranked("lexical"))
def w1(v):
    return _index(v).top("lexical").select("query_id", "chunk_id", "score", "rank")


@query("r3_set_cosine_top_k", _ranked("semantic"))
def r3(v):
    return _index(v).top("semantic").select("query_id", "chunk_id", "score", "rank")


_HYBRID = """0.5::DOUBLE * lexical / max(lexical) OVER (PARTITION BY query_id)
    + 0.5::DOUBLE * semantic / max(semantic) OVER (PARTITION BY query_id)"""


@query("r4_hybrid_top_k", f"""{PAIRS}, hyb AS (SELECT query_id, chunk_id, {_HYBRID} AS s FROM pairs)
SELECT query_id, chunk_id, score, rank FROM (
  SELECT query_id, chunk_id, round(s, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, chunk_id) AS rank
  FROM hyb) WHERE rank <= 5""")
def r4(v):
    return _index(v).top("mixed").select("query_id", "chunk_id", "score", "rank")


@query("w4_max_normalise", f"""{PAIRS}
SELECT query_id, round(avg(x), 6) AS mean_share, round(min(x), 6) AS least_share
FROM (SELECT query_id, lexical / max(lexical) OVER (PARTITION BY query_id) AS x FROM pairs) GROUP BY query_id""")
def w4(v):
    top = F.when(F.col("best") == 0, F.lit(1.0)).otherwise(F.col("best"))
    return _index(v).sums().select(
        "query_id", F.round(F.col("total") / F.col("n") / top, 6).alias("mean_share"),
        F.round(F.col("least") / top, 6).alias("least_share"))


@query("r5_hashed_embedding", "WITH" + _embed("v_chunks", "chunk_id", "cv") + """
SELECT chunk_id, array_to_string(list_transform(vector, lambda x: CAST(CAST(round(x * 10000) AS INT) AS VARCHAR)), ',') AS vector
FROM cv""")
def r5(v):
    emb = R.hashed_embedding(v("v_chunks"), "chunk_id", digits=6)
    text = F.transform("vector", lambda x: F.round(x * 10000).cast("int").cast("string"))
    return emb.select("chunk_id", F.array_join(text, ",").alias("vector"))


def _vectors(v):
    return (R.hashed_embedding(v("v_chunks"), "chunk_id", digits=6),
            R.hashed_embedding(v("v_queries"), "query_id", digits=6))


@query("r6_vector_top_k", VECTORS + """
SELECT query_id, chunk_id, cosine AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM vpairs)
WHERE rank <= 5""")
def r6(v):
    cv, qv = _vectors(v)
    return R.vector_top_k(cv, qv)


_CENTROIDS = """
WITH parts AS (SELECT label, i, avg(x::DOUBLE) AS m
               FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY ALL),
q AS (SELECT label AS query_id, list(m ORDER BY i) AS vector FROM parts GROUP BY label)"""


def _label_centroids(v):
    parts = v("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # one row per vector component reaches each group
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("vector")
    )


def _embedding_chunks(v):
    return v("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


@query("j10_embedding_neighbours", _CENTROIDS + """
SELECT query_id, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(vector, embedding::DOUBLE[]), 6) AS score
    FROM q, embeddings)) WHERE rank <= 10""")
def j10(v):
    return R.vector_top_k(_embedding_chunks(v), _label_centroids(v), k=10)


@query("f16_vector_measures", """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot,
       round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def f16(v):
    a = v("embeddings").select("vec_id", "embedding")
    b = v("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x, y = F.col("embedding"), F.col("other")
    return a.join(b, "vec_id").select(
        "vec_id", F.round(V.dot(x, y), 6).alias("dot"), F.round(V.norm(x), 6).alias("norm"),
        F.round(V.cosine(x, y), 6).alias("cosine"),
    )


@query("r7_all_terms_filter", _ranked("lexical", where="overlap = nq"))
def r7(v):
    return _index(v).top("all_terms").select("query_id", "chunk_id", "score", "rank")


@query("r8_vector_plus_lexical", VECTORS + "," + PAIRS.strip()[4:] + """,
s AS (SELECT v.query_id, v.chunk_id,
             round(0.5::DOUBLE * coalesce(CASE WHEN p.overlap = p.nq THEN p.lexical END, 0) + 0.5::DOUBLE * v.cosine, 6) AS score
      FROM vpairs v LEFT JOIN pairs p USING (query_id, chunk_id))
SELECT query_id, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def r8(v):
    return R.vector_plus_lexical(v("v_chunks"), v("v_queries")).select(
        "query_id", "chunk_id", "score", "rank")


def _neighbours(v):
    """Index, queries, probes that reach the target recall, exact and approximate rows."""
    chunks, queries = _embedding_chunks(v), through_table(_label_centroids(v), "label-centroids")
    index = NeighbourIndex(chunks, k=10)
    probes = index.tuned_probes(chunks, queries)
    return index, queries, probes, R.vector_top_k(chunks, queries, k=10), index.top_k(queries, probes)


@query("r9_approximate_neighbours")
def r9(v):
    _, _, _, exact, approx = _neighbours(v)
    return R.recall_at_k(approx, exact).select("query_id", "n", F.round("recall", 6).alias("recall"))


@query("r9_index_report", _CENTROIDS + """,
s AS (SELECT query_id, round(list_cosine_similarity(vector, embedding::DOUBLE[]), 6) AS score FROM q, embeddings),
best AS (SELECT query_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM s) WHERE rank <= 10)
SELECT query_id, count(*) AS n, round(max(score), 6) AS best, round(min(score), 6) AS last, TRUE AS recall_reached, TRUE AS fewer_candidates
FROM best GROUP BY query_id""")
def r9_report(v):
    index, queries, probes, exact, approx = _neighbours(v)
    recall = R.recall_at_k(approx, exact).agg(F.avg("recall")).scalar()
    share = index.candidate_share(queries, probes).select("share").scalar()
    return exact.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min("score").alias("last")).withColumn(
        "recall_reached", recall >= 0.9).withColumn("fewer_candidates", share < 1.0)


@query("r10_candidate_fusion", VECTORS + "," + PAIRS.strip()[4:] + """,
l AS (SELECT query_id, chunk_id, round(lexical, 6) AS lex_score, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, chunk_id) AS r FROM pairs),
e AS (SELECT query_id, chunk_id, cosine AS vec_score, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS r FROM vpairs),
u AS (SELECT query_id, chunk_id, lex_score, vec_score FROM (SELECT * FROM l WHERE r <= 40) a
      FULL JOIN (SELECT * FROM e WHERE r <= 40) b USING (query_id, chunk_id)),
f AS (SELECT query_id, chunk_id,
        round(0.5::DOUBLE * coalesce(lex_score / nullif(max(lex_score) OVER w, 0), 0)
            + 0.5::DOUBLE * coalesce(vec_score / nullif(max(vec_score) OVER w, 0), 0), 6) AS fused
      FROM u WINDOW w AS (PARTITION BY query_id)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS merged_rank FROM f) WHERE merged_rank <= 10),
s AS (SELECT m.*, dt.section, row_number() OVER (PARTITION BY query_id, section ORDER BY merged_rank) AS section_rank FROM m JOIN dt USING (chunk_id))
SELECT query_id, chunk_id, fused, merged_rank, section, final_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY merged_rank) AS final_rank FROM s WHERE section_rank <= 2)
WHERE final_rank <= 5""")
def r10(v):
    index = _index(v, BL.HashedEmbedding(digits=6))
    lexical, nearest = index.top("lexical", k=40), index.top("vector", k=40)
    return R.fuse_candidates(lexical, nearest, v("v_chunks")).select(
        "query_id", "chunk_id", "fused", "merged_rank", "section", "final_rank")


@query("r11_query_plan", """
SELECT query_id, text AS lexical_query, 1 AS n_lexical, 0 AS n_semantic, 0 AS n_contrast, 0 AS n_hints FROM v_queries""")
def r11(v):
    return R.query_plan(v("v_queries")).select(
        "query_id", "lexical_query", F.size("lexical_queries").alias("n_lexical"),
        F.size("semantic_queries").alias("n_semantic"),
        F.size("contrast_queries").alias("n_contrast"), F.size("section_hints").alias("n_hints"),
    )


_QUOTE_CODE = """CASE WHEN start_offset < 0 OR end_offset <= start_offset THEN 'invalid_offset_range'
            WHEN end_offset > length(text) THEN 'offset_out_of_bounds'
            WHEN substring(text, start_offset + 1, end_offset - start_offset) <> quote THEN 'quote_does_not_match_asset' END"""


@query("f12_quote_validation", f"""
SELECT span_id, coalesce({_QUOTE_CODE}, 'ok') AS outcome FROM v_spans JOIN documents USING (doc_id)""")
def f12(v):
    spans = R.select_spans(v("v_spans"), v("documents").select("doc_id", "text"))
    return spans.select("span_id", F.coalesce("limitation", F.lit("ok")).alias("outcome"))


@query("r12_exact_spans", f"""
SELECT span_id, CASE WHEN code IS NULL THEN 'success' ELSE 'failed' END AS status, code AS limitation,
       CASE WHEN code IS NULL THEN sha256(quote) END AS quote_sha256
FROM (SELECT *, {_QUOTE_CODE} AS code FROM v_spans JOIN documents USING (doc_id))""")
def r12(v):
    return R.select_spans(v("v_spans"), v("documents").select("doc_id", "text")).select(
        "span_id", "status", "limitation", "quote_sha256")


@query("k2_evidence_retrieval_job", f"""{PAIRS}, hyb AS (SELECT query_id, chunk_id, {_HYBRID} AS s FROM pairs),
top AS (SELECT * FROM (SELECT query_id, chunk_id, round(s, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, chunk_id) AS rank FROM hyb) WHERE rank <= 5),
sp AS (SELECT doc_id AS chunk_id, {_QUOTE_CODE} AS code FROM v_spans JOIN documents USING (doc_id)),
good AS (SELECT query_id, count(*) FILTER (WHERE rank IS NOT NULL) AS retrieved, count(*) FILTER (WHERE rank IS NOT NULL AND code IS NULL) AS spans
         FROM v_queries LEFT JOIN top USING (query_id) LEFT JOIN sp USING (chunk_id) GROUP BY query_id)
SELECT query_id, retrieved, spans, CASE WHEN spans = 0 THEN 'no_relevant_evidence' ELSE 'direct_support' END AS relation FROM good""")
def k2(v):
    plans = R.query_plan(v("v_queries")).select("query_id", F.col("lexical_query").alias("text"))
    top = BL.Retrieval(v("v_chunks"), plans).top("mixed")
    spans = R.select_spans(v("v_spans"), v("documents").select("doc_id", "text"))
    checked = top.join(
        spans.select(F.col("doc_id").alias("chunk_id"), "status"), "chunk_id", "left"
    )
    per_query = checked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("retrieved"), F.count_if(F.col("status") == "success").alias("spans")
    )
    filled = v("v_queries").select("query_id").join(per_query, "query_id", "left").fillna(0)
    return filled.withColumn(
        "relation", R.relation_rule(F.lit("open_access_full_text"), F.col("spans"))
    )
