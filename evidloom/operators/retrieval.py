"""Batched evidence retrieval.

Texts are tokenised where they are scanned and never cross an exchange: only counts of terms that some
query asks for move, and a per-query top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions import text as T
from evidloom.operators import blocks as BL
from evidloom.operators.blocks import vector_top_k
from evidloom.operators.neighbours import approximate_top_k
from evidloom.operators.skew import top_rows
from evidloom.session import fits


def corpus_size(chunks: DataFrame) -> DataFrame:
    """One row (n_docs, avg_len); an empty corpus has average 0."""
    return chunks.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.avg(T.token_count(F.col("text"))), F.lit(0.0)).alias("avg_len"),
    )


def term_statistics(chunks: DataFrame) -> DataFrame:
    """Document frequency and total frequency per term.

    Each chunk adds one row per word and one per distinct word, which are summed on the map side, so
    the exchange carries one row per term and task.
    """
    toks = chunks.select(T.tokens(F.col("text")).alias("toks"))
    tagged = F.concat(
        F.transform("toks", lambda t: F.struct(t.alias("term"), F.lit(0).alias("first"))),
        F.transform(F.array_distinct("toks"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("first"))))
    rows = toks.select(F.explode_outer(tagged).alias("e")).select("e.*").where("term IS NOT NULL")
    return rows.groupBy("term").agg(
        F.sum("first").alias("df"), F.count_if(F.col("first") == 0).alias("cf"))


def score_pairs(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """R2 and R3 in one pass: (query_id, chunk_id, nq, overlap, lexical, semantic).

    ``lexical`` is BM25 with ln(1 + (N - df + .5) / (df + .5)) and repeated query terms counted;
    ``semantic`` is the cosine of the two term *sets*.  Pairs without a shared term score 0 on
    both and are not emitted.  For rankings use :class:`blocks.Retrieval`, which needs no pairs.
    """
    return BL.Retrieval(chunks, queries).pairs()


def hybrid_scores(pairs: DataFrame, queries: DataFrame, weight: float = 0.5,
                  score: str = "score") -> DataFrame:
    """Both scores divided by their maximum for the query, then mixed.

    The maxima come from a map-side combined aggregate instead of a window over all pairs; there
    is one row per query, so the size check looks at ``queries``.
    """
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight must lie in [0, 1]")
    peaks = pairs.groupBy("query_id").agg(
        F.max("lexical").alias("lex_max"), F.max("semantic").alias("sem_max")
    )
    side = F.broadcast(peaks) if fits(queries.select("query_id")) else peaks

    def share(value: str, peak: str) -> Column:
        top = F.when(F.col(peak) == 0, F.lit(1.0)).otherwise(F.col(peak))
        return F.col(value) / top

    return pairs.join(side, "query_id").withColumn(
        score,
        F.lit(1 - weight) * share("lexical", "lex_max") + F.lit(weight) * share("semantic", "sem_max"),
    )


def top_k(pairs: DataFrame, score: str, k: int = 5, digits: int = 6) -> DataFrame:
    """Best ``k`` chunks per query by rounded score, then chunk position; scores <= 0 drop."""
    kept = pairs.where(F.col(score) > 0).withColumn("score", F.round(score, digits))
    if k <= 0:
        return kept.limit(0).withColumn("rank", F.lit(0))
    return top_rows(kept, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def all_terms_matches(pairs: DataFrame) -> DataFrame:
    """Chunks holding every distinct query term."""
    return pairs.where(F.col("overlap") == F.col("nq"))


def hashed_embedding(rows: DataFrame, id_col: str, dim: int = 64,
                     digits: int | None = None) -> DataFrame:
    """(id, vector) by the hashed embedding, row by row without an exchange."""
    return BL.embedded(rows, id_col, BL.HashedEmbedding(dim, digits))


def vector_plus_lexical(chunks: DataFrame, queries: DataFrame, k: int = 5, dim: int = 64,
                        digits: int = 6, embed: BL.Embed | None = None) -> DataFrame:
    """Half the vector score plus half the all-terms lexical score (0 when absent), without
    normalisation or lexical filter; both come from one block index."""
    index = BL.Retrieval(chunks, queries, embed or BL.HashedEmbedding(dim, digits))
    return index.top("vector_plus_lexical", k, digits=digits)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k that the approximate one found, per query."""
    found = exact.select("query_id", "chunk_id").join(
        approx.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left"
    )
    return found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")
    )


def fuse_candidates(lexical: DataFrame, vector: DataFrame, sections: DataFrame, pool: int = 60,
                    reranked: int = 10, spans: int = 5, per_section: int = 2,
                    weight: float = 0.5) -> DataFrame:
    """Union of two ranked lists -> unique pool -> reranked -> final spans spread over
    sections.

    ``lexical`` and ``vector`` are top lists (query_id, chunk_id, score, rank).  Scores are divided
    by the list maximum per query and mixed as in R4; ``merged_rank`` starts at 1.
    """

    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.select("query_id", "chunk_id", F.col("score").alias(f"{name}_score"),
                         F.col("rank").alias(f"{name}_rank"))

    both = tagged(lexical, "lex").join(tagged(vector, "vec"), ["query_id", "chunk_id"], "full")
    peaks = both.groupBy("query_id").agg(
        F.max("lex_score").alias("lex_max"), F.max("vec_score").alias("vec_max")
    )
    part = lambda s, m: F.coalesce(F.col(s) / F.nullif(F.col(m), F.lit(0.0)), F.lit(0.0))
    merged = both.join(peaks, "query_id").withColumn(
        "fused",
        F.round(F.lit(1 - weight) * part("lex_score", "lex_max")
                + F.lit(weight) * part("vec_score", "vec_max"), 6),
    )
    by_score = [F.desc("fused"), F.asc("chunk_id")]
    merged = top_rows(merged, ["query_id"], by_score, min(pool, reranked), "merged_rank")
    placed = merged.join(sections.select("chunk_id", "section"), "chunk_id")
    spread = top_rows(placed, ["query_id", "section"], [F.asc("merged_rank")], per_section,
                      "section_rank")
    return top_rows(spread, ["query_id"], [F.asc("merged_rank")], spans, "final_rank")


def query_plan(claims: DataFrame) -> DataFrame:
    """Every claim becomes one lexical query; the other plan parts stay empty."""
    empty = F.array().cast("array<string>")
    return claims.select(
        "query_id",
        F.array("text").alias("lexical_queries"),
        empty.alias("semantic_queries"), empty.alias("contrast_queries"),
        F.create_map().cast("map<string,string>").alias("entity_constraints"),
        empty.alias("section_hints"),
    ).withColumn("lexical_query", F.explode("lexical_queries"))


def quote_outcome(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """NULL when the quote is exactly the text in [start, end), else the failure code."""
    size = end - start
    return (
        F.when((start < 0) | (end <= start), "invalid_offset_range")
        .when(end > F.char_length(text), "offset_out_of_bounds")
        .when(F.substr(text, (start + 1).cast("int"), size.cast("int")) != quote,
              "quote_does_not_match_asset")
    )


def select_spans(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Status success / failed per span with its limitation code and the quote hash."""
    code = quote_outcome(F.col("text"), F.col("quote"), F.col("start_offset"), F.col("end_offset"))
    return (
        spans.join(texts, "doc_id")
        .withColumn("limitation", code)
        .withColumn("status", F.when(F.col("limitation").isNull(), "success").otherwise("failed"))
        .withColumn("quote_sha256",
                    F.when(F.col("limitation").isNull(), F.sha2("quote", 256)))
        .drop("text")
    )


def relation_rule(access: Column, n_spans: Column) -> Column:
    """Relation from access level and number of spans."""
    return (
        F.when(access == "not_accessible", "inaccessible_source")
        .when(n_spans == 0, "no_relevant_evidence")
        .otherwise("direct_support")
    )
