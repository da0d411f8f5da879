"""Block index of a chunk corpus, and ranked retrieval over it.

The corpus is tokenised once, where it is scanned.  Every batch becomes one block row: ids and lengths of its chunks, a
compressed sparse matrix of the terms that the queries ask for (all terms if the vocabulary is too large to
send along), and embedding vectors if wanted.  The blocks are written once; document frequencies, the average length
and every score come from them.  A block meets the queries inside one task and gives out its best ``k`` chunks per
query, so neither postings nor (query, chunk) pairs cross an exchange.

Pruning: the largest impact of each term in the block bounds what a query can score there.  A query whose bound
lies below the ``k``-th best score that the task has found for it so far skips the block.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.operators.skew import top_rows
from evidloom.session import fits, through_table

K1, B = 1.5, 0.75
QUERY_BLOCK = 2_048
BLOCK_ROWS = 512
MEET_BLOCKS = 32
TOKEN = re.compile("[A-Za-z0-9]+")
MODES = ("lexical", "semantic", "mixed", "all_terms", "vector", "vector_plus_lexical")

Embed = Callable[[list[str]], np.ndarray]


def tokens_of(text: str | None) -> list[str]:
    """F1 tokens: matched first, lower-cased then."""
    return " ".join(TOKEN.findall(text or "")).lower().split()


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    scale = 10.0 ** digits
    return np.floor(values * scale + 0.5) / scale


class HashedEmbedding:
    """Tokens hashed into ``dim`` buckets, weight 1 + ln(count), unit length; no tokens give zeros.

    A bucket is the first four bytes of sha256(token), big-endian, modulo ``dim``; a distinct token is hashed once.
    """

    def __init__(self, dim: int = 64, digits: int | None = None, keep: int = 200_000) -> None:
        self.dim, self.digits, self.keep = dim, digits, keep
        self.known: dict[str, int] = {}

    def bucket(self, token: str) -> int:
        found = self.known.get(token)
        if found is None:
            found = int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big") % self.dim
            self.known[token] = found
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known.clear()
        counts = np.zeros((len(texts), self.dim))
        for row, text in zip(counts, texts, strict=True):
            own = tokens_of(text)
            if own:
                row += np.bincount([self.bucket(t) for t in own], minlength=self.dim)
        weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0)
        length = np.sqrt((weights * weights).sum(axis=1, keepdims=True))
        vectors = np.divide(weights, length, out=np.zeros_like(weights), where=length > 0)
        return vectors if self.digits is None else half_up(vectors, self.digits)


def embedded(rows: DataFrame, id_col: str, embed: Embed | None = None) -> DataFrame:
    """PY5: ``id, vector`` by any function from texts to a matrix; row-local, no exchange.  Null text counts as ''."""
    embed = embed or HashedEmbedding()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(embed([t or "" for t in batch.column("text").to_pylist()]), dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), _lists(vectors)], names=[id_col, "vector"])

    kind = dict(rows.dtypes)[id_col]
    return on_all_cores(rows.select(id_col, "text"), id_col).mapInArrow(run, f"{id_col} {kind}, vector array<double>")


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(matrix.ravel()))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of length 1; null vectors and those without length become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = int(pc.max(pc.list_value_length(column)).as_py() or 0)
    out = np.full((len(column), width), np.nan)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(there.sum()), width)
    length = np.sqrt((out * out).sum(axis=1))
    length[length == 0] = np.nan
    return out / length[:, None]


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest finite scores of each row; equal scores go to the smaller column."""
    width = scores.shape[1]
    if not width or k <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if width > k:
        least = np.partition(scores, width - k, axis=1)[:, width - k]
        rows, cols = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    else:
        rows, cols = np.nonzero(np.isfinite(scores))
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(scores.shape[0]))
    kept = np.arange(len(rows)) - first[rows] < k
    return rows[kept], cols[kept]


def on_all_cores(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a scan with fewer partitions than cores (a few small files, one row group) dealt to all of them; a scan
    with more partitions stays as it is, and no text moves."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def chunk_blocks(chunks: DataFrame, vocabulary: set[str] | None = None, embed: Embed | None = None,
                 rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of up to ``rows`` chunks, in order of their ids.

    ``ids, dl`` (tokens, -1 for null text), ``nd`` (distinct tokens), the sparse matrix as ``terms, counts`` (chunks of each),
    ``totals`` (occurrences), ``slots, tfs``; ``vectors`` row by row.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                part = part.take(pc.sort_indices(part.column("chunk_id")))
                texts = part.column("text").to_pylist()
                dl, nd = [], []
                posts: dict[str, list[tuple[int, int]]] = defaultdict(list)
                for slot, text in enumerate(texts):
                    own = tokens_of(text)
                    counted = Counter(own)
                    dl.append(-1 if text is None else len(own))
                    nd.append(len(counted))
                    for term, n in counted.items():
                        if vocabulary is None or term in vocabulary:
                            posts[term].append((slot, n))
                pairs = [p for own in posts.values() for p in own]
                row = {
                    "dl": dl, "nd": nd, "terms": list(posts), "counts": [len(own) for own in posts.values()],
                    "totals": [sum(n for _, n in own) for own in posts.values()],
                    "slots": [s for s, _ in pairs], "tfs": [n for _, n in pairs],
                    "vectors": np.asarray(embed([t or "" for t in texts]), dtype=np.float64).ravel() if embed else [],
                }
                kinds = {"terms": pa.string(), "vectors": pa.float64()}
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays([0, part.num_rows], part.column("chunk_id")),
                     *(pa.array([v], pa.list_(kinds.get(name, pa.int32()))) for name, v in row.items())],
                    names=["ids", *row])

    kind = dict(chunks.dtypes)["chunk_id"]
    ints = ", ".join(f"{c} array<int>" for c in ("counts", "totals", "slots", "tfs"))
    return on_all_cores(chunks.select("chunk_id", "text"), "chunk_id").mapInArrow(
        build, f"ids array<{kind}>, dl array<int>, nd array<int>, terms array<string>, {ints}, vectors array<double>")


class Block:
    """One block row as arrays."""

    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        get = lambda name: row[name].values.to_numpy(zero_copy_only=False)
        self.ids = row["ids"].values
        self.dl, self.nd = np.maximum(get("dl"), 0).astype(np.float64), get("nd").astype(np.float64)
        self.terms = row["terms"].values.to_pylist()
        ends = np.cumsum(get("counts")) if self.terms else np.zeros(0, dtype=np.int64)
        self.ends = ends.tolist()
        self.slots, self.tfs = get("slots"), get("tfs").astype(np.float64)
        flat = get("vectors")
        n = len(self.ids)
        self.vectors = flat.reshape(n, len(flat) // n) if len(flat) else None


class Queries:
    """The queries of a task as arrays, and the threshold that each has reached."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        self.ids = table.column("query_id").combine_chunks()
        n = table.num_rows
        value = lambda name, other: (
            table.column(name).to_numpy() if name in table.column_names else np.full(n, other))
        self.nq = value("nq", 1).astype(np.float64)
        self.lex_top, self.sem_top = value("lex_top", 1.0), value("sem_top", 1.0)
        self.avg_len = max(float(table.column("avg_len")[0].as_py()), 1e-9) if n and "avg_len" in table.column_names else 1.0
        asks: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        if "terms" in table.column_names:
            for q, (terms, weights) in enumerate(zip(
                    table.column("terms").to_pylist(), table.column("weights").to_pylist(), strict=True)):
                for term, weight in zip(terms or [], weights or [], strict=True):
                    asks[term][0].append(q)
                    asks[term][1].append(weight)
        self.asks = {t: (np.array(q), np.array(w)) for t, (q, w) in asks.items()}
        self.vectors = unit_rows(table.column("vector")) if "vector" in table.column_names and n else None
        self.reached = np.full(n, -np.inf)

    def __len__(self) -> int:
        return len(self.ids)

    def matched(self, block: Block) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For every asked term of the block: its queries, their weights, its slots and impacts."""
        norm = K1 * (1 - B + B * block.dl / self.avg_len)
        out, lo = [], 0
        for term, hi in zip(block.terms, block.ends, strict=True):
            if term in self.asks:
                slots, tf = block.slots[lo:hi], block.tfs[lo:hi]
                out.append((*self.asks[term], slots, tf * (K1 + 1) / (tf + norm[slots])))
            lo = hi
        return out

    def bounds(self, block: Block, matched: list, mode: str, weight: float) -> np.ndarray:
        """The most that a query can score in the block."""
        if not matched:
            return np.full(len(self), -np.inf)
        most, common = np.zeros(len(self)), np.zeros(len(self))
        for qs, w, _, impacts in matched:
            most[qs] += w * impacts.max()
            common[qs] += 1
        near = np.minimum(1.0, common / np.sqrt(self.nq * max(1.0, block.nd[block.nd > 0].min())))
        bound = {"semantic": near, "mixed": (1 - weight) * most / self.lex_top + weight * near / self.sem_top}.get(mode, most)
        return np.where(common > 0, bound, -np.inf)

    def products(self, block: Block, matched: list, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lexical score and number of common terms of every active query with every chunk."""
        at = np.cumsum(active) - 1
        lexical = np.zeros((int(active.sum()), len(block.ids)))
        common = np.zeros(lexical.shape, dtype=np.int32)
        for qs, w, slots, impacts in matched:
            own = active[qs]
            if own.any():
                cells = np.ix_(at[qs[own]], slots)
                lexical[cells] += np.outer(w[own], impacts)
                common[cells] += 1
        return lexical, common


def _rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    for i in range(batch.num_rows):
        yield Block({name: batch.column(name)[i] for name in batch.schema.names})


def _top_of_block(q: Queries, block: Block, mode: str, k: int, weight: float, digits: int) -> pa.RecordBatch | None:
    vectors = mode in ("vector", "vector_plus_lexical")
    matched = [] if mode == "vector" else q.matched(block)
    active = np.ones(len(q), dtype=bool)
    if not vectors:
        # scores are rounded before they are ranked
        active = q.bounds(block, matched, mode, weight) >= np.maximum(q.reached - 10.0 ** -digits, 0)
        if not active.any():
            return None
    shape = int(active.sum()), len(block.ids)
    lexical, common = (np.zeros(shape), np.zeros(shape, dtype=np.int32)) if mode == "vector" else q.products(block, matched, active)
    nq, lex_top, sem_top = (x[active, None] for x in (q.nq, q.lex_top, q.sem_top))
    whole = (common == nq) & (common > 0)
    if vectors:
        length = np.sqrt((block.vectors * block.vectors).sum(axis=1))
        length[length == 0] = np.nan
        cosine = half_up(q.vectors @ (block.vectors / length[:, None]).T, digits)
        value = cosine if mode == "vector" else 0.5 * np.where(whole, lexical, 0.0) + 0.5 * cosine
        ranked = np.where(np.isfinite(value), half_up(value, digits), -np.inf)
    else:
        if mode in ("semantic", "mixed"):
            near = common / np.sqrt(np.maximum(nq * block.nd[None, :], 1.0))
            value = near if mode == "semantic" else (1 - weight) * lexical / lex_top + weight * near / sem_top
        else:
            value = np.where(whole, lexical, 0.0) if mode == "all_terms" else lexical
        ranked = np.where((common > 0) & (value > 0), half_up(value, digits), -np.inf)
    rows, cols = best_columns(ranked, k)
    if not len(rows):
        return None
    numbers = np.flatnonzero(active)
    # the k-th best of the block bounds what later blocks of this task must reach
    counts = np.bincount(rows, minlength=len(numbers))
    full = counts >= k
    last = np.cumsum(counts) - 1
    q.reached[numbers[full]] = np.maximum(q.reached[numbers[full]], ranked[rows, cols][last[full]])
    return pa.RecordBatch.from_arrays(
        [q.ids.take(pa.array(numbers[rows])), block.ids.take(pa.array(cols)), pa.array(value[rows, cols]),
         pa.array(common[rows, cols].astype(np.int64))], names=["query_id", "chunk_id", "value", "overlap"])


def _pairs_of_block(q: Queries, block: Block) -> pa.RecordBatch | None:
    lexical, common = q.products(block, q.matched(block), np.ones(len(q), dtype=bool))
    rows, cols = np.nonzero(common)
    if not len(rows):
        return None
    found, nq = common[rows, cols].astype(np.int64), q.nq[rows]
    return pa.RecordBatch.from_arrays(
        [q.ids.take(pa.array(rows)), block.ids.take(pa.array(cols)), pa.array(nq.astype(np.int64)), pa.array(found),
         pa.array(lexical[rows, cols]), pa.array(found / np.sqrt(nq * block.nd[cols]))],
        names=["query_id", "chunk_id", "nq", "overlap", "lexical", "semantic"])


def _sums_of_block(q: Queries, block: Block) -> pa.RecordBatch | None:
    lexical, common = q.products(block, q.matched(block), np.ones(len(q), dtype=bool))
    there = common > 0
    n = there.sum(axis=1)
    at = np.flatnonzero(n)
    if not len(at):
        return None
    near = common / np.sqrt(np.maximum(q.nq[:, None] * block.nd[None, :], 1.0))
    return pa.RecordBatch.from_arrays(
        [q.ids.take(pa.array(at)), pa.array(n[at].astype(np.int64)), pa.array(lexical.sum(axis=1)[at]),
         pa.array(lexical.max(axis=1)[at]), pa.array(np.where(there, lexical, np.inf).min(axis=1)[at]),
         pa.array(near.max(axis=1)[at])],
        names=["query_id", "n", "total", "best", "least", "near"])


def meet(blocks: DataFrame, queries: DataFrame, work: Callable[[Queries, Block], pa.RecordBatch | None],
         schema: str, query_rows: int = QUERY_BLOCK) -> DataFrame:
    """``work`` on every block with all queries.

    Up to ``query_rows`` queries travel to the tasks and blocks do not move; more are cut into blocks of queries, and
    each pair of query block and block group is one bounded task.
    """

    def scan(q: Queries, found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in found:
            out = work(q, block) if len(q) else None
            if out is not None:
                yield out

    if fits(queries, query_rows):
        packed = queries.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = Queries(packed.value)
            for batch in batches:
                yield from scan(q, _rows_of(batch))

        return blocks.mapInArrow(run, schema)
    # full blocks hold BLOCK_ROWS chunks; the number of groups only sets how many tasks there are
    parts = math.ceil(queries.count() / query_rows)
    groups = max(1, math.ceil(blocks.count() / MEET_BLOCKS))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = blocks.withColumn("cb", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def both(qs: pa.Table, found: pa.Table) -> pa.Table:
        drop = [c for c in ("qb", "cb") if c in qs.column_names]
        out = list(scan(Queries(qs.drop_columns(drop)), _rows_of(found.drop_columns(drop))))
        return pa.Table.from_batches(out) if out else empty

    probe = blocks.sparkSession.createDataFrame([], schema).toArrow()
    empty = probe.schema.empty_table()
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(both, schema)


class Retrieval:
    """Queries ``(query_id, text)`` over chunks ``(chunk_id, text)`` by one block index.

    ``embed`` adds vectors to the index and is applied to the queries too (PY5).  ``vocabulary_rows`` bounds the query
    terms that travel to the scan; with more of them every term is indexed.
    """

    def __init__(self, chunks: DataFrame, queries: DataFrame, embed: Embed | None = None,
                 query_rows: int = QUERY_BLOCK, vocabulary_rows: int = 200_000, block_rows: int = BLOCK_ROWS) -> None:
        self.query_rows = query_rows
        self.kinds = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
        self.terms = through_table(self._query_terms(queries), "query-terms")
        words = None
        if fits(self.terms, vocabulary_rows):
            words = set(self.terms.select("term").distinct().toArrow().column("term").to_pylist())
        self.blocks = through_table(chunk_blocks(chunks, words, embed, block_rows), "chunk-blocks")
        self.vectors = through_table(embedded(queries, "query_id", embed), "query-vectors") if embed else None
        self._packed: DataFrame | None = None

    @staticmethod
    def _query_terms(queries: DataFrame) -> DataFrame:
        """``query_id, nq, term, qtf``: distinct terms with their repeats and the distinct-term count."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counted = [Counter(tokens_of(t)) for t in batch.column("text").to_pylist()]
                at = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(pa.array(at)), pa.array([len(c) for c in counted for _ in c], pa.int64()),
                     pa.array([t for c in counted for t in c], pa.string()),
                     pa.array([n for c in counted for n in c.values()], pa.int64())],
                    names=["query_id", "nq", "term", "qtf"])

        kind = dict(queries.dtypes)["query_id"]
        return queries.select("query_id", "text").mapInArrow(split, f"query_id {kind}, nq long, term string, qtf long")

    def corpus_size(self) -> DataFrame:
        """One row ``n_docs, avg_len``; chunks without text do not count for the average."""
        lengths = F.aggregate(F.filter("dl", lambda d: d >= 0), F.lit(0).cast("long"), lambda a, d: a + d)
        texts = F.size(F.filter("dl", lambda d: d >= 0))
        return self.blocks.select(F.size("ids").alias("n"), texts.alias("t"), lengths.alias("l")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"),
            F.coalesce(F.sum("l") / F.nullif(F.sum("t"), F.lit(0)), F.lit(0.0)).alias("avg_len"))

    def term_counts(self) -> DataFrame:
        """``term, chunks, occurrences`` of the terms that some query asks for."""
        zipped = F.explode(F.arrays_zip("terms", "counts", "totals")).alias("x")
        found = self.blocks.select(zipped).groupBy("x.terms").agg(
            F.sum("x.counts").alias("chunks"), F.sum("x.totals").alias("occurrences"))
        wanted = self.terms.select(F.col("term").alias("terms")).distinct()
        return found.join(wanted, "terms", "left_semi").withColumnRenamed("terms", "term")

    def packed(self) -> DataFrame:
        """One row per query with a term of the corpus: ``query_id, nq, terms, weights, avg_len``."""
        if self._packed is None:
            size = self.corpus_size()
            n_docs, avg_len = size.select("n_docs").scalar(), size.select("avg_len").scalar()
            df = self.term_counts().select("term", F.col("chunks").alias("df"))
            idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
            weighted = self.terms.join(df, "term").withColumn("n_docs", n_docs).withColumn("w", F.col("qtf") * idf)
            # a query has one entry per distinct term, so the lists are bounded by its own length
            rows = weighted.groupBy("query_id", "nq").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("x"))
            self._packed = through_table(rows.select(
                "query_id", "nq", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"), avg_len.alias("avg_len")),
                "query-weights")
        return self._packed

    def _meet(self, queries: DataFrame, work, columns: str) -> DataFrame:
        kinds = f"query_id {self.kinds[0]}" + (f", chunk_id {self.kinds[1]}" if "chunk_id" in columns else "")
        return meet(self.blocks, queries, work, columns.replace("chunk_id", kinds) if "chunk_id" in columns
                    else f"{kinds}, {columns}", self.query_rows)

    def pairs(self) -> DataFrame:
        """``query_id, chunk_id, nq, overlap, lexical, semantic`` of all pairs with a common term."""
        return self._meet(self.packed(), _pairs_of_block, "chunk_id, nq long, overlap long, lexical double, semantic double")

    def sums(self) -> DataFrame:
        """Per query over its pairs: ``n``, ``total``, ``best`` and ``least`` lexical score, ``near`` (best semantic score)."""
        parts = self._meet(self.packed(), _sums_of_block, "n long, total double, best double, least double, near double")
        return parts.groupBy("query_id").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"),
            F.min("least").alias("least"), F.max("near").alias("near"))

    def top(self, mode: str = "lexical", k: int = 5, weight: float = 0.5, digits: int = 6) -> DataFrame:
        """``query_id, chunk_id, score, overlap, rank``: the best ``k`` chunks per query by rounded score, then id.

        ``mixed`` divides both scores by their maximum for the query; ``all_terms`` asks for every term; ``vector`` is the
        cosine, ``vector_plus_lexical`` half of it plus half the all-terms score (R8).
        """
        if mode not in MODES or not 0.0 <= weight <= 1.0:
            raise ValueError(f"mode must be one of {MODES}, weight in [0, 1]")
        queries = self.packed()
        if mode == "mixed":
            tops = self.sums().select("query_id", *[
                F.when(F.col(c) == 0, 1.0).otherwise(F.col(c)).alias(n) for c, n in (("best", "lex_top"), ("near", "sem_top"))])
            queries = through_table(queries.join(tops, "query_id"), "query-scales")
        if mode in ("vector", "vector_plus_lexical"):
            if self.vectors is None:
                raise ValueError("the index holds no vectors: give it an embed function")
            # a query without terms of the corpus still has a vector
            queries = through_table(self.vectors.join(queries, "query_id", "left").fillna({"nq": 0, "avg_len": 1.0}), "query-scales")
        found = self._meet(queries, lambda q, b: _top_of_block(q, b, mode, k, weight, digits),
                           "chunk_id, value double, overlap long")
        scored = found.withColumn("score", F.round("value", digits)).drop("value")
        return top_rows(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], max(k, 0))


def vector_blocks(chunks: DataFrame, rows: int = 4 * BLOCK_ROWS) -> DataFrame:
    """Blocks that hold nothing but ids and given vectors ``(chunk_id, vector)``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                part = part.take(pc.sort_indices(part.column("chunk_id")))
                vectors = unit_rows(part.column("vector"))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays([0, part.num_rows], part.column("chunk_id")),
                     pa.array([np.nan_to_num(vectors).ravel()], pa.list_(pa.float64()))], names=["ids", "vectors"])

    kind = dict(chunks.dtypes)["chunk_id"]
    none = F.array().cast("array<int>")
    held = chunks.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
        build, f"ids array<{kind}>, vectors array<double>")
    return held.select("ids", none.alias("dl"), none.alias("nd"), F.array().cast("array<string>").alias("terms"),
                       *[none.alias(c) for c in ("counts", "totals", "slots", "tfs")], "vectors")


def vector_top_k(chunks: DataFrame, queries: DataFrame, k: int = 5, digits: int = 6,
                 query_rows: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top-k of ``queries(query_id, vector)`` over
    ``chunks(chunk_id, vector)``.

    Batches of chunks are multiplied as matrices with the queries and each batch keeps only its own top-k, so
    pairs are never materialised.
    """
    id_type = dict(chunks.dtypes)["chunk_id"]
    q_type = dict(queries.dtypes)["query_id"]
    queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    part = meet(
        vector_blocks(chunks), queries, lambda q, b: _top_of_block(q, b, "vector", k, 0.5, digits),
        f"query_id {q_type}, chunk_id {id_type}, value double, overlap long", query_rows)
    scored = part.select("query_id", "chunk_id", F.round("value", digits).alias("score"))
    return top_rows(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
