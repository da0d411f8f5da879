"""Reference resolution as record linkage."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom import vocab
from evidloom.functions import linkage as L
from evidloom.functions import text as T
from evidloom.operators.skew import attach_groups, top_rows
from evidloom.session import through_table

REF = "reference_entry_id"


def first_wins(candidates: DataFrame) -> DataFrame:
    """Per reference one candidate per DOI (or lower title when there is none), in provider
    order then result order."""
    keyed = candidates.withColumn(
        "dedupe_key", F.coalesce(F.when(F.col("doi") != "", F.col("doi")), F.lower("title"))
    )
    order = [F.asc("provider_rank"), F.asc("result_rank"), F.asc("provider_record_id")]
    return top_rows(keyed, [REF, "dedupe_key"], order, 1, "__first").drop("__first")


def provider_agreement(candidates: DataFrame) -> DataFrame:
    """Share of the reference's candidates with the same DOI or the same lower title.

    |same doi or same title| = |same doi| + |same title| - |both|.  Every candidate asks for its
    group sizes with signed lookup keys: one grouped count, one join, one sum - no candidate is
    compared with another one, and the keys of a large reference spread over the cluster.
    """
    row_id = [REF, "provider", "provider_record_id"]
    doi, title = F.when(F.col("doi") != "", F.col("doi")), F.lower("title")
    ask = lambda kind, sign, doi_part, title_part: F.struct(
        F.lit(kind).alias("kind"), F.lit(sign).alias("sign"),
        F.coalesce(doi_part, F.lit("")).alias("k1"), F.coalesce(title_part, F.lit("")).alias("k2"))
    none = F.lit("")
    wanted = F.array_compact(F.array(
        ask("all", 0, none, none), ask("title", 1, none, title),
        F.when(doi.isNotNull(), ask("doi", 1, doi, none)),
        F.when(doi.isNotNull(), ask("both", -1, doi, title))))
    keys = candidates.select(*row_id, F.explode_outer(wanted).alias("q")).select(*row_id, "q.*")
    sizes = keys.groupBy(REF, "kind", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    agreed = keys.join(sizes, [REF, "kind", "k1", "k2"]).groupBy(*row_id).agg(
        (F.sum(F.col("sign") * F.col("n")) / F.max(F.when(F.col("kind") == "all", F.col("n"))))
        .alias("provider_agreement"))
    return candidates.join(agreed, row_id)


def resolution_features(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per (reference, candidate) with seven features and the conflicts."""
    refs = references.select(
        REF, *[F.col(c).alias(f"ref_{c}") for c in ("title", "authors", "year", "venue", "doi", "arxiv")]
    )
    pairs = refs.join(provider_agreement(candidates), REF)
    args = [F.col("ref_doi"), F.col("doi"), F.col("ref_arxiv"), F.col("arxiv")]
    return pairs.select(
        REF, "provider", "provider_rank", "result_rank", "provider_record_id", "title", "doi",
        L.identifier_score(*args).alias("identifier_score"),
        L.sequence_ratio(F.col("ref_title"), F.col("title")).alias("title_score"),
        L.author_overlap(F.col("ref_authors"), F.col("authors")).alias("author_score"),
        L.year_proximity(F.col("ref_year"), F.col("year")).alias("year_score"),
        L.venue_score(F.col("ref_venue"), F.col("venue")).alias("venue_score"),
        F.lit(1.0).alias("version_score"),
        F.col("provider_agreement").alias("provider_agreement_score"),
        L.identifier_conflicts(*args).alias("hard_conflicts"),
    )


def identity_score(features: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum clamped to [0, 1]; any hard conflict scores 0."""
    w = weights or vocab.RESOLUTION_WEIGHTS
    parts = {
        "identifier": "identifier_score", "title": "title_score", "authors": "author_score",
        "year": "year_score", "venue": "venue_score", "version": "version_score",
        "provider_agreement": "provider_agreement_score",
    }
    total = F.lit(0.0)
    for name, column in parts.items():
        total = total + F.col(column) * F.lit(w[name])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return features.withColumn(
        "score", F.when(F.size("hard_conflicts") > 0, F.lit(0.0)).otherwise(score)
    )


def best_and_margin(scored: DataFrame) -> DataFrame:
    """Best candidate per reference and its lead over the second (its own score when alone).

    Only the two best rows per reference leave a partition.  Equal scores keep provider order.
    """
    order = [F.desc("score"), F.asc("provider_rank"), F.asc("result_rank")]
    two = top_rows(scored, [REF], order, 2, "place")
    second = F.max(F.when(F.col("place") == 2, F.col("score")))
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    return two.groupBy(REF).agg(
        first("score").alias("top_score"),
        (first("score") - F.coalesce(second, F.lit(0.0))).alias("margin"),
        F.count(F.lit(1)).alias("n_top"),
        first("provider").alias("provider"),
        first("provider_record_id").alias("provider_record_id"),
    )


def decide(references: DataFrame, scored: DataFrame, accept: float = vocab.RESOLVE_ACCEPT,
           margin: float = vocab.RESOLVE_MARGIN, floor: float = vocab.RESOLVE_FLOOR) -> DataFrame:
    """Decision per reference; references without candidates are unresolved."""
    best = best_and_margin(scored)
    rows = references.select(REF).join(best, REF, "left")
    top, lead = F.col("top_score"), F.col("margin")
    accepted = (top >= accept) & (lead >= margin)
    status = (
        F.when(top.isNull(), "unresolved").when(accepted, "resolved")
        .when(top >= floor, "ambiguous").otherwise("unresolved")
    )
    reason = (
        F.when(top.isNull(), "no_candidates").when(accepted, F.lit(None).cast("string"))
        .when((top >= floor) & (F.col("n_top") > 1) & (lead < margin), "ambiguous_candidates")
        .when(top >= floor, "needs_review").otherwise("low_score")
    )
    return rows.select(
        REF, status.alias("status"),
        F.when(accepted, F.concat_ws(":", "provider", "provider_record_id")).alias("selected_candidate_id"),
        top.alias("absolute_score"), lead.alias("score_margin"), reason.alias("reason_code"),
        (status == "ambiguous").alias("requires_human_review"),
    )


def selected_versions(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The chosen candidate row with its work-version id (md5 of the record id as UUID)."""
    keyed = candidates.withColumn(
        "selected_candidate_id", F.concat_ws(":", "provider", "provider_record_id")
    ).select(REF, "selected_candidate_id", "provider_record_id", "doi", "title")
    return decisions.where("status = 'resolved'").join(
        keyed, [REF, "selected_candidate_id"]
    ).withColumn("work_version_id", T.md5_uuid(F.col("provider_record_id")))


# The identifiers that each provider looks up, the first present one only.
LOOKUPS = {
    "crossref": ("doi",),
    "openalex": ("openalex", "doi", "arxiv"),
    "semanticscholar": ("semanticscholar", "doi", "arxiv"),
    "other": ("doi", "arxiv"),
}
# Characters of the titles that meet in one task.
REF_CHARS, WORK_CHARS = 1 << 17, 1 << 21
HINTED = ("crossref",)  # providers whose title search takes the first author


def _identifier(column: str) -> Column:
    return T.doi(F.col(column)) if column == "doi" else F.lower(column)


def exact_candidates(references: DataFrame, works: DataFrame) -> DataFrame:
    """J2, exact part: the work that a provider returns for the reference's identifier.

    A provider looks up one identifier: its own record id when the reference has one, else the DOI, else the
    arXiv id where it knows those (a provider without an entry in ``LOOKUPS``: DOI, else arXiv).  An identifier it does not find gives nothing here.  Several works with the same
    identifier count as one record, the least id.  Columns ``openalex`` and ``semanticscholar`` of the
    references are optional.
    """
    have = set(references.columns)
    asks = []
    for rule, kinds in LOOKUPS.items():
        asks.append(F.coalesce(*[F.when(F.nullif(_identifier(k), F.lit("")).isNotNull(), F.struct(
            F.lit(rule).alias("rule"), F.lit("native" if k == rule else k).alias("match"),
            _identifier(k).alias("value"))) for k in kinds if k in have]))
    wanted = references.select(REF, F.explode(F.array_compact(F.array(*asks))).alias("ask")).select(REF, "ask.*")
    held = F.array(*[
        F.struct(F.lit(kind).alias("match"), value.alias("value")) for kind, value in (
            ("native", F.lower("provider_record_id")), ("doi", _identifier("doi")), ("arxiv", _identifier("arxiv")))])
    keyed = works.select("*", F.explode(held).alias("own")).where("own.value IS NOT NULL AND own.value <> ''")
    rule = F.when(F.col("provider").isin(*LOOKUPS), F.col("provider")).otherwise("other")
    keyed = keyed.select("*", rule.alias("rule"), "own.*").drop("own")
    single = top_rows(keyed, ["provider", "match", "value"], [F.asc("provider_record_id")], 1, "__first").drop("__first")
    return wanted.join(single, ["rule", "match", "value"]).drop("rule", "value")


def _trigram_sets(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of all titles as whole numbers, 21 bits for each code point, and the number of their title;
    in order of the titles."""
    padded = [f"  {t} " for t in titles]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    grams = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    ends = np.cumsum([len(t) for t in padded])
    own = np.searchsorted(ends, np.arange(len(grams)), side="right")
    inside = np.arange(len(grams)) + 2 < ends[own]  # the others run into the next title
    kinds, codes = np.unique(grams[inside], return_inverse=True)
    pairs = np.unique(own[inside] * len(kinds) + codes)
    return kinds[pairs % len(kinds)], pairs // len(kinds)


def _first_author(authors: Column) -> Column:
    """Lower-cased last word of the first name, the hint of a title search."""
    return F.lower(F.element_at(F.split(F.trim(F.get(authors, 0)), r"\s+"), -1))


def _least_of_best(values: np.ndarray, k: int) -> float:
    """The ``k``-th largest value; what the first few hold bounds what must be looked at."""
    some = values[:64 * k]
    values = values[values >= np.partition(some, len(some) - k)[len(some) - k]]
    return np.partition(values, len(values) - k)[len(values) - k]


def _meet_titles(refs: pa.Table, works: pa.Table, k: int, threshold: float) -> pa.Table | None:
    """Per title ``rid`` and provider the ``k`` most similar titles ``wid`` and all equals of the last one, with the
    number of ``common`` trigrams and of those of ``both`` sets."""
    works = works.sort_by([("provider", "ascending"), ("wid", "ascending")])
    provider = pc.run_end_encode(works.column("provider").combine_chunks())
    cuts = [0, *provider.run_ends.to_pylist()]
    grams, own = _trigram_sets(works.column("t").to_pylist())
    size = np.bincount(own, minlength=works.num_rows)
    order = np.argsort(grams, kind="stable")
    kinds, first = np.unique(grams[order], return_index=True)
    slots, first = own[order].astype(np.int32), np.append(first, len(order)).tolist()
    asked, row = _trigram_sets(refs.column("t").to_pylist())
    asks = np.bincount(row, minlength=refs.num_rows)
    at = np.searchsorted(kinds, asked)
    known = (at < len(kinds)) & (kinds[np.minimum(at, len(kinds) - 1)] == asked)
    at, ends = at[known].tolist(), np.cumsum(np.bincount(row[known], minlength=refs.num_rows)).tolist()
    found, lo = [], 0
    for r, hi in enumerate(ends):
        if lo == hi:
            continue
        common = np.bincount(np.concatenate([slots[first[g]:first[g + 1]] for g in at[lo:hi]]), minlength=len(size))
        similar = common / (size + asks[r] - common)
        for left, right in itertools.pairwise(cuts):
            part = similar[left:right]
            least = max(_least_of_best(part, k) if len(part) > k else 0.0, threshold)
            # similarities are rounded later: anything that may round to the last one comes out
            near = np.flatnonzero((part >= least - 1e-6) & (part > 0)) + left
            found.append((np.full(len(near), r), near, common[near], size[near] + asks[r]))
        lo = hi
    if not found:
        return None
    r, w, common, both = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"rid": refs.column("rid").take(pa.array(r)), "provider": works.column("provider").take(pa.array(w)),
                     "wid": works.column("wid").take(pa.array(w)), "common": common, "both": both})


def similar_titles(refs: DataFrame, works: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """``rid, provider, wid, similarity``: per title of ``refs(rid, t)`` and provider at least the ``k`` best titles of
    ``works(wid, provider, t)`` by trigram Jaccard, equals of the last one included, as far as any trigram is shared.

    Every title meets every other one, in blocks inside tasks: the titles travel, their trigrams and the pairs do
    not, and a task gives out only what is best there.
    """
    chars = lambda rows: rows.agg(F.coalesce(F.sum(F.char_length("t")), F.lit(0))).first()[0]
    across, down = (math.ceil((chars(rows) + 1) / size) for rows, size in ((refs, REF_CHARS), (works, WORK_CHARS)))
    cell = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = refs.select("rid", "t", cell("rid", across).alias("i"), every(down).alias("j"))
    right = works.select("wid", "provider", "t", cell("wid", down).alias("j"), every(across).alias("i"))
    empty = pa.table({"rid": pa.array([], pa.int64()), "provider": pa.array([], pa.string()), "wid": pa.array([], pa.int64()),
                      "common": pa.array([], pa.int64()), "both": pa.array([], pa.int64())})

    def meet(qs: pa.Table, held: pa.Table) -> pa.Table:
        out = _meet_titles(qs, held, k, threshold) if qs.num_rows and held.num_rows else None
        return empty if out is None else out

    tiles = across * down
    found = left.repartition(tiles, "i", "j").groupBy("i", "j").cogroup(
        right.repartition(tiles, "i", "j").groupBy("i", "j")).applyInArrow(
        meet, "rid long, provider string, wid long, common long, both long")
    return found.select("rid", "provider", "wid", F.round(
        F.col("common") / (F.col("both") - F.col("common")), 6).alias("similarity")).where(F.col("similarity") >= threshold)


def title_candidates(references: DataFrame, works: DataFrame, threshold: float = 0.0, k: int = 5) -> DataFrame:
    """J2, title part: the ``k`` best works per reference and provider by trigram Jaccard of the normalised
    title, down to any shared trigram (or to ``threshold``).

    Equal titles are collapsed on both sides first, so a block of copies takes part once; a title keeps its ``k``
    first works per provider because no later one can rank.  Equal similarities go to the works of the first author
    where a provider takes that hint, then to the smaller record id.
    """
    names = "authors" if "authors" in references.columns else None
    rt = through_table(references.select(
        REF, T.title_key(F.col("title")).alias("t"),
        (_first_author(F.col(names)) if names else F.lit(None).cast("string")).alias("hint")).where("t <> ''"), "ref-titles")
    wt = through_table(works.withColumn("t", T.title_key(F.col("title"))).where("t <> ''"), "work-titles")
    copies = top_rows(wt, ["t", "provider"], [F.asc("provider_record_id")], k, "__copy").drop("__copy")
    titles = rt.select("t").union(wt.select("t")).distinct()
    titles = through_table(titles.withColumn("tid", F.monotonically_increasing_id()), "titles")

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        """Rows with the number of their title ``t`` in its place."""
        return rows.join(titles.withColumnRenamed("tid", name), "t").drop("t")

    def named(rows: DataFrame, name: str, *more: str) -> DataFrame:
        """The distinct titles of rows, with their number."""
        return rows.select("t", *more).distinct().join(titles.withColumnRenamed("tid", name), "t")

    asked, held = (through_table(x, "numbered-titles") for x in (named(rt, "rid"), named(wt, "wid", "provider")))
    similar = through_table(similar_titles(asked, held, k, threshold), "title-pairs")
    rt, copies = numbered(rt, "rid"), numbered(copies, "wid")
    size = copies.groupBy("wid", "provider").agg(F.count(F.lit(1)).alias("copies"))
    first = top_rows(similar.join(size, ["wid", "provider"]), ["rid", "provider"],
                     [F.desc("similarity"), F.asc("wid")], k, "place")
    upto = F.sum("copies").over(Window.partitionBy("rid", "provider").orderBy("place"))
    full = F.when(F.col("upto") >= k, F.col("place"))
    kth = first.withColumn("upto", upto).groupBy("rid", "provider").agg(F.min_by("similarity", full).alias("kth"))
    near = similar.join(kth, ["rid", "provider"], "left").where(
        F.coalesce(F.col("similarity") >= F.col("kth"), F.lit(True))).drop("kth")
    ranked = rt.join(near, "rid").join(copies, ["wid", "provider"])
    if names and "authors" in works.columns:
        own = wt.where(F.col("provider").isin(*HINTED)).withColumn("hint", _first_author(F.col("authors")))
        own = top_rows(own.where("hint IS NOT NULL"), ["t", "provider", "hint"], [F.asc("provider_record_id")], k, "__copy")
        hinted = rt.join(near, "rid").join(numbered(own.drop("__copy"), "wid"), ["wid", "provider", "hint"])
        # a hinted work may also be one of the first copies
        ranked = ranked.withColumn("hinted", F.lit(0)).unionByName(hinted.withColumn("hinted", F.lit(1)))
        ranked = top_rows(ranked, [REF, "provider", "provider_record_id"], [F.desc("hinted")], 1, "__once").drop("__once")
    else:
        ranked = ranked.withColumn("hinted", F.lit(0))
    return top_rows(
        ranked, [REF, "provider"],
        [F.desc("similarity"), F.desc("hinted"), F.asc("provider_record_id")], k, "result_rank",
    ).drop("rid", "wid", "hint", "hinted")


def generate_candidates(references: DataFrame, works: DataFrame, threshold: float = 0.0,
                        k: int = 5) -> DataFrame:
    """Per provider the exact match wins, otherwise the title search fills in."""
    exact = exact_candidates(references, works).withColumn("result_rank", F.lit(1)).withColumn(
        "similarity", F.lit(None).cast("double"))
    found = exact.select(REF, "provider").distinct()
    by_title = title_candidates(references, works, threshold, k).join(
        found, [REF, "provider"], "left_anti"
    ).withColumn("match", F.lit("title"))
    return exact.unionByName(by_title, allowMissingColumns=True)


def acquisition_policy(user_upload: Column, is_oa: Column, host_type: Column, has_abstract: Column,
                       has_metadata: Column, days: Column) -> Column:
    """struct(allowed, access_level, reason_code, display_rule, retention_days)."""

    def row(allowed: bool, level: str, reason: str, rule: str, keep: Column) -> Column:
        return F.struct(
            F.lit(allowed).alias("allowed"), F.lit(level).alias("access_level"),
            F.lit(reason).alias("reason_code"), F.lit(rule).alias("display_rule"),
            keep.cast("int").alias("retention_days"),
        )

    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(user_upload), row(True, "user_private_full_text", "USER_PROVIDED", "Private to user", days))
        .when(yes(is_oa) & yes(host_type == "publisher"),
              row(True, "publisher_open_full_text", "PUBLISHER_OA", "Open Access (Publisher)", days))
        .when(yes(is_oa) & yes(host_type == "repository"),
              row(True, "repository_manuscript", "REPOSITORY_OA", "Open Access (Repository)", days))
        .when(yes(is_oa), row(True, "open_access_full_text", "OA_UNKNOWN_HOST", "Open Access", days))
        .when(yes(has_abstract), row(True, "abstract_only", "ABSTRACT_AVAILABLE", "Abstract only", days))
        .when(yes(has_metadata), row(True, "metadata_only", "METADATA_AVAILABLE", "Metadata only", days))
        .otherwise(row(False, "not_accessible", "PAYWALLED", "Not accessible", F.lit(0)))
    )


def acquisition_outcome(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome per (workspace, work version).

    ``requests`` carries is_oa, host_type, proposed_url, has_abstract, fetch_ok; ``existing`` the
    assets a workspace already holds (existing_level, existing_method), which always win.
    """
    rows = requests.join(existing, ["workspace_id", "work_version_id"], "left")
    policy = acquisition_policy(F.lit(False), F.col("is_oa"), F.col("host_type"),
                                F.col("has_abstract"), F.lit(True), F.lit(30))
    rows = rows.withColumn("policy", policy)
    level = F.col("policy.access_level")
    has_existing = F.col("existing_level").isNotNull()
    tried = level.isin(*vocab.OPEN_FULL_TEXT) & F.col("proposed_url").isNotNull()
    fetched = tried & F.coalesce(F.col("fetch_ok"), F.lit(False))
    after = F.when(
        tried & ~fetched, F.when(F.col("has_abstract"), F.lit("abstract_only")).otherwise("metadata_only")
    ).otherwise(level)
    by_abstract = (after == "abstract_only") & F.col("has_abstract")

    def chosen(old: Column, denied: Column, full: Column, abstract: Column, other: Column) -> Column:
        return (
            F.when(has_existing, old).when(~F.col("policy.allowed"), denied).when(fetched, full)
            .when(by_abstract, abstract).otherwise(other)
        )

    none = F.lit(None).cast("string")
    return rows.select(
        "workspace_id", "work_version_id",
        chosen(F.col("existing_level"), level, level, F.lit("abstract_only"),
               F.lit("metadata_only")).alias("access_level"),
        chosen(F.col("existing_method"), F.lit("rejected"), F.lit("unpaywall_oa"),
               F.lit("abstract_fallback"), F.lit("metadata_fallback")).alias("acquisition_method"),
        chosen(none, F.lit("Policy denied acquisition"), none, F.lit("Full text unavailable"),
               F.lit("Full text and abstract unavailable")).alias("limitation"),
    )


def resolution_summary(decisions: DataFrame, by: list[str]) -> DataFrame:
    """A1: total / resolved / ambiguous / unresolved per group."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), n("resolved"), n("ambiguous"), n("unresolved")
    )


def access_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """A2: full text (three open levels), abstract only, everything else not accessible."""
    level = F.col("access_level")
    full, abstract = level.isin(*vocab.OPEN_FULL_TEXT), level == "abstract_only"
    return rows.groupBy(*by).agg(
        F.count_if(full).alias("full_text_available"), F.count_if(abstract).alias("abstract_only"),
        F.count_if(~full & ~abstract).alias("not_accessible"),
    )


def limitation_rows(rows: DataFrame) -> DataFrame:
    """One coded row per ambiguous, unresolved, abstract-only or inaccessible reference.

    ``access_level`` is NULL unless the reference was resolved.
    """
    level = F.col("access_level")
    code = (
        F.when(F.col("status") == "ambiguous", "reference_ambiguous")
        .when(F.col("status") == "unresolved", "reference_unresolved")
        .when(level == "abstract_only", "source_abstract_only")
        .when(~level.isin(*vocab.OPEN_FULL_TEXT), "source_not_accessible")
    )
    action = (
        F.when(F.col("status") == "ambiguous", "user_resolution_required")
        .when(F.col("status") == "resolved", "upload_full_text")
    )
    return rows.withColumn("code", code).where(F.col("code").isNotNull()).select(
        REF, "code", action.alias("recoverable_action")
    )


def current_rows(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest appended row per key."""
    return top_rows(history, [key], [F.desc(c) for c in order], 1, "__at").drop("__at")
