"""Annotation agreement, adjudication and release evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom import vocab
from evidloom.functions import sets as S

CASE = "case_id"


def case_id_differences(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(case_id, side) with side matched, missing (gold only) or extra (prediction only)."""
    g = gold.select(CASE, F.lit(True).alias("in_gold"))
    p = predictions.select(CASE, F.lit(True).alias("in_pred"))
    both = g.join(p, CASE, "full")
    side = (
        F.when(F.col("in_pred").isNull(), "missing").when(F.col("in_gold").isNull(), "extra")
        .otherwise("matched")
    )
    return both.select(CASE, side.alias("side"))


def annotator_pairs(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Inner join on case id with ``a_`` and ``b_`` columns."""
    left = a.select(CASE, *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(CASE, *[F.col(c).alias(f"b_{c}") for c in columns])
    return left.join(right, CASE)


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Case ids of ``a`` that ``b`` lacks."""
    return a.select(CASE).join(b.select(CASE), CASE, "left_anti")


def label_table(pairs: DataFrame, dimensions: list[str]) -> DataFrame:
    """Contingency counts (dimension, a, b, n) of all nominal dimensions in one pass."""
    entries = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(f"a_{d}").alias("a"), F.col(f"b_{d}").alias("b"))
        for d in dimensions
    ])
    return (
        pairs.select(F.explode(entries).alias("e")).select("e.*")
        .groupBy("dimension", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    )


def cohens_kappa(pairs: DataFrame, dimensions: list[str],
                 threshold: float = vocab.AGREEMENT_THRESHOLD) -> DataFrame:
    """Kappa per dimension; 0 without cases, 1 when chance agreement is total."""
    table = label_table(pairs, dimensions)
    a = table.groupBy("dimension", F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    b = table.groupBy("dimension", F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    b = b.withColumnsRenamed({"dimension": "dimension_b", "label": "label_b"})
    # a missing label is a label like any other
    same = (F.col("dimension") == F.col("dimension_b")) & F.col("label").eqNullSafe(F.col("label_b"))
    chance = a.join(b, same).groupBy("dimension").agg(
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("products")
    )
    totals = table.groupBy("dimension").agg(
        F.sum("n").alias("cases"),
        F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("agree"),
    )
    rows = totals.join(chance, "dimension", "left").fillna(0.0, ["products"])
    wanted = pairs.sparkSession.createDataFrame([(d,) for d in dimensions], "dimension string")
    rows = wanted.join(rows, "dimension", "left")
    n = F.col("cases").cast("double")
    po, pe = F.col("agree") / n, F.col("products") / (n * n)
    kappa = (
        F.when(F.coalesce("cases", F.lit(0)) == 0, F.lit(0.0)).when(pe == 1, F.lit(1.0))
        .otherwise((po - pe) / (1 - pe))
    )
    return rows.select(
        "dimension", F.coalesce("cases", F.lit(0)).alias("cases"), kappa.alias("kappa")
    ).withColumn("below_threshold", F.col("kappa") < threshold)


def mean_jaccard(pairs: DataFrame, dimensions: list[str],
                 threshold: float = vocab.AGREEMENT_THRESHOLD) -> DataFrame:
    """Mean Jaccard of label sets per dimension, 0 without cases."""
    entries = F.array(*[
        F.struct(F.lit(d).alias("dimension"),
                 S.jaccard(F.col(f"a_{d}"), F.col(f"b_{d}")).alias("j"))
        for d in dimensions
    ])
    got = pairs.select(F.explode(entries).alias("e")).groupBy(F.col("e.dimension").alias("dimension")).agg(
        F.avg("e.j").alias("jaccard")
    )
    return got.withColumn("below_threshold", F.col("jaccard") < threshold)


def alpha_nominal(pairs: DataFrame, dimensions: list[str]) -> DataFrame:
    """Krippendorff's alpha per nominal dimension.

    Expected disagreement over unordered pairs of pooled values equals
    1 - sum nc (nc - 1) / (n (n - 1)), so only label counts are needed.  NULL below two cases, or
    when expected disagreement is 1 or 0 (undefined).
    """
    table = label_table(pairs, dimensions)
    pooled = table.select("dimension", "n", F.explode(F.array("a", "b")).alias("label")).groupBy(
        "dimension", "label").agg(F.sum("n").alias("nc"))
    same = pooled.groupBy("dimension").agg(
        F.sum(F.col("nc").cast("double") * (F.col("nc") - 1)).alias("same"), F.sum("nc").alias("pool")
    )
    seen = table.groupBy("dimension").agg(
        F.sum("n").alias("cases"),
        F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(F.col("n"))).alias("differ"),
    )
    pool = F.col("pool").cast("double")
    expected = 1 - F.col("same") / (pool * (pool - 1))
    observed = F.col("differ") / F.col("cases")
    undefined = (F.col("cases") < 2) | (expected == 1) | (expected == 0)
    return seen.join(same, "dimension").select(
        "dimension", "cases",
        F.when(~undefined, 1 - observed / F.nullif(expected, F.lit(0.0))).alias("alpha"),
    )


def alpha_interval(pairs: DataFrame, column: str) -> DataFrame:
    """Alpha with the squared-difference metric; NULL below two cases or without variance."""
    a, b = F.col(f"a_{column}").cast("double"), F.col(f"b_{column}").cast("double")
    both = pairs.select(((a - b) * (a - b)).alias("d"), F.explode(F.array(a, b)).alias("x"))
    got = both.agg(
        (F.count(F.lit(1)) / 2).cast("bigint").alias("cases"), F.avg("d").alias("observed"),
        (F.var_samp("x") * 2).alias("expected"),
    )
    usable = (F.col("cases") >= 2) & (F.col("expected") > 0)
    return got.select(
        "cases", F.when(usable, 1 - F.col("observed") / F.nullif("expected", F.lit(0.0))).alias("alpha")
    )


def disagreements(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Cases with the fields on which the annotators differ (array order matters)."""
    names = F.array_compact(F.array(*[
        F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields
    ]))
    return pairs.select(CASE, names.alias("fields")).where(F.size("fields") > 0)


def adjudicate(a: DataFrame, b: DataFrame, adjudicator: DataFrame,
               scalars: list[str], sets: list[str]) -> DataFrame:
    """Three-way merge, one row per case of A or B with a ``tie`` flag.

    Scalars: the non-null side, else A's value and a tie when they differ.  Sets: the sorted
    union, a tie when the sides differ (a missing side counts as empty).  An adjudicator row
    replaces the case and never ties; adjudicator-only cases are not in A or B and drop out.
    """
    cols = scalars + sets
    left = a.select(CASE, *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(CASE, *[F.col(c).alias(f"b_{c}") for c in cols])
    judge = adjudicator.select(CASE, F.lit(True).alias("judged"), *[F.col(c).alias(f"j_{c}") for c in cols])
    rows = left.join(right, CASE, "full").join(judge, CASE, "left")
    judged = F.coalesce("judged", F.lit(False))
    out, ties = [F.col(CASE)], []
    for c in scalars:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        out.append(F.when(judged, F.col(f"j_{c}")).otherwise(F.coalesce(x, y)).alias(c))
        ties.append(F.coalesce(x != y, F.lit(False)))
    for c in sets:
        x, y = S.as_set(F.col(f"a_{c}")), S.as_set(F.col(f"b_{c}"))
        out.append(F.when(judged, F.col(f"j_{c}")).otherwise(F.array_sort(F.array_union(x, y))).alias(c))
        ties.append(F.array_sort(x) != F.array_sort(y))
    tie = reduce(lambda p, q: p | q, ties)
    return rows.select(*out, F.lit("adjudicated").alias("annotation_status"), (tie & ~judged).alias("tie"))


def gold_summary(cases: DataFrame, dimensions: list[str]) -> DataFrame:
    """A3: counts per value of each dimension and in total, as one grouping-sets aggregate.

    A missing value is counted as ``unknown``.
    """
    filled = cases.select(*[F.coalesce(F.col(d), F.lit("unknown")).alias(d) for d in dimensions])
    sets = [[F.col(d)] for d in dimensions] + [[]]
    counted = filled.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        F.count(F.lit(1)).alias("cases"), F.grouping_id().alias("gid")
    )
    full = (1 << len(dimensions)) - 1
    which = F.lit("all")
    for i, d in enumerate(dimensions):
        which = F.when(F.col("gid") == full - (1 << (len(dimensions) - 1 - i)), d).otherwise(which)
    return counted.select(
        which.alias("dimension"), F.coalesce(*dimensions, F.lit("all")).alias("value"), "cases"
    )


def preflight(cases: DataFrame, override: bool = False) -> DataFrame:
    """A4: size and breadth gate of a gold set, with an override flag."""
    got = cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.countDistinct(F.coalesce("domain", F.lit("unknown"))).alias("domains"),
    )
    enough = (F.col("cases") >= vocab.MIN_CASES) & (F.col("domains") >= vocab.MIN_DOMAINS)
    return got.select("cases", "domains", enough.alias("large_enough"),
                      (enough | F.lit(override)).alias("passed"))


def score_release(gold: DataFrame, predictions: DataFrame, statements: DataFrame) -> DataFrame:
    """One row of release metrics over all gold cases; a missing prediction is a miss.

    ``statements(case_id, unsupported)`` are the material statements of the predictions; they
    count for matched cases only and are never unsupported when the gold source is inaccessible.
    """
    per_case = statements.groupBy(CASE).agg(
        F.count(F.lit(1)).alias("n_statements"), F.count_if("unsupported").alias("n_unsupported")
    )
    pred = predictions.select(
        CASE, F.lit(True).alias("has"), F.col("relation").alias("p_relation"),
        F.col("citation_intents").alias("p_intents"), F.col("transformations").alias("p_transformations"),
    )
    rows = gold.join(pred, CASE, "left").join(per_case, CASE, "left")
    has = F.coalesce("has", F.lit(False))
    hit = (has & (F.col("relation") == F.col("p_relation"))).cast("double")
    f1 = lambda g, p: F.when(has, S.set_f1(F.col(g), F.col(p))).otherwise(0.0)
    open_case = has & (F.col("relation") != "inaccessible_source")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n_unsupported = F.sum(F.when(open_case, F.col("n_unsupported")).otherwise(0))
    n_statements = F.sum(F.when(has, F.col("n_statements")).otherwise(0))
    scores = rows.agg(
        F.count(F.lit(1)).alias("case_count"),
        zero(F.avg(F.coalesce(hit, F.lit(0.0)))).alias("relation_accuracy"),
        zero(F.avg(f1("citation_intents", "p_intents"))).alias("citation_intent_set_f1"),
        zero(F.avg(f1("transformations", "p_transformations"))).alias("transformation_set_f1"),
        zero(n_unsupported / F.nullif(n_statements, F.lit(0))).alias("unsupported_material_statement_rate"),
        F.coalesce(F.bool_and("synthetic"), F.lit(True)).alias("synthetic_only"),
    )
    fabricated = predictions.agg(F.count_if("fabricated_quote").alias("n"))
    return scores.withColumn("fabricated_quote_count", fabricated.scalar())


def live_blocking_metrics(links: DataFrame, required: list[str], workspace: str | None = None,
                          since: Column | None = None) -> DataFrame:
    """A9 with D7 and J7: per workspace, NULLs instead of zeros for a workspace without rows.

    ``links`` carries weakest_link, abstention_code, access_level and blocking_codes of its audit.
    """
    rows = links
    if workspace is not None:
        rows = rows.where(F.col("workspace_id") == workspace)
    if since is not None:
        rows = rows.where(F.col("created_at") >= since)
    complete = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in required])
    false_claim = (
        (F.col("access_level") == "not_accessible") & F.col("abstention_code").isNull()
        & (F.col("weakest_link") > 0.85)
    )
    crossing = F.coalesce(F.array_contains("blocking_codes", "cross_tenant_access"), F.lit(False))
    grouped = rows.groupBy("workspace_id") if workspace is None else rows.groupBy()
    n = F.count(F.lit(1))
    filled = lambda c: F.when(n > 0, c)
    return grouped.agg(
        n.alias("case_count"),
        (F.count_if(complete) / F.nullif(n, F.lit(0))).alias("schema_valid_rate"),
        filled(F.count_if(crossing)).alias("cross_tenant_access_failures"),
        filled(F.count_if(false_claim)).alias("inaccessible_source_false_full_text_claims"),
    )


def evaluate_rubric(metrics: DataFrame, synthetic_only: Column | None = None,
                    rubric: list[tuple] | None = None) -> DataFrame:
    """A10: (metric, value) rows against thresholds -> pass / fail / not_measured / skipped.

    An unmeasured blocking metric fails; an unmeasured quality target is skipped when all gold
    cases are synthetic; an unknown operator fails.
    """
    spark = metrics.sparkSession
    rules = spark.createDataFrame(
        rubric or vocab.RUBRIC, "metric string, kind string, operator string, threshold double"
    )
    synthetic = synthetic_only if synthetic_only is not None else F.lit(False)
    rows = rules.join(metrics, "metric", "left")
    v, t, op = F.col("value"), F.col("threshold"), F.col("operator")
    holds = (
        F.when(op == "eq", v == t).when(op == "gte", v >= t).when(op == "lte", v <= t)
    )
    outcome = (
        F.when(~op.isin("eq", "gte", "lte"), "fail")
        .when(v.isNull() & (F.col("kind") == "blocking"), "not_measured")
        .when(v.isNull(), F.when(synthetic, "skipped").otherwise("not_measured"))
        .when(holds, "pass").otherwise("fail")
    )
    return rows.select("metric", "kind", "operator", "threshold", "value", outcome.alias("outcome"))


def release_verdict(outcomes: DataFrame) -> DataFrame:
    """Number of blocking failures and missed quality targets; passed without blocking failures."""
    bad = F.col("outcome").isin("fail", "not_measured")
    got = outcomes.agg(
        F.count_if(bad & (F.col("kind") == "blocking")).alias("blocking_failures"),
        F.count_if(bad & (F.col("kind") == "quality")).alias("quality_target_failures"),
    )
    return got.withColumn("passed", F.col("blocking_failures") == 0)


def long_metrics(row: DataFrame, names: list[str]) -> DataFrame:
    """One-row metrics as (metric, value) rows."""
    return row.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        [], names, "metric", "value"
    )


def anchor_quality(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 of anchors (doc_id, start_offset, end_offset, target)."""
    keys = ["doc_id", "start_offset", "end_offset", "target"]
    both = gold.select(*keys, F.lit(1).alias("g")).join(found.select(*keys, F.lit(1).alias("p")), keys, "full")
    got = both.agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count("p").alias("n_found"), F.count("g").alias("n_gold"),
    )
    p = F.col("tp") / F.nullif("n_found", F.lit(0))
    r = F.col("tp") / F.nullif("n_gold", F.lit(0))
    return got.select("tp", "n_found", "n_gold", p.alias("precision"), r.alias("recall"),
                      (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def ranking_metrics(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, query: str,
                    item: str) -> DataFrame:
    """Top-1, Recall@{1,3,5,10} and mean reciprocal rank over the queries that have a
    relevant item; ``ranked`` carries ``rank``."""
    hits = ranked.join(relevant.select(query, item), [query, item]).groupBy(query).agg(
        F.min("rank").alias("first")
    )
    judged = queries.select(query).join(relevant.select(query).distinct(), query, "left_semi")
    rows = judged.join(hits, query, "left")
    at = lambda k: F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)))
    return rows.agg(
        F.count(F.lit(1)).alias("queries"), at(1).alias("recall_1"), at(3).alias("recall_3"),
        at(5).alias("recall_5"), at(10).alias("recall_10"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def confusion(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts per (gold, predicted) label."""
    return pairs.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def _label_scores(counts: DataFrame) -> DataFrame:
    p = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    rows = counts.select("label", "tp", "fp", "fn", F.coalesce(p, F.lit(0.0)).alias("precision"),
                         F.coalesce(r, F.lit(0.0)).alias("recall"), f.alias("f1"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    micro = rows.agg(
        F.lit("(micro)").alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"), (tp / F.nullif(tp + fn, F.lit(0))).alias("recall"),
        (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"),
    )
    macro = rows.agg(
        F.lit("(macro)").alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
    )
    return rows.unionByName(micro).unionByName(macro)


def label_quality(table: DataFrame) -> DataFrame:
    """Precision / recall / F1 per label with micro and macro rows, from a confusion table."""
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    by_gold = table.where(F.col("gold").isNotNull()).groupBy(F.col("gold").alias("label")).agg(
        F.sum(F.coalesce(hit, F.lit(0))).alias("tp"), F.sum("n").alias("n_gold"))
    by_pred = table.where(F.col("predicted").isNotNull()).groupBy(F.col("predicted").alias("label")).agg(
        F.sum("n").alias("n_pred"))
    both = by_gold.join(by_pred, "label", "full").fillna(0, ["tp", "n_gold", "n_pred"])
    return _label_scores(both.select(
        "label", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn")))


def multilabel_quality(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """A21 for label sets: per-label counts by exploding the union of both sets."""
    g, p = S.as_set(F.col(gold)), S.as_set(F.col(predicted))
    rows = pairs.select(g.alias("g"), p.alias("p"), F.explode(F.array_union(g, p)).alias("label"))
    in_g, in_p = F.array_contains("g", F.col("label")), F.array_contains("p", F.col("label"))
    counts = rows.groupBy("label").agg(
        F.count_if(in_g & in_p).alias("tp"), F.count_if(~in_g & in_p).alias("fp"),
        F.count_if(in_g & ~in_p).alias("fn"))
    return _label_scores(counts)


def reliability_table(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of ``confidence`` with mean confidence and accuracy."""
    cell = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(cell.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration_summary(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    table = reliability_table(rows, bins)
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("n")
    error = table.agg((F.sum(gap) / F.sum("n")).alias("ece"))
    miss = F.col("confidence") - F.col("correct").cast("double")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(miss * miss).alias("brier")).withColumn(
        "ece", error.scalar())


def selective_curve(rows: DataFrame, cells: int = 256) -> DataFrame:
    """Coverage, precision and risk at every confidence threshold, ties kept together.

    Rows are counted per confidence first; running sums go over cells of about as many confidences
    each, and inside each cell, so no task sees more than one cell (or the ``cells`` totals).
    """
    points = rows.groupBy("confidence").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("bigint")).alias("hits"))
    cuts = points.agg(F.percentile_approx(
        "confidence", F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(10 * cells)).alias("cuts"))
    points = points.withColumn("cuts", cuts.scalar()).withColumn(
        "cell", F.size(F.filter("cuts", lambda c: c <= F.col("confidence")))).drop("cuts")
    inside = Window.partitionBy("cell").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("n_in", F.sum("n").over(inside)).withColumn("h_in", F.sum("hits").over(inside))
    totals = points.groupBy("cell").agg(F.sum("n").alias("cn"), F.sum("hits").alias("ch"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "cell", F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("n_above"),
        F.coalesce(F.sum("ch").over(above), F.lit(0)).alias("h_above"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("n_in") + F.col("n_above")
    precision = (F.col("h_in") + F.col("h_above")) / kept
    return points.join(totals, "cell").select(
        F.col("confidence").alias("threshold"), kept.alias("kept"),
        (kept / whole.scalar()).alias("coverage"), precision.alias("precision"), (1 - precision).alias("risk"))


def named_slices(rows: DataFrame, slices: list[list[str]], *aggs: Column) -> DataFrame:
    """Aggregates of every named slice (a list of columns) from one pass over the rows.

    Grouping sets with mergeable aggregates; ``slice`` names the columns that a row is cut by, the other ones are null.
    """
    columns = list(dict.fromkeys(c for own in slices for c in own))
    held = rows.groupingSets([[F.col(c) for c in own] for own in slices], *columns).agg(
        F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]).alias("slice"), *aggs)
    return held.select("slice", *[c for c in held.columns if c != "slice"])


def metric_slices(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and mean intent F1 with all subtotals of the slicing columns."""
    return rows.cube(*by).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("intent_f1").alias("intent_f1"))


def release_composition(flags: DataFrame) -> DataFrame:
    """Counts of the six required case kinds against their minimum."""
    names = [n for n, _ in vocab.RELEASE_MINIMUMS]
    counted = flags.agg(*[F.count_if(n).alias(n) for n in names]).unpivot([], names, "kind", "cases")
    minimum = flags.sparkSession.createDataFrame(vocab.RELEASE_MINIMUMS, "kind string, minimum bigint")
    return counted.join(F.broadcast(minimum), "kind").withColumn("passed", F.col("cases") >= F.col("minimum"))


# Rules of an annotation row: field, rule, argument.
ANNOTATION_RULES: list[tuple[str, str, object]] = [
    *[(c, "required", None) for c in vocab.ANNOTATION_COLUMNS if c != "expected_abstention_code"],
    ("case_id", "pattern", "^[a-z][a-z0-9_-]{0,63}$"),
    ("split", "enum", vocab.SPLITS),
    ("resolution_status", "enum", vocab.ANNOTATION_RESOLUTION),
    ("source_access_level", "enum", vocab.ANNOTATION_ACCESS),
    ("gold_evidence_relation", "enum", vocab.RELATIONS),
    ("annotation_status", "enum", vocab.ANNOTATION_STATUS),
    *[(c, "min_length", 1) for c in (
        "domain", "citing_asset_id", "citing_work_version_id", "citation_cluster_id",
        "reference_entry_id", "claim_text")],
    ("claim_start_offset", "minimum", 0), ("claim_end_offset", "minimum", 0),
    ("gold_citation_intents_json", "min_items", 1),
]


def _violated(field: str, rule: str, arg: object) -> Column:
    c = F.col(field)
    if rule == "required":
        return c.isNull()
    if rule == "pattern":
        return ~c.rlike(arg)
    if rule == "enum":
        return ~c.isin(*arg)
    if rule == "min_length":
        return F.char_length(c) < arg
    if rule == "minimum":
        return c < arg
    if rule == "min_items":
        return F.size(c) < arg
    raise ValueError(rule)


def annotation_errors(rows: DataFrame) -> DataFrame:
    """(case_id, path, message) for every broken rule; columns outside the layout are
    reported once per row under their own name."""
    checks = [
        F.when(F.coalesce(_violated(f, r, a), F.lit(False)),
               F.struct(F.lit(f).alias("path"), F.lit(r).alias("message")))
        for f, r, a in ANNOTATION_RULES
    ]
    extra = [c for c in rows.columns if c not in vocab.ANNOTATION_COLUMNS]
    checks += [F.struct(F.lit(c).alias("path"), F.lit("additional").alias("message")) for c in extra]
    return rows.select(CASE, F.explode(F.array_compact(F.array(*checks))).alias("e")).select(CASE, "e.*")


def validation_counts(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Valid and invalid rows of an annotation table."""
    bad = errors.select(CASE).distinct().withColumn("bad", F.lit(True))
    return rows.select(CASE).join(bad, CASE, "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count("bad").alias("invalid"),
        (F.count(F.lit(1)) - F.count("bad")).alias("valid"))


def case_errors(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """D3: (case_id, problem) rows of the referential rules between cases and predictions.

    cases: case_id, split, relation, access, span_ids, citation_intents, abstention_code;
    predictions: case_id, relation, span_ids, statement_span_ids.
    """

    def flagged(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
        found = F.array_compact(F.array(*[
            F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
        return df.select(CASE, F.explode(found).alias("problem"))

    spans = F.col("span_ids")
    closed = F.col("relation") == "inaccessible_source"
    case_rows = flagged(cases, {
        "unknown_split": ~F.col("split").isin(*vocab.SPLITS),
        "unknown_relation": ~F.col("relation").isin(*vocab.RELATIONS),
        "unknown_access": ~F.col("access").isin(*vocab.ACCESS_LEVELS),
        "unknown_intent": ~S.is_subset(F.col("citation_intents"), F.array(*[F.lit(i) for i in vocab.INTENTS])),
        "duplicate_span": F.size(F.array_distinct(spans)) < F.size(spans),
        "inaccessible_with_source": closed & ((F.col("access") != "not_accessible") | (F.size(spans) > 0)),
        "inaccessible_without_code": closed & F.col("abstention_code").isNull(),
        "not_accessible_with_relation": ~closed & (F.col("access") == "not_accessible"),
    })
    pred_rows = flagged(predictions, {"unknown_predicted_relation": ~F.col("relation").isin(*vocab.RELATIONS)})
    # no rule can break without a span, so only predictions with spans meet their cases
    spanned = predictions.where((F.size(spans) > 0) | (F.size("statement_span_ids") > 0))
    span_rows = flagged(spanned.join(cases.select(CASE, F.col("span_ids").alias("case_spans")), CASE, "left"), {
        "unknown_predicted_span": ~S.is_subset(spans, F.col("case_spans")),
        "unknown_statement_span": ~S.is_subset(F.col("statement_span_ids"), F.col("case_spans")),
    })
    # ids of both sides are counted in one aggregate: no join, and rows as narrow as an id
    side = lambda df, c, p: df.select(CASE, F.lit(c).alias("c"), F.lit(p).alias("p"))
    counted = side(cases, 1, 0).unionByName(side(predictions, 0, 1)).groupBy(CASE).agg(
        F.sum("c").alias("c"), F.sum("p").alias("p"))
    id_rows = flagged(counted, {
        "duplicate_case": F.col("c") > 1, "duplicate_prediction": F.col("p") > 1,
        # a row without an id matches nothing
        "missing_prediction": (F.col("c") > 0) & ((F.col("p") == 0) | F.col(CASE).isNull()),
        "extra_prediction": (F.col("p") > 0) & ((F.col("c") == 0) | F.col(CASE).isNull()),
    })
    return case_rows.unionByName(pred_rows).unionByName(span_rows).unionByName(id_rows)
