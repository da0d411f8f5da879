"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom import vocab
from evidloom.functions import sets as S
from evidloom.operators import evaluation as E
from evidloom.operators import governance as G
from evidloom.operators import resolution as R
from evidloom.operators.skew import top_rows
from evidloom.plans import linkage_queries as LQ
from evidloom.plans.governance_queries import CONFIDENCE
from evidloom.plans.registry import query

NOMINAL = ["gold_evidence_relation", "resolution_status"]
LABEL_SETS = ["gold_citation_intents_json", "gold_transformations_json"]


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def _pairs(v):
    cols = NOMINAL + LABEL_SETS + ["source_access_level", "usefulness"]
    return E.annotator_pairs(v("v_annotations_a"), v("v_annotations_b"), cols)


AB = """
WITH p AS (SELECT case_id, a.gold_evidence_relation AS ar, b.gold_evidence_relation AS br, a.resolution_status AS ast, b.resolution_status AS bst,
  a.gold_citation_intents_json AS ai, b.gold_citation_intents_json AS bi, a.gold_transformations_json AS atr, b.gold_transformations_json AS btr,
  a.source_access_level AS aac, b.source_access_level AS bac, a.usefulness AS au, b.usefulness AS bu
  FROM v_annotations_a a JOIN v_annotations_b b USING (case_id)),
dims AS (SELECT case_id, 'gold_evidence_relation' AS dimension, ar AS a, br AS b FROM p UNION ALL SELECT case_id, 'resolution_status', ast, bst FROM p)
"""


@query("j4_gold_predictions", """
SELECT coalesce(g.case_id, p.case_id) AS case_id,
       CASE WHEN p.case_id IS NULL THEN 'missing' WHEN g.case_id IS NULL THEN 'extra' ELSE 'matched' END AS side
FROM v_gold g FULL JOIN v_predictions p ON g.case_id = p.case_id""")
def j4(v):
    return E.case_id_differences(v("v_gold"), v("v_predictions"))


@query("j5_annotator_join", AB + """
SELECT 'both' AS side, count(*) AS n FROM p
UNION ALL SELECT 'only_in_a', count(*) FROM v_annotations_a WHERE case_id NOT IN (SELECT case_id FROM v_annotations_b)
UNION ALL SELECT 'only_in_b', count(*) FROM v_annotations_b WHERE case_id NOT IN (SELECT case_id FROM v_annotations_a)""")
def j5(v):
    a, b = v("v_annotations_a"), v("v_annotations_b")
    n = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return n(_pairs(v), "both").union(n(E.only_in(a, b), "only_in_a")).union(n(E.only_in(b, a), "only_in_b"))


@query("u2_id_intersection_difference", """
SELECT 'common' AS part, case_id FROM (SELECT case_id FROM v_gold INTERSECT SELECT case_id FROM v_predictions)
UNION ALL SELECT 'missing', case_id FROM (SELECT case_id FROM v_gold EXCEPT SELECT case_id FROM v_predictions)""")
def u2(v):
    g, p = v("v_gold").select("case_id"), v("v_predictions").select("case_id")
    return g.intersect(p).select(F.lit("common").alias("part"), "case_id").union(
        g.subtract(p).select(F.lit("missing").alias("part"), "case_id"))


@query("u3_id_union", "SELECT case_id FROM v_annotations_a UNION SELECT case_id FROM v_annotations_b")
def u3(v):
    return v("v_annotations_a").select("case_id").union(v("v_annotations_b").select("case_id")).distinct()


@query("u4_array_set_algebra", AB + """
SELECT case_id, len(list_intersect(ai, bi)) AS n_common, len(list_distinct(list_concat(ai, btr))) AS n_union,
       len(list_filter(ai, lambda x: NOT list_contains(bi, x))) AS n_only_a, len(list_filter(ai, lambda x: NOT list_contains(bi, x))) = 0 AS subset
FROM p""")
def u4(v):
    a, b, t = (F.col(c) for c in ("a_gold_citation_intents_json", "b_gold_citation_intents_json", "b_gold_transformations_json"))
    n = lambda c, name: F.size(c).cast("bigint").alias(name)
    return _pairs(v).select("case_id", n(F.array_intersect(a, b), "n_common"), n(F.array_union(a, t), "n_union"),
                            n(F.array_except(a, b), "n_only_a"), S.is_subset(a, b).alias("subset"))


_F1 = """CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1 WHEN len({0}) = 0 OR len({1}) = 0 THEN 0
  ELSE 2.0::DOUBLE * len(list_intersect({0}, {1})) / (len(list_distinct({0})) + len(list_distinct({1}))) END"""


@query("f15_set_measures", f"""
SELECT case_id, round({_F1.format('g.citation_intents', 'p.citation_intents')}, 6) AS f1,
       round(len(list_intersect(g.citation_intents, p.citation_intents))::DOUBLE / len(list_distinct(list_concat(g.citation_intents, p.citation_intents))), 6) AS jaccard
FROM v_gold g JOIN v_predictions p USING (case_id)""")
def f15(v):
    p = v("v_predictions").select("case_id", F.col("citation_intents").alias("p"))
    g, q = F.col("citation_intents"), F.col("p")
    return v("v_gold").join(p, "case_id").select(
        "case_id", F.round(S.set_f1(g, q), 6).alias("f1"), F.round(S.jaccard(g, q), 6).alias("jaccard"))


KAPPA = AB + """, ct AS (SELECT dimension, a, b, count(*) AS n FROM dims GROUP BY ALL),
k AS (SELECT dimension, sum(n)::DOUBLE AS n, sum(n) FILTER (WHERE a = b)::DOUBLE AS agree,
  (SELECT sum(x.na * y.nb)::DOUBLE FROM (SELECT a AS l, sum(n) AS na FROM ct c WHERE c.dimension = ct.dimension GROUP BY a) x
   JOIN (SELECT b AS l, sum(n) AS nb FROM ct c WHERE c.dimension = ct.dimension GROUP BY b) y USING (l)) AS products
  FROM ct GROUP BY dimension)
"""


@query("a11_cohens_kappa", KAPPA + """
SELECT dimension, n::BIGINT AS cases, round((agree / n - products / (n * n)) / (1 - products / (n * n)), 6) AS kappa,
       (agree / n - products / (n * n)) / (1 - products / (n * n)) < 0.7 AS below_threshold FROM k""")
def a11(v):
    return E.cohens_kappa(_pairs(v), NOMINAL).withColumn("kappa", F.round("kappa", 6))


@query("a12_mean_jaccard", AB + """, s AS (SELECT 'gold_citation_intents_json' AS dimension, ai AS a, bi AS b FROM p
  UNION ALL SELECT 'gold_transformations_json', atr, btr FROM p)
SELECT dimension, round(avg(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))), 6) AS jaccard,
       avg(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))) < 0.7 AS below_threshold FROM s GROUP BY dimension""")
def a12(v):
    return E.mean_jaccard(_pairs(v), LABEL_SETS).withColumn("jaccard", F.round("jaccard", 6))


@query("a13_alpha_nominal", AB + """, pool AS (SELECT dimension, l, count(*)::DOUBLE AS nc FROM (SELECT dimension, a AS l FROM dims UNION ALL SELECT dimension, b FROM dims) GROUP BY ALL),
e AS (SELECT dimension, 1 - sum(nc * (nc - 1)) / (sum(nc) * (sum(nc) - 1)) AS de FROM pool GROUP BY dimension),
o AS (SELECT dimension, count(*) AS cases, avg((a <> b)::INT::DOUBLE) AS d FROM dims GROUP BY dimension)
SELECT dimension, cases, round(1 - d / de, 6) AS alpha FROM e JOIN o USING (dimension)""")
def a13(v):
    return E.alpha_nominal(_pairs(v), NOMINAL).withColumn("alpha", F.round("alpha", 6))


@query("a14_alpha_interval", AB + """
SELECT count(*) AS cases, round(1 - avg((au - bu) * (au - bu)) / (2 * (SELECT var_samp(x) FROM (SELECT au AS x FROM p UNION ALL SELECT bu FROM p))), 6) AS alpha FROM p""")
def a14(v):
    return E.alpha_interval(_pairs(v), "usefulness").withColumn("alpha", F.round("alpha", 6))


@query("a15_disagreements", AB + """
SELECT case_id, fields FROM (SELECT case_id, array_to_string(list_filter([CASE WHEN ar <> br THEN 'gold_evidence_relation' END,
  CASE WHEN ai <> bi THEN 'gold_citation_intents_json' END, CASE WHEN atr <> btr THEN 'gold_transformations_json' END,
  CASE WHEN ast <> bst THEN 'resolution_status' END, CASE WHEN aac <> bac THEN 'source_access_level' END], lambda x: x IS NOT NULL), ',') AS fields FROM p)
WHERE fields <> ''""")
def a15(v):
    return E.disagreements(_pairs(v), vocab.DISAGREEMENT_FIELDS).withColumn("fields", F.array_join("fields", ","))


_SC = ["gold_evidence_relation", "resolution_status", "source_access_level", "claim_text", "domain", "split"]
MERGED = """
WITH m AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, j.case_id IS NOT NULL AS judged,
  {cols},
  list_sort(list_distinct(list_concat(coalesce(a.gold_citation_intents_json, []), coalesce(b.gold_citation_intents_json, [])))) AS intents,
  list_sort(list_distinct(list_concat(coalesce(a.gold_transformations_json, []), coalesce(b.gold_transformations_json, [])))) AS changes,
  j.gold_evidence_relation AS j_relation, j.gold_citation_intents_json AS j_intents, j.gold_transformations_json AS j_changes,
  ({ties}
   OR list_sort(coalesce(a.gold_citation_intents_json, [])) <> list_sort(coalesce(b.gold_citation_intents_json, []))
   OR list_sort(coalesce(a.gold_transformations_json, [])) <> list_sort(coalesce(b.gold_transformations_json, []))) AND j.case_id IS NULL AS tie
  FROM v_annotations_a a FULL JOIN v_annotations_b b ON a.case_id = b.case_id
  LEFT JOIN v_adjudicator j ON j.case_id = coalesce(a.case_id, b.case_id))
""".format(
    cols=", ".join(f"CASE WHEN j.case_id IS NOT NULL THEN j.{c} ELSE coalesce(a.{c}, b.{c}) END AS {c}" for c in _SC),
    ties=" OR ".join(f"coalesce(a.{c} <> b.{c}, false)" for c in _SC))


def _merged(v):
    return E.adjudicate(v("v_annotations_a"), v("v_annotations_b"), v("v_adjudicator"), _SC, LABEL_SETS)


@query("j6_adjudication_merge", MERGED + f"""
SELECT case_id, {', '.join(_SC)}, array_to_string(CASE WHEN judged THEN j_intents ELSE intents END, ',') AS intents,
       array_to_string(CASE WHEN judged THEN j_changes ELSE changes END, ',') AS changes, 'adjudicated' AS annotation_status, tie FROM m""")
def j6(v):
    return _merged(v).select(
        "case_id", *_SC, F.array_join("gold_citation_intents_json", ",").alias("intents"),
        F.array_join("gold_transformations_json", ",").alias("changes"), "annotation_status", "tie")


@query("o3_merge_order", MERGED + "SELECT case_id FROM m WHERE tie ORDER BY case_id")
def o3(v):
    return _merged(v).where("tie").select("case_id").orderBy("case_id")


@query("a3_gold_summary", """
SELECT 'domain' AS dimension, domain AS value, count(*) AS cases FROM v_gold GROUP BY domain
UNION ALL SELECT 'relation', relation, count(*) FROM v_gold GROUP BY relation
UNION ALL SELECT 'all', 'all', count(*) FROM v_gold""")
def a3(v):
    return E.gold_summary(v("v_gold"), ["domain", "relation"])


@query("a4_preflight_gate", """
SELECT count(*) AS cases, count(DISTINCT domain) AS domains, count(*) >= 300 AND count(DISTINCT domain) >= 8 AS large_enough,
       count(*) >= 300 AND count(DISTINCT domain) >= 8 AS passed FROM v_gold""")
def a4(v):
    return E.preflight(v("v_gold"))


SCORES = f"""
WITH st AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE unsupported) AS u FROM v_statements GROUP BY case_id),
j AS (SELECT g.case_id, g.relation AS gr, p.relation AS pr, p.case_id IS NOT NULL AS has, g.synthetic, g.domain, p.confidence,
        {_F1.format('g.citation_intents', 'p.citation_intents')} AS f1, {_F1.format('g.transformations', 'p.transformations')} AS tf1, n, u
      FROM v_gold g LEFT JOIN v_predictions p USING (case_id) LEFT JOIN st USING (case_id)),
sc AS (SELECT count(*) AS case_count, avg(CASE WHEN has AND gr = pr THEN 1 ELSE 0 END::DOUBLE) AS relation_accuracy,
  avg(CASE WHEN has THEN f1 ELSE 0 END) AS citation_intent_set_f1, avg(CASE WHEN has THEN tf1 ELSE 0 END) AS transformation_set_f1,
  sum(CASE WHEN has AND gr <> 'inaccessible_source' THEN u ELSE 0 END)::DOUBLE / sum(CASE WHEN has THEN n ELSE 0 END) AS unsupported_material_statement_rate,
  bool_and(synthetic) AS synthetic_only, (SELECT count(*) FROM v_predictions WHERE fabricated_quote) AS fabricated_quote_count FROM j)
"""


def _scores(v):
    return E.score_release(v("v_gold"), v("v_predictions"), v("v_statements"))


@query("a5_relation_accuracy", SCORES + "SELECT case_count, round(relation_accuracy, 6) AS relation_accuracy FROM sc")
def a5(v):
    return _scores(v).select("case_count", *r6("relation_accuracy"))


@query("a6_mean_set_f1", SCORES + """
SELECT round(citation_intent_set_f1, 6) AS citation_intent_set_f1, round(transformation_set_f1, 6) AS transformation_set_f1 FROM sc""")
def a6(v):
    return _scores(v).select(*r6("citation_intent_set_f1", "transformation_set_f1"))


@query("a7_unsupported_statement_rate", SCORES + """
SELECT round(unsupported_material_statement_rate, 6) AS unsupported_material_statement_rate FROM sc""")
def a7(v):
    return _scores(v).select(*r6("unsupported_material_statement_rate"))


@query("a8_fabricated_quotes", SCORES + "SELECT fabricated_quote_count, synthetic_only FROM sc")
def a8(v):
    return _scores(v).select("fabricated_quote_count", "synthetic_only")


LIVE = CONFIDENCE + """,
lv AS (SELECT workspace_id, count(*) AS case_count,
  count(*) FILTER (WHERE explanation_grounding IS NOT NULL AND evidence_relation IS NOT NULL)::DOUBLE / count(*) AS schema_valid_rate,
  count(*) FILTER (WHERE blocking_code = 'cross_tenant_access') AS cross_tenant_access_failures,
  count(*) FILTER (WHERE access_level = 'not_accessible' AND abstention_code IS NULL AND weakest_link > 0.85) AS inaccessible_source_false_full_text_claims
  FROM conf {where} GROUP BY {by})
"""
REQUIRED = ["link_id", "workspace_id", "analysis_run_id", "evidence_relation", "access_level", "explanation_grounding"]


def _live(v, **kw):
    links = G.confidence(v("v_links")).withColumn("blocking_codes", F.array_compact(F.array("blocking_code")))
    return E.live_blocking_metrics(links, REQUIRED, **kw)


@query("a9_live_blocking_metrics", LIVE.format(where="WHERE created_at >= TIMESTAMP '1997-01-01'", by="workspace_id") + """
SELECT workspace_id, case_count, round(schema_valid_rate, 6) AS schema_valid_rate, cross_tenant_access_failures, inaccessible_source_false_full_text_claims FROM lv""")
def a9(v):
    return _live(v, since=F.lit("1997-01-01").cast("timestamp_ntz")).withColumn(
        "schema_valid_rate", F.round("schema_valid_rate", 6))


_RUBRIC_VALUES = ", ".join(f"('{m}', '{k}', '{o}', {t}::DOUBLE)" for m, k, o, t in vocab.RUBRIC)
RUBRIC = f"""
, rub(metric, kind, operator, threshold) AS (VALUES {_RUBRIC_VALUES}),
met AS (SELECT 'fabricated_quote_count' AS metric, fabricated_quote_count::DOUBLE AS value FROM sc
  UNION ALL SELECT 'unsupported_material_statement_rate', unsupported_material_statement_rate FROM sc
  UNION ALL SELECT 'relation_accuracy', relation_accuracy FROM sc {{more}}),
oc AS (SELECT rub.*, value, CASE WHEN value IS NULL AND kind = 'blocking' THEN 'not_measured'
    WHEN value IS NULL THEN CASE WHEN (SELECT synthetic_only FROM sc) THEN 'skipped' ELSE 'not_measured' END
    WHEN (operator = 'eq' AND value = threshold) OR (operator = 'gte' AND value >= threshold) OR (operator = 'lte' AND value <= threshold) THEN 'pass' ELSE 'fail' END AS outcome
  FROM rub LEFT JOIN met USING (metric))
"""
_SCORE_NAMES = ["fabricated_quote_count", "unsupported_material_statement_rate", "relation_accuracy"]


@query("a10_rubric_evaluation", SCORES + RUBRIC.format(more="") + """
SELECT metric, kind, operator, threshold, round(value, 6) AS value, outcome FROM oc""")
def a10(v):
    scores = _scores(v)
    return E.evaluate_rubric(
        E.long_metrics(scores, _SCORE_NAMES), scores.select("synthetic_only").scalar()
    ).withColumn("value", F.round("value", 6))


@query("k6_release_evaluation_job", LIVE.format(where="", by="ALL").replace("SELECT workspace_id, count(*)", "SELECT count(*)")
       + SCORES.replace("\nWITH st", ", st", 1) + RUBRIC.format(more="""
  UNION ALL SELECT 'schema_valid_rate', schema_valid_rate FROM lv
  UNION ALL SELECT 'cross_tenant_access_failures', cross_tenant_access_failures::DOUBLE FROM lv
  UNION ALL SELECT 'inaccessible_source_false_full_text_claims', inaccessible_source_false_full_text_claims::DOUBLE FROM lv""") + """
SELECT metric, kind, round(value, 6) AS value, outcome FROM oc""")
def k6(v):
    scores = _scores(v)
    links = G.confidence(v("v_links")).withColumn("blocking_codes", F.array_compact(F.array("blocking_code")))
    live = E.live_blocking_metrics(links.withColumn("workspace_id", F.lit("all")), REQUIRED)
    metrics = E.long_metrics(scores, _SCORE_NAMES).union(E.long_metrics(live, [
        "schema_valid_rate", "cross_tenant_access_failures", "inaccessible_source_false_full_text_claims"]))
    return E.evaluate_rubric(metrics, scores.select("synthetic_only").scalar()).select(
        "metric", "kind", F.round("value", 6).alias("value"), "outcome")


@query("a19_anchor_quality", """
WITH g AS (SELECT doc_id, start_offset, end_offset, claim_id FROM v_claims),
f AS (SELECT c.doc_id, start_offset + CASE WHEN c.doc_id % 10 = 0 THEN 1 ELSE 0 END AS start_offset, end_offset, claim_id
      FROM v_claims c JOIN documents d ON d.doc_id = c.doc_id WHERE lang <> 'es'),
t AS (SELECT (SELECT count(*) FROM g JOIN f USING (doc_id, start_offset, end_offset, claim_id)) AS tp,
      (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM g) AS n_gold)
SELECT tp, n_found, n_gold, round(tp::DOUBLE / n_found, 6) AS precision, round(tp::DOUBLE / n_gold, 6) AS recall, round(2.0::DOUBLE * tp / (n_found + n_gold), 6) AS f1 FROM t""")
def a19(v):
    gold = v("v_claims").select("doc_id", "start_offset", "end_offset", F.col("claim_id").alias("target"))
    shift = F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)
    found = gold.withColumn("start_offset", F.col("start_offset") + shift).join(
        v("documents").where("lang <> 'es'").select("doc_id"), "doc_id", "left_semi")
    return E.anchor_quality(gold, found).select("tp", "n_found", "n_gold", *r6("precision", "recall", "f1"))


@query("a20_ranking_metrics", LQ.DECISIONS + """,
fr AS (SELECT r.reference_entry_id, min(rk.rn) AS first FROM v_references r LEFT JOIN rk ON rk.reference_entry_id = r.reference_entry_id
       AND rk.provider_record_id = concat('cr-', CAST(r.reference_entry_id AS STRING)) WHERE r.doi IS NOT NULL GROUP BY ALL)
SELECT count(*) AS queries, round(avg(coalesce((first <= 1)::INT, 0)), 6) AS recall_1, round(avg(coalesce((first <= 3)::INT, 0)), 6) AS recall_3,
       round(avg(coalesce((first <= 5)::INT, 0)), 6) AS recall_5, round(avg(coalesce((first <= 10)::INT, 0)), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM fr""")
def a20(v):
    refs = v("v_references")
    scored = R.identity_score(R.resolution_features(refs, R.first_wins(LQ._candidates(v))))
    ranked = top_rows(scored, [LQ.REF], [F.desc("score"), F.asc("provider_rank"), F.asc("result_rank")], 10)
    relevant = refs.where("doi IS NOT NULL").select(
        LQ.REF, F.concat(F.lit("cr-"), F.col(LQ.REF).cast("string")).alias("provider_record_id"))
    return E.ranking_metrics(refs, ranked, relevant, LQ.REF, "provider_record_id").select(
        "queries", *r6("recall_1", "recall_3", "recall_5", "recall_10", "mrr"))


def _gold_and_predicted(v):
    p = v("v_predictions").select(
        "case_id", F.col("relation").alias("predicted"), "confidence", F.col("citation_intents").alias("p_intents"))
    return v("v_gold").join(p, "case_id")


@query("a21_confusion_matrix", """
SELECT g.relation AS gold, p.relation AS predicted, count(*) AS n FROM v_gold g JOIN v_predictions p USING (case_id) GROUP BY ALL""")
def a21(v):
    return E.confusion(_gold_and_predicted(v), "relation", "predicted")


_LABELS = """
ls AS (SELECT label, tp, fp, fn, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r,
       coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM cnt),
al AS (SELECT * FROM ls UNION ALL SELECT '(micro)', sum(tp), sum(fp), sum(fn), sum(tp)::DOUBLE / sum(tp + fp), sum(tp)::DOUBLE / sum(tp + fn), 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) FROM ls
  UNION ALL SELECT '(macro)', sum(tp), sum(fp), sum(fn), avg(p), avg(r), avg(f) FROM ls)
SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM al"""


@query("a21_label_quality", """
WITH m AS (SELECT g.relation AS g, p.relation AS p FROM v_gold g JOIN v_predictions p USING (case_id)),
cnt AS (SELECT label, (SELECT count(*) FROM m WHERE g = label AND p = label) AS tp, (SELECT count(*) FROM m WHERE g <> label AND p = label) AS fp,
        (SELECT count(*) FROM m WHERE g = label AND p <> label) AS fn FROM (SELECT g AS label FROM m UNION SELECT p FROM m)),""" + _LABELS)
def a21b(v):
    table = E.confusion(_gold_and_predicted(v), "relation", "predicted")
    return E.label_quality(table).select("label", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


@query("a21_multilabel_quality", """
WITH m AS (SELECT case_id, g.citation_intents AS g, p.citation_intents AS p FROM v_gold g JOIN v_predictions p USING (case_id)),
e AS (SELECT g, p, unnest(list_distinct(list_concat(g, p))) AS label FROM m),
cnt AS (SELECT label, count(*) FILTER (WHERE list_contains(g, label) AND list_contains(p, label)) AS tp,
  count(*) FILTER (WHERE NOT list_contains(g, label)) AS fp, count(*) FILTER (WHERE NOT list_contains(p, label)) AS fn FROM e GROUP BY label),""" + _LABELS)
def a21c(v):
    return E.multilabel_quality(_gold_and_predicted(v), "citation_intents", "p_intents").select(
        "label", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


def _judged(v):
    return _gold_and_predicted(v).withColumn("correct", F.col("relation") == F.col("predicted"))


_JUDGED = """
WITH j AS (SELECT confidence, g.relation = p.relation AS correct, g.domain, g.relation,
  """ + _F1.format("g.citation_intents", "p.citation_intents") + """ AS f1 FROM v_gold g JOIN v_predictions p USING (case_id)),
bins AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, avg(confidence) AS mc, avg(correct::INT::DOUBLE) AS acc FROM j GROUP BY ALL)
"""


@query("a22_reliability_table", _JUDGED + """
SELECT bin, n, round(mc, 6) AS mean_confidence, round(acc, 6) AS accuracy FROM bins""")
def a22(v):
    return E.reliability_table(_judged(v)).select("bin", "n", *r6("mean_confidence", "accuracy"))


@query("a22_calibration_summary", _JUDGED + """
SELECT (SELECT count(*) FROM j) AS n, round((SELECT avg((confidence - correct::INT) * (confidence - correct::INT)) FROM j), 6) AS brier,
       round(sum(abs(acc - mc) * n) / sum(n), 6) AS ece FROM bins""")
def a22b(v):
    return E.calibration_summary(_judged(v)).select("n", *r6("brier", "ece"))


@query("a23_selective_curve", _JUDGED + """,
c AS (SELECT confidence AS threshold, count(*) AS n, sum(correct::INT) AS h FROM j GROUP BY ALL),
s AS (SELECT threshold, sum(n) OVER (ORDER BY threshold DESC)::BIGINT AS kept, sum(h) OVER (ORDER BY threshold DESC)::BIGINT AS hits FROM c)
SELECT threshold, kept, round(kept::DOUBLE / (SELECT count(*) FROM j), 6) AS coverage, round(hits::DOUBLE / kept, 6) AS precision, round(1 - hits::DOUBLE / kept, 6) AS risk FROM s""")
def a23(v):
    return E.selective_curve(_judged(v)).select("threshold", "kept", *r6("coverage", "precision", "risk"))


@query("a24_abstention_and_usefulness", """
SELECT (SELECT count(*) FROM v_links WHERE access_level = 'not_accessible') AS inaccessible,
       (SELECT round(avg((abstention_code IS NOT NULL)::INT::DOUBLE), 6) FROM v_links WHERE access_level = 'not_accessible') AS abstention_accuracy,
       (SELECT round(avg(usefulness), 6) FROM v_annotations_a) AS mean_usefulness""")
def a24(v):
    return G.abstention_accuracy(v("v_links")).select(
        "inaccessible", *r6("abstention_accuracy"),
        F.round(v("v_annotations_a").agg(F.avg("usefulness").alias("u")).scalar(), 6).alias("mean_usefulness"))


@query("a25_metric_slices", _JUDGED + """
SELECT domain, relation, grouping_id(domain, relation)::BIGINT AS gid, count(*) AS n, round(avg(correct::INT::DOUBLE), 6) AS accuracy, round(avg(f1), 6) AS intent_f1
FROM j GROUP BY CUBE (domain, relation)""")
def a25(v):
    rows = _judged(v).withColumn("intent_f1", S.set_f1(F.col("citation_intents"), F.col("p_intents")))
    return E.metric_slices(rows, ["domain", "relation"]).select("domain", "relation", "gid", "n", *r6("accuracy", "intent_f1"))


_SECTION = "CASE {0} WHEN 'method_adoption' THEN 'methods' WHEN 'result_support' THEN 'results' ELSE 'introduction' END"
_CLOSED = "CASE WHEN relation = 'inaccessible_source' THEN 'not_accessible' ELSE 'open_access_full_text' END"


@query("a25_named_slices", """
WITH j AS (SELECT g.relation = p.relation AS correct, g.domain, g.relation, """ + _SECTION.format("g.citation_intents[1]") + """ AS section,
  """ + _F1.format("g.citation_intents", "p.citation_intents") + """ AS f1 FROM v_gold g JOIN v_predictions p USING (case_id)),
k AS (SELECT *, """ + _CLOSED + """ AS access FROM j)
SELECT concat_ws(',', CASE WHEN grouping(domain) = 0 THEN 'domain' END, CASE WHEN grouping(relation) = 0 THEN 'relation' END,
         CASE WHEN grouping(section) = 0 THEN 'section' END, CASE WHEN grouping(access) = 0 THEN 'access' END) AS slice,
       domain, relation, section, access, count(*) AS n, round(avg(correct::INT::DOUBLE), 6) AS accuracy, round(avg(f1), 6) AS intent_f1
FROM k GROUP BY GROUPING SETS ((domain), (relation), (section), (access), (domain, access))""")
def a25_named(v):
    rows = _judged(v).withColumn("intent_f1", S.set_f1(F.col("citation_intents"), F.col("p_intents"))).withColumn(
        "section", F.expr(_SECTION.format("citation_intents[0]"))).withColumn("access", F.expr(_CLOSED))
    slices = [["domain"], ["relation"], ["section"], ["access"], ["domain", "access"]]
    found = E.named_slices(rows, slices, F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
                           F.avg("intent_f1").alias("intent_f1"))
    return found.select("slice", "domain", "relation", "section", "access", "n", *r6("accuracy", "intent_f1"))


_COMP = {
    "multi_reference_clusters": "n_links > 5", "inaccessible_or_abstract_only": "inaccessible > 0",
    "scope_overgeneral_contradiction": "scoped > 0", "method_transformation": "changed",
    "non_text_evidence": "n_links = 1", "adversarial": "crossing > 0",
}
_COMP_SQL = """
WITH c AS (SELECT analysis_run_id, count(*) AS n_links, count(*) FILTER (WHERE access_level IN ('not_accessible', 'abstract_only')) AS inaccessible,
  count(*) FILTER (WHERE evidence_relation IN ('scope_mismatch', 'overgeneralized', 'contradicts')) AS scoped, bool_or(domain = 'robotics') AS changed,
  count(blocking_code) AS crossing FROM v_links GROUP BY analysis_run_id)
"""


@query("d8_release_composition", _COMP_SQL + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(*) FILTER (WHERE {c}) AS cases, {m}::BIGINT AS minimum, count(*) FILTER (WHERE {c}) >= {m} AS passed FROM c"
    for (k, c), (_, m) in zip(_COMP.items(), vocab.RELEASE_MINIMUMS)))
def d8(v):
    cases = v("v_links").groupBy("analysis_run_id").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(F.col("access_level").isin("not_accessible", "abstract_only")).alias("inaccessible"),
        F.count_if(F.col("evidence_relation").isin("scope_mismatch", "overgeneralized", "contradicts")).alias("scoped"),
        F.bool_or(F.col("domain") == "robotics").alias("changed"), F.count("blocking_code").alias("crossing"))
    return E.release_composition(cases.select(*[F.expr(c).alias(k) for k, c in _COMP.items()]))


def _annotation_rows(v):
    """Annotation rows with the full layout; some fields are broken on purpose."""
    a = v("v_annotations_a")
    key = F.col("o_orderkey")
    filled = {
        "citing_asset_id": F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("as-"), key.cast("string"))),
        "citing_work_version_id": F.lit("wv"), "citation_cluster_id": F.lit("cl"), "citation_anchor_id": F.lit(""),
        "reference_entry_id": F.when(key % 11 != 0, "ref"), "claim_start_offset": (key % 5 - 1).cast("int"),
        "claim_end_offset": F.lit(9), "claim_qualifiers_json": F.array(), "gold_work_id": F.lit(""),
        "gold_work_version_id": F.lit(""), "gold_source_span_ids_json": F.array(),
        "gold_scope_observations_json": F.array(), "expected_abstention_code": F.lit(None).cast("string"),
        "annotation_status": F.when(key % 13 == 0, "done").otherwise("pending"), "annotator_a": F.lit("a"),
        "annotator_b": F.lit("b"), "adjudicator": F.lit(""), "notes": F.lit(""),
    }
    rows = a.withColumns(filled).withColumn(
        "case_id", F.when(key % 17 == 0, F.upper("case_id")).otherwise(F.col("case_id")))
    return rows.select(*vocab.ANNOTATION_COLUMNS)


_D2 = """
WITH r AS (SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN upper(case_id) ELSE case_id END AS cid FROM v_annotations_a),
e AS (SELECT cid AS case_id, 'citing_asset_id' AS path, 'min_length' AS message FROM r WHERE o_orderkey % 7 = 0
  UNION ALL SELECT cid, 'reference_entry_id', 'required' FROM r WHERE o_orderkey % 11 = 0
  UNION ALL SELECT cid, 'claim_start_offset', 'minimum' FROM r WHERE o_orderkey % 5 = 0
  UNION ALL SELECT cid, 'annotation_status', 'enum' FROM r WHERE o_orderkey % 13 = 0
  UNION ALL SELECT cid, 'case_id', 'pattern' FROM r WHERE o_orderkey % 17 = 0)
"""


@query("d2_annotation_validation", _D2 + "SELECT * FROM e")
def d2(v):
    return E.annotation_errors(_annotation_rows(v))


@query("d2_validation_counts", _D2 + """
SELECT count(*) AS rows, count(*) FILTER (WHERE cid IN (SELECT case_id FROM e)) AS invalid,
       count(*) FILTER (WHERE cid NOT IN (SELECT case_id FROM e)) AS valid FROM r""")
def d2b(v):
    rows = _annotation_rows(v)
    return E.validation_counts(rows, E.annotation_errors(rows))


@query("d3_case_validation", """
WITH st AS (SELECT case_id, max(statement_no) AS top FROM v_statements GROUP BY case_id),
c AS (SELECT g.case_id, relation, CASE WHEN relation = 'inaccessible_source' OR g.case_id LIKE '%77' THEN 'not_accessible' ELSE 'abstract_only' END AS access,
      synthetic, relation = 'inaccessible_source' AND NOT synthetic AS has_span FROM v_gold g),
p AS (SELECT p.case_id, p.relation, fabricated_quote FROM v_predictions p)
SELECT case_id, 'inaccessible_with_source' AS problem FROM c WHERE has_span
UNION ALL SELECT case_id, 'inaccessible_without_code' FROM c WHERE relation = 'inaccessible_source' AND synthetic
UNION ALL SELECT case_id, 'not_accessible_with_relation' FROM c WHERE relation <> 'inaccessible_source' AND access = 'not_accessible'
UNION ALL SELECT case_id, 'unknown_predicted_span' FROM p WHERE fabricated_quote
UNION ALL SELECT case_id, 'missing_prediction' FROM c WHERE case_id NOT IN (SELECT case_id FROM p)
UNION ALL SELECT case_id, 'extra_prediction' FROM p WHERE case_id NOT IN (SELECT case_id FROM c)""")
def d3(v):
    closed = F.col("relation") == "inaccessible_source"
    none = F.array().cast("array<string>")
    cases = v("v_gold").select(
        "case_id", F.lit("test").alias("split"), "relation",
        F.when(closed | F.col("case_id").endswith("77"), "not_accessible").otherwise("abstract_only").alias("access"),
        F.when(closed & ~F.col("synthetic"), F.array(F.lit("s1"))).otherwise(none).alias("span_ids"),
        "citation_intents", F.when(closed & ~F.col("synthetic"), "no_access").alias("abstention_code"))
    predictions = v("v_predictions").select(
        "case_id", "relation",
        F.when(F.col("fabricated_quote"), F.array(F.lit("unknown"))).otherwise(none).alias("span_ids"),
        none.alias("statement_span_ids"))
    return E.case_errors(cases, predictions)


@query("k5_annotation_job", KAPPA + "," + MERGED.strip()[4:] + """
SELECT (SELECT count(*) FROM p) AS common, (SELECT count(*) FROM m) AS merged, (SELECT count(*) FROM m WHERE tie) AS ties,
       (SELECT round((agree / n - products / (n * n)) / (1 - products / (n * n)), 6) FROM k WHERE dimension = 'gold_evidence_relation') AS relation_kappa,
       (SELECT count(DISTINCT domain) FROM m) AS domains, (SELECT count(*) >= 300 AND count(DISTINCT domain) >= 8 FROM m) AS passed""")
def k5(v):
    pairs, merged = _pairs(v), _merged(v)
    kappa = E.cohens_kappa(pairs, NOMINAL).where("dimension = 'gold_evidence_relation'").select(F.round("kappa", 6))
    gate = E.preflight(merged)
    return merged.agg(F.count(F.lit(1)).alias("merged"), F.count_if("tie").alias("ties")).select(
        pairs.agg(F.count(F.lit(1))).scalar().alias("common"), "merged", "ties", kappa.scalar().alias("relation_kappa"),
        gate.select("domains").scalar().alias("domains"), gate.select("passed").scalar().alias("passed"))
