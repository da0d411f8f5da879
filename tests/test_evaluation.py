from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evidloom import vocab
from evidloom.functions import sets as S
from evidloom.functions import text as T
from evidloom.operators import evaluation as E
from evidloom.operators import governance as G
from evidloom.operators import lifecycle as C


def pairs(spark, values, kind="string"):
    return spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(values)], f"case_id string, a_x {kind}, b_x {kind}")


def kappa(spark, values):
    return E.cohens_kappa(pairs(spark, values), ["x"]).first()


def test_kappa_of_the_five_case_pilot(spark):
    # three of five agree; label products 1 + 1 + 1*2 give a chance agreement of 4 / 25
    got = kappa(spark, [("d", "d"), ("p", "p"), ("c", "c"), ("o", "c"), ("i", "n")])
    assert got.kappa == pytest.approx(0.5238, abs=1e-4) and got.below_threshold


def test_kappa_edges(spark):
    assert kappa(spark, []).kappa == 0.0
    assert kappa(spark, [("a", "a")] * 3).kappa == 1.0
    assert kappa(spark, [("a", "b"), ("b", "a")]).kappa == -1.0


def alpha_by_pairs(values):
    pool = [x for p in values for x in p]
    do = sum(a != b for a, b in values) / len(values)
    de = sum(a != b for a, b in itertools.combinations(pool, 2)) / (len(pool) * (len(pool) - 1) / 2)
    return None if de in (0, 1) else 1 - do / de


def test_nominal_alpha_equals_the_pair_loop(spark):
    rng = random.Random(2)
    values = [(rng.choice("abc"), rng.choice("abc")) for _ in range(60)]
    got = E.alpha_nominal(pairs(spark, values), ["x"]).first().alpha
    assert got == pytest.approx(alpha_by_pairs(values))
    assert E.alpha_nominal(pairs(spark, [("a", "a"), ("a", "a")]), ["x"]).first().alpha is None
    assert E.alpha_nominal(pairs(spark, [("a", "b")]), ["x"]).first().alpha is None
    assert E.alpha_nominal(pairs(spark, [("a", "b"), ("b", "a")] * 5), ["x"]).first().alpha < -0.5


def test_interval_alpha(spark):
    got = lambda v: E.alpha_interval(pairs(spark, v, "double"), "x").first().alpha
    assert got([(1.0, 1.0), (5.0, 5.0), (3.0, 3.0)]) == 1.0
    assert got([(2.0, 2.0), (2.0, 2.0)]) is None
    assert got([(1.0, 2.0)]) is None
    assert got([(1.0, 5.0), (5.0, 1.0), (1.0, 5.0)]) < -0.5


def test_set_measures(spark):
    rows = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), (["a"], []), (None, None)], "g array<string>, p array<string>")
    g, p = F.col("g"), F.col("p")
    got = rows.select(S.set_f1(g, p), S.jaccard(g, p), S.is_subset(g, p)).collect()
    assert [tuple(r) for r in got] == [(0.5, pytest.approx(1 / 3), False), (1.0, 1.0, True), (0.0, 0.0, False), (1.0, 1.0, True)]


def test_adjudication(spark):
    schema = "case_id string, rel string, claim string, tags array<string>"
    a = spark.createDataFrame([("1", "x", None, ["t"]), ("2", "x", "c", ["t"]), ("3", "x", "c", []), ("5", "x", "c", ["t", "u"])], schema)
    b = spark.createDataFrame([("1", "x", "c", ["t"]), ("2", "y", "c", ["u"]), ("4", "z", "c", ["v"]), ("5", "x", "c", ["u", "t"])], schema)
    j = spark.createDataFrame([("2", "judge", "c", ["w"]), ("9", "only", "c", [])], schema)
    got = {r.case_id: (r.rel, r.claim, r.tags, r.tie) for r in E.adjudicate(a, b, j, ["rel", "claim"], ["tags"]).collect()}
    assert got == {
        "1": ("x", "c", ["t"], False), "2": ("judge", "c", ["w"], False), "3": ("x", "c", [], False),
        "4": ("z", "c", ["v"], True), "5": ("x", "c", ["t", "u"], False)}


def test_rubric_outcomes(spark):
    rules = [("a", "blocking", "eq", 0.0), ("b", "blocking", "lte", 0.1), ("c", "blocking", "gte", 1.0), ("d", "quality", "gte", 0.5),
             ("e", "blocking", "near", 1.0)]
    m = spark.createDataFrame([("a", 0.0), ("b", 0.2), ("e", 1.0)], "metric string, value double")
    run = lambda s: {r.metric: r.outcome for r in E.evaluate_rubric(m, F.lit(s), rules).collect()}
    assert run(True) == {"a": "pass", "b": "fail", "c": "not_measured", "d": "skipped", "e": "fail"}
    assert run(False)["d"] == "not_measured"
    verdict = E.release_verdict(E.evaluate_rubric(m, F.lit(False), rules)).first()
    assert tuple(verdict) == (3, 1, False)


def test_release_scores_with_missing_predictions(spark):
    gold = spark.createDataFrame(
        [("1", "x", ["a"], [], True), ("2", "inaccessible_source", [], [], True), ("3", "x", ["a"], [], True)],
        "case_id string, relation string, citation_intents array<string>, transformations array<string>, synthetic boolean")
    pred = spark.createDataFrame(
        [("1", "x", ["a", "b"], [], True), ("2", "inaccessible_source", [], [], False)],
        "case_id string, relation string, citation_intents array<string>, transformations array<string>, fabricated_quote boolean")
    st = spark.createDataFrame([("1", True), ("1", False), ("2", True), ("3", True)], "case_id string, unsupported boolean")
    r = E.score_release(gold, pred, st).first()
    assert r.relation_accuracy == pytest.approx(2 / 3)
    assert r.citation_intent_set_f1 == pytest.approx((2 / 3 + 1) / 3)
    assert r.unsupported_material_statement_rate == pytest.approx(1 / 3)
    assert (r.fabricated_quote_count, r.synthetic_only, r.case_count) == (1, True, 3)


def test_selective_curve_against_a_loop(spark):
    rng = random.Random(6)
    data = [(rng.choice([.1, .25, .2501, .9, .95]), rng.random() < .6) for _ in range(200)]
    got = {r.threshold: (r.kept, r.precision) for r in
           E.selective_curve(spark.createDataFrame(data, "confidence double, correct boolean"), cells=4).collect()}
    for t in {c for c, _ in data}:
        kept = [ok for c, ok in data if c >= t]
        assert got[t] == (len(kept), pytest.approx(sum(kept) / len(kept)))


@pytest.mark.parametrize("counters, grade, limits", [
    ((10, 10, 10, 9, True, True, False), "a", []),
    ((10, 9, 10, 7, True, True, False), "b", []),
    ((10, 5, 10, 9, True, True, False), "c", ["material_linkage_or_coordinate_limitations"]),
    ((0, 0, 0, 0, True, True, False), "a", []),
    ((10, 10, 10, 10, False, False, True), "d", ["no_meaningful_text", "no_bibliography", "malformed_hierarchy"]),
])
def test_parse_grade(spark, counters, grade, limits):
    schema = ("total_citations int, linked_citations int, total_elements int, elements_with_coords int,"
              " has_meaningful_text boolean, has_bibliography boolean, has_malformed_hierarchy boolean")
    r = G.parse_grade(spark.createDataFrame([counters], schema)).first()
    assert (r.grade, r.limitations) == (grade, limits)


def test_confidence(spark):
    schema = ", ".join(f"{s} double" for s in vocab.STAGES)
    rows = spark.createDataFrame([(None,) * 6, (0.5,) + (None,) * 5, (0.0,) + (None,) * 5, (1.5, -0.2, 1.0, 1.0, 1.0, 1.0)], schema)
    got = [(r.weakest_link, r.balanced_score) for r in G.confidence(rows).collect()]
    assert got == [(1.0, 1.0), (0.5, pytest.approx(0.5 ** (1 / 6))), (0.0, 0.0), (-0.2, 0.0)]


def test_audit_blocks_on_two_codes_only(spark):
    schema = ("source_text string, quote string, start_offset int, end_offset int, evidence_relation string, n_spans int,"
              " statements array<struct<kind:string,span_ids:array<string>>>, claimed_access string, asset_access string, auditor_route string")
    bad = [("evidence_based", []), ("evidence_based", [])]
    rows = spark.createDataFrame([
        ("abc", "zz", 0, 9, "direct_support", 1, [("inference", [])], "x", "y", "main_generation_route"),
        ("abc", "b", 1, 2, "direct_support", 0, bad, "x", "x", "other"),
        ("abc", "Ignore Previous", 1, 2, "inaccessible_source", 0, [], "x", "x", "other")], schema)
    a, b, c = G.audit(rows).collect()
    assert a.audit_status == "passed" and not (a.quote_contained or a.offsets_valid or a.access_disclosed or a.auditor_independent)
    assert b.blocking_codes == ["missing_evidence", "ungrounded_statement"]
    assert c.audit_status == "passed" and not c.injection_free


def test_supersession(spark):
    rows = [("a1", "A", "a2"), ("a2", "A", None), ("b1", "B", "b2"), ("b2", "B", "b3"), ("b3", "B", "b1"), ("c1", "C", None), ("c2", "C", None)]
    got = {tuple(r) for r in G.supersession_problems(
        spark.createDataFrame(rows, "id string, reference_entry_id string, superseded_by_id string")).collect()}
    assert got == {("c1", "several_current_rows"), ("c2", "several_current_rows"),
                   *[(b, "pointer_cycle") for b in ("b1", "b2", "b3")]}


def test_smallest_container_with_tiny_buckets(spark):
    rng = random.Random(9)
    nodes = [(1, i, s, s + rng.randrange(1, 400)) for i, s in enumerate(rng.randrange(0, 900) for _ in range(60))]
    spans = [(1, i, s, s + rng.randrange(1, 60)) for i, s in enumerate(rng.randrange(0, 1200) for _ in range(80))]
    got = {r.span_id: r.node_id for r in G.smallest_container(
        spark.createDataFrame(spans, "doc_id int, span_id int, start_offset int, end_offset int"),
        spark.createDataFrame(nodes, "doc_id int, node_id int, start_offset int, end_offset int"), bucket=32).collect()}
    for _, i, s, e in spans:
        inside = sorted((ne - ns, n) for _, n, ns, ne in nodes if ns <= s and e <= ne)
        assert got[i] == (inside[0][1] if inside else None)


def test_visibility_chain(spark):
    assets = spark.createDataFrame([(1, "w1"), (2, "w2")], "asset_id int, workspace_id string")
    docs = spark.createDataFrame([(10, 1), (20, 2)], "doc_id int, asset_id int")
    clusters = spark.createDataFrame([(100, 10), (200, 20)], "cluster_id int, doc_id int")
    anchors = spark.createDataFrame([(7, 100), (8, 200), (9, None)], "anchor_id int, cluster_id int")
    chain = [("cluster_id", clusters, "cluster_id"), ("doc_id", docs, "doc_id"), ("asset_id", assets, "asset_id")]
    assert [r.anchor_id for r in G.visible_children(anchors, chain, "w2").collect()] == [8]


def test_live_metrics_of_an_empty_window_are_null(spark):
    links = spark.createDataFrame([], "workspace_id string, link_id string, access_level string, abstention_code string, weakest_link double, blocking_codes array<string>")
    r = E.live_blocking_metrics(links, ["link_id"], workspace="w").first()
    assert tuple(r) == (0, None, None, None)


def test_state_edges_and_alerts(spark):
    edges = set(vocab.STATE_EDGES)
    # created 2, seven working states 3 each, auditing 4
    assert len(edges) == 2 + 7 * 3 + 4
    assert ("created", "failed") not in edges and ("auditing", "completed_with_limits") in edges
    rows = spark.sql("""SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,CAST(id AS INT),0) AS start, 1L AS created,
        0L AS failed, CASE WHEN id = 3 THEN 1L ELSE 0L END AS completed, 0L AS quote_failures FROM range(8)""")
    got = [r.stalled for r in C.alert_windows(rows, stalled_for=3).orderBy("start").collect()]
    assert got == [False, False, True, False, False, False, True, True]
    failing = spark.sql("""SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,CAST(id AS INT),0) AS start,
        CASE WHEN id < 2 THEN 0L ELSE 100L END AS created, CASE WHEN id < 6 THEN 11L ELSE 10L END AS failed,
        1L AS completed, CASE WHEN id = 4 THEN 3000L ELSE 3001L END AS quote_failures FROM range(10)""")
    rows = C.alert_windows(failing).orderBy("start").collect()
    # failures without anything created count; ten of a hundred is not above a tenth
    assert [r.failure_rate_high for r in rows] == [False] * 4 + [True] * 2 + [False] * 4
    assert [r.quote_failures_high for r in rows] == [False] * 9 + [True]


def test_papers(spark):
    from evidloom.sources import papers as X

    xml = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div xml:id="s1"><head>Intro</head><p xml:id="p1">As in
      <ref type="bibr" target="#b1 #b2" coords="2,1,1">[1, 2]</ref>, <hi>mixed</hi> text.</p></div></body><back><listBibl>
      <biblStruct xml:id="b1"><analytic><title level="a">T <hi>one</hi></title><author><persName><forename>A</forename><surname>B</surname></persName></author>
      </analytic><monogr><title level="j">J</title><imprint><date type="published" when="2020-05"/></imprint></monogr><idno type="DOI"> 10.1/x </idno></biblStruct>
      </listBibl></back></text></TEI>"""
    evil = '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'
    files = spark.createDataFrame([("a", bytearray(xml.encode())), ("b", bytearray(b"<broken")), ("c", bytearray(evil.encode()))],
                                  "path string, content binary")
    parsed = X.parse_papers(files)
    assert {r.path: r.error for r in parsed.select("path", "error").collect()} == {"a": None, "b": "ParseError", "c": "ValueError"}
    ref = X.references(parsed).first()
    assert (ref.title, ref.authors, ref.year, ref.venue, ref.identifiers) == ("T one", ["A B"], "2020-05", "J", {"doi": "10.1/x"})
    mark = X.clusters(parsed).first()
    assert (mark.anchor_text, mark.targets, mark.coords, mark.parent_id) == ("[1, 2]", ["b1", "b2"], "2,1,1", "p1")
    section = X.sections(parsed).first()
    assert section.head == "Intro" and section.text.endswith("[1, 2], mixed text.")


def test_annotation_rules_cover_the_layout(spark):
    row = {c: "x" for c in vocab.ANNOTATION_COLUMNS} | {
        "case_id": "Bad Id", "split": "none", "claim_start_offset": -1, "claim_end_offset": 1, "gold_citation_intents_json": [],
        "claim_qualifiers_json": [], "gold_source_span_ids_json": [], "gold_scope_observations_json": [], "gold_transformations_json": [],
        "expected_abstention_code": None, "notes": None, "resolution_status": "ambiguous", "source_access_level": "not_accessible",
        "gold_evidence_relation": "contradicts", "annotation_status": "pending"}
    kinds = {int: "int", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in row.items())
    rows = spark.createDataFrame([tuple(row.values())], schema).withColumn("extra", F.lit(1))
    got = {(r.path, r.message) for r in E.annotation_errors(rows).collect()}
    assert got == {("case_id", "pattern"), ("split", "enum"), ("claim_start_offset", "minimum"),
                   ("gold_citation_intents_json", "min_items"), ("notes", "required"), ("extra", "additional")}


def test_kappa_counts_missing_labels(spark):
    pairs = spark.createDataFrame([(None, None), ("x", "x"), ("y", "y")], "a_d string, b_d string")
    assert E.cohens_kappa(pairs, ["d"]).first().kappa == pytest.approx(1.0)
    mixed = spark.createDataFrame([(None, "x"), ("x", "x"), ("y", "y")], "a_d string, b_d string")
    assert E.cohens_kappa(mixed, ["d"]).first().kappa == pytest.approx((2 / 3 - 1 / 3) / (1 - 1 / 3))


def test_url_denials(spark):
    cases = {
        "https://[0:0:0:0:0:0:0:1]/": "PRIVATE_ADDRESS", "https://[::1]/": "PRIVATE_ADDRESS",
        "https://[::ffff:10.0.0.1]/": "PRIVATE_ADDRESS", "https://[::ffff:7f00:1]/": "PRIVATE_ADDRESS",
        "https://[2001:db8::1]/": "PRIVATE_ADDRESS", "https://[fe80::1%25eth0]/": "PRIVATE_ADDRESS",
        "https://[fd12:3456::1]/x": "PRIVATE_ADDRESS", "https://[2606:4700::1111]/": None,
        "https://[::ffff:8.8.8.8]/": None, "https://h.org:abc/": "PORT_NOT_ALLOWED",
        "https://h.org:99999999999/": "PORT_NOT_ALLOWED", "https://h.org:8443/": "PORT_NOT_ALLOWED",
        "https://h.org:443/": None, "https://h.org:/": None, "https://h.org/": None,
        "http://h.org/": "SCHEME_NOT_ALLOWED", "https://u@h.org/": "CREDENTIALS_NOT_ALLOWED",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.d for r in rows.select("url", T.url_denial(F.col("url")).alias("d")).collect()} == cases


def test_redaction_of_all_patterns(spark):
    texts = {
        "Bearer\u00a0abc.def==": "Bearer [REDACTED]", "a Bearer  x/y b": "a Bearer [REDACTED] b",
        "API-KEY=abc1": "api_key=[REDACTED]", "sk-" + "a" * 20: "sk-[REDACTED]", "sk-short": "sk-short",
        "https://b.example/o?X-Goog-Signature=ff": "[SIGNED_URL_REDACTED]",
        "https://b.example/o?a=1&X-Amz-Signature=ff": "[SIGNED_URL_REDACTED]", "plain": "plain",
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.r for r in rows.select("t", T.redact(F.col("t")).alias("r")).collect()} == texts


def test_refused_moves_leave_the_state(spark):
    import datetime as dt

    rng = random.Random(11)
    states, edges = list(vocab.STATE_PERCENT), set(vocab.STATE_EDGES)
    rows = []
    for i in range(400):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 400))
        rows.append((i, rng.choice([1, 1, 1, 2, 3]), at, rng.choice(states[:4] + states)))
    want, current = set(), {}
    for i, key, at, status in sorted(rows, key=lambda r: (r[2], r[0])):
        state = current.get(key)
        if state is None:
            outcome = "start"
        elif state == status:
            outcome = "same"
        else:
            outcome = "accepted" if (state, status) in edges else "invalid"
        want.add((i, state, outcome))
        if outcome in ("start", "accepted"):
            current[key] = status
    history = spark.createDataFrame(rows, "event_id long, analysis_id long, occurred_at timestamp, status string")
    for size in ("hour", "minute"):
        got = C.transition_check(history, "analysis_id", ["occurred_at", "event_id"], size)
        assert {(r.event_id, r.previous, r.outcome) for r in got.collect()} == want


def test_papers_are_given_out_in_small_parts(monkeypatch):
    """A batch of many papers must not stand in memory as one list of parsed rows; unasked tables stay empty."""
    import pyarrow as pa

    from evidloom.sources import papers as X

    monkeypatch.setattr(X, "OUT_BYTES", 600)
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>H</head><p>{}</p></div></body></text></TEI>'
    content = [tei.format(i).encode() for i in range(40)] + [None]
    batch = pa.RecordBatch.from_pylist([{"path": str(i), "content": c} for i, c in enumerate(content)])
    kinds = pa.schema([("path", pa.string()), ("error", pa.string()), ("refs", pa.list_(pa.string())),
                       ("clusters", pa.list_(pa.string())), ("sections", pa.list_(pa.struct([("text", pa.string())])))])
    parts = list(X._rows(iter([batch]), kinds, ("refs", "sections")))
    rows = [r for part in parts for r in part.to_pylist()]
    assert [r["path"] for r in rows] == [str(i) for i in range(41)]
    assert max(part.num_rows for part in parts) <= 6
    assert [r["sections"] for r in rows[:40]] == [[{"text": f"H{i}"}] for i in range(40)] and rows[40]["error"] == "ParseError"
    assert all(r["sections"] == [] for part in X._rows(iter([batch]), kinds, ("refs",)) for r in part.to_pylist())


def test_case_errors_count_ids_without_joining_them(spark):
    cases = spark.createDataFrame(
        [("a", ["s1"]), ("b", []), ("b", []), ("c", ["s1"]), (None, [])], "case_id string, span_ids array<string>").select(
        "case_id", F.lit("test").alias("split"), F.lit("contradicts").alias("relation"), F.lit("abstract_only").alias("access"),
        "span_ids", F.array(F.lit("background")).alias("citation_intents"), F.lit("x").alias("abstention_code"))
    predictions = spark.createDataFrame(
        [("a", "contradicts", ["s2"], ["s1"]), ("b", "odd", [], []), ("d", "contradicts", ["s1"], []), (None, "contradicts", [], []),
         ("d", "contradicts", [], [])],
        "case_id string, relation string, span_ids array<string>, statement_span_ids array<string>")
    found = E.case_errors(cases, predictions)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([
        ("a", "unknown_predicted_span"), ("b", "unknown_predicted_relation"), ("b", "duplicate_case"), ("c", "missing_prediction"),
        ("d", "unknown_predicted_span"), ("d", "extra_prediction"), ("d", "duplicate_prediction"), (None, "missing_prediction"), (None, "extra_prediction")], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 1
