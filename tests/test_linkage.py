from __future__ import annotations

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from evidloom.functions import linkage as L
from evidloom.functions import text as T
from evidloom.operators import resolution as R
from evidloom.sources import providers as P

CAND = ("reference_entry_id int, provider string, provider_rank int, result_rank int, provider_record_id string,"
        " title string, authors array<string>, year int, venue string, doi string, arxiv string")


def test_sequence_ratio(spark):
    pairs = [("Deep Nets", "deep nets"), ("a study", "the study of"), (None, "x"), ("", "x"), ("ab" * 150, "ba" * 150)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in rows.select(L.sequence_ratio(F.col("a"), F.col("b"))).collect()]
    want = [difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0 for a, b in pairs]
    assert got == pytest.approx(want)


def test_identifier_year_author_venue(spark):
    row = spark.createDataFrame(
        [(["smith", "Lee"], ["John SMITH"], 2020, 2021, "NLP", "Proc. of nlp", "10.1/A", "10.1/a", "2101.1", "2101.2")],
        "ra array<string>, ca array<string>, ry int, cy int, rv string, cv string, rd string, cd string, rx string, cx string")
    ids = [F.col(c) for c in ("rd", "cd", "rx", "cx")]
    got = row.select(
        L.author_overlap(F.col("ra"), F.col("ca")), L.year_proximity(F.col("ry"), F.col("cy")),
        L.venue_score(F.col("rv"), F.col("cv")), L.identifier_score(*ids), L.identifier_conflicts(*ids)).first()
    assert tuple(got) == (0.5, 0.8, 1.0, 1.0, ["arxiv_conflict"])


def test_first_year(spark):
    rows = spark.createDataFrame([("2020-05",), ("n.d.",), (None,)], "y string")
    assert [r[0] for r in rows.select(L.first_year(F.col("y"))).collect()] == [2020, None, None]


@pytest.mark.parametrize("scores, status, reason, selected", [
    ([], "unresolved", "no_candidates", None),
    ([0.95], "resolved", None, "p:0"),
    ([0.95, 0.90], "ambiguous", "ambiguous_candidates", None),
    ([0.95, 0.80], "resolved", None, "p:0"),
    ([0.85], "ambiguous", "needs_review", None),
    ([0.5, 0.4], "unresolved", "low_score", None),
])
def test_decisions(spark, scores, status, reason, selected):
    refs = spark.createDataFrame([(1,)], "reference_entry_id int")
    rows = [(1, s, "p", 1, i, str(i)) for i, s in enumerate(scores)]
    scored = spark.createDataFrame(
        rows, "reference_entry_id int, score double, provider string, provider_rank int, result_rank int, provider_record_id string")
    r = R.decide(refs, scored).first()
    assert (r.status, r.reason_code, r.selected_candidate_id) == (status, reason, selected)
    assert r.requires_human_review == (status == "ambiguous")


def test_provider_agreement_against_pairs(spark):
    rng = random.Random(4)
    rows = [
        (rng.choice([1, 1, 1, 2, 3]), "p", 1, i, f"r{i}", rng.choice(["T a", "t A", "u", "v"]), [], 2000, "v",
         rng.choice([None, "d1", "d2"]), None) for i in range(60)]
    got = {r.provider_record_id: r.provider_agreement
           for r in R.provider_agreement(spark.createDataFrame(rows, CAND)).collect()}
    for a in rows:
        group = [b for b in rows if b[0] == a[0]]
        hits = sum(1 for b in group if (a[9] and b[9] == a[9]) or b[5].lower() == a[5].lower())
        assert got[a[4]] == pytest.approx(hits / len(group))


def grams(t):
    p = f"  {t} "
    return {p[i:i + 3] for i in range(len(p) - 2)}


def test_title_search_is_exact(spark):
    rng = random.Random(8)
    words = ["graph", "neural", "nets", "for", "deep", "citation", "models", "model", "of", "text"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(2, 6)))
    refs = [(i, title()) for i in range(40)] + [(100 + i, "deep citation models") for i in range(20)]
    works = [(f"w{i:03d}", title() if i % 3 else "deep  Citation models") for i in range(90)]
    r = spark.createDataFrame([(i, t, None, None) for i, t in refs], "reference_entry_id int, title string, doi string, arxiv string")
    w = spark.createDataFrame([("p", i, t, None, None) for i, t in works], "provider string, provider_record_id string, title string, doi string, arxiv string")
    got = {}
    for x in R.title_candidates(r, w, threshold=0.5, k=3).collect():
        got.setdefault(x.reference_entry_id, []).append((-x.similarity, x.provider_record_id))
    for i, t in refs:
        key = " ".join(t.lower().split())
        sims = []
        for wid, wt in works:
            a, b = grams(key), grams(" ".join(wt.lower().split()))
            s = round(len(a & b) / len(a | b), 6)
            if s >= 0.5:
                sims.append((-s, wid))
        assert sorted(got.get(i, [])) == sorted(sims)[:3]


def test_title_search_has_no_cut(spark):
    """Best five per reference and provider out of 2,000 titles, down to any shared trigram."""
    rng = random.Random(12)
    pool = ["".join(rng.choices("abdegiklmnorstu", k=rng.randint(2, 8))) for _ in range(500)]
    title = lambda: " ".join(rng.choices(pool, k=rng.randint(1, 9)))
    works = [("crossref" if i % 3 else "rare" if i < 12 else "openalex", f"w{i:04d}", title(), f"A. N{i % 5}") for i in range(1900)]
    works += [("openalex", f"x{i:04d}", "introduction", "B. Q") for i in range(100)]
    refs = [(i, title(), f"C. N{i % 5}") for i in range(60)] + [(100, "introduction", "B. Q"), (101, "zzzz", None), (102, "", None), (103, None, None)]
    refs += [(200 + i, f"{works[i][2]} in brief", None) for i in range(0, 40, 2)]
    r = spark.createDataFrame([(i, t, None, None, [a] if a else None) for i, t, a in refs],
                              "reference_entry_id int, title string, doi string, arxiv string, authors array<string>")
    w = spark.createDataFrame([(p, i, t, None, None, [a]) for p, i, t, a in works],
                              "provider string, provider_record_id string, title string, doi string, arxiv string, authors array<string>")
    got = {}
    for x in R.title_candidates(r, w).collect():
        got.setdefault((x.reference_entry_id, x.provider), []).append((x.result_rank, x.provider_record_id, x.similarity))
    sets = [(p, i, grams(t), a.split()[-1].lower()) for p, i, t, a in works]
    for i, t, a in refs:
        own = grams(t) if t else set()
        hint = a.split()[-1].lower() if a else None
        for p in ("crossref", "openalex", "rare"):
            best = sorted((-round(len(own & g) / len(own | g), 6), not (p == "crossref" and name == hint), wid)
                          for q, wid, g, name in sets if q == p and own & g)[:5]
            assert sorted(got.get((i, p), [])) == [(n, wid, -s) for n, (s, _, wid) in enumerate(best, 1)], (i, p)


def test_titles_meet_in_blocks(spark, monkeypatch):
    """Several blocks on both sides find what all pairs hold, and give out no more than the best of each block."""
    monkeypatch.setattr(R, "REF_CHARS", 400)
    monkeypatch.setattr(R, "WORK_CHARS", 3_000)
    rng = random.Random(5)
    pool = ["".join(rng.choices("abdeginorstu", k=rng.randint(2, 7))) for _ in range(60)] + ["\U0001d4d0\U0001d4d1", "über"]
    titles = sorted({" ".join(rng.choices(pool, k=rng.randint(1, 8))) for _ in range(330)})
    refs, works = list(enumerate(titles[::7])), [(i, "abc"[i % 3], t) for i, t in enumerate(titles)]
    found = R.similar_titles(spark.createDataFrame(refs, "rid long, t string"),
                             spark.createDataFrame(works, "wid long, provider string, t string"), 2).collect()
    got = {}
    for x in found:
        got.setdefault((x.rid, x.provider), []).append((-x.similarity, x.wid))
    for i, t in refs:
        for p in "abc":
            sims = sorted((-round(len(grams(t) & grams(u)) / len(grams(t) | grams(u)), 6), j) for j, q, u in works if q == p and grams(t) & grams(u))
            assert sorted(got[i, p])[:2] == sims[:2], (t, p)
    assert len(found) < 0.5 * sum(bool(grams(t) & grams(u)) for _, t in refs for _, _, u in works)


def test_lookup_takes_the_first_identifier_only(spark):
    r = spark.createDataFrame(
        [(1, "t", "10.1/x", "2101.1", "W9"), (2, "t", "10.1/x", "2101.1", "nope"), (3, "t", None, "2101.1", None), (4, "t", "", "2101.1", "")],
        "reference_entry_id int, title string, doi string, arxiv string, openalex string")
    w = spark.createDataFrame(
        [("openalex", "w9", "a", None, None), ("openalex", "w1", "b", "10.1/X", "2101.1"), ("openalex", "w2", "b", "10.1/X", None),
         ("crossref", "c1", "c", "10.1/x", "2101.1"), ("semanticscholar", "s1", "d", None, "2101.1")],
        "provider string, provider_record_id string, title string, doi string, arxiv string")
    got = {(x.reference_entry_id, x.provider, x.provider_record_id, x.match) for x in R.exact_candidates(r, w).collect()}
    assert got == {(1, "openalex", "w9", "native"), (1, "crossref", "c1", "doi"), (2, "crossref", "c1", "doi"),
                   (3, "openalex", "w1", "arxiv"), (3, "semanticscholar", "s1", "arxiv"),
                   (4, "openalex", "w1", "arxiv"), (4, "semanticscholar", "s1", "arxiv")}


def test_exact_match_suppresses_title_search(spark):
    r = spark.createDataFrame([(1, "some title", "https://doi.org/10.1/X", None)], "reference_entry_id int, title string, doi string, arxiv string")
    w = spark.createDataFrame(
        [("a", "1", "other", "10.1/x", None), ("a", "2", "some title", None, None), ("b", "3", "some title", None, None)],
        "provider string, provider_record_id string, title string, doi string, arxiv string")
    got = {(x.provider, x.provider_record_id, x.match) for x in R.generate_candidates(r, w).collect()}
    assert got == {("a", "1", "doi"), ("b", "3", "title")}


def test_provider_records(spark):
    reply = {"status": "ok", "message": {"items": [
        {"title": ["  A Title "], "author": [{"given": "Ann", "family": "Lee"}, {"family": "Group"}, {"given": "x"}],
         "issued": {"date-parts": [[2019, 1]]}, "container-title": ["J"], "DOI": "10.1/ABC"}, {}]}}
    rows = spark.createDataFrame([(1, json.dumps(reply))], "id int, j string")
    first, second = P.crossref(rows, "j", ["id"]).orderBy("result_rank").collect()
    assert (first.normalized_title, first.authors, first.year, first.doi) == ("a title", ["Ann Lee", "Group"], 2019, "10.1/abc")
    assert (second.title, second.authors, second.provider_record_id, second.doi) == ("Unknown Title", [], "", None)


def test_acquisition_order(spark):
    days = F.lit(30)
    yes, no = F.lit(True), F.lit(False)
    cases = {
        "user_private_full_text": (yes, yes, "publisher", yes, yes), "publisher_open_full_text": (no, yes, "publisher", yes, yes),
        "repository_manuscript": (no, yes, "repository", yes, yes), "open_access_full_text": (no, yes, None, yes, yes),
        "abstract_only": (no, no, None, yes, yes), "metadata_only": (no, no, None, no, yes), "not_accessible": (no, no, None, no, no)}
    row = spark.range(1).select(*[
        R.acquisition_policy(a, b, F.lit(h).cast("string"), c, d, days)["access_level"].alias(n) for n, (a, b, h, c, d) in cases.items()]).first()
    assert row.asDict() == {n: n for n in cases}


def test_normalisers(spark):
    rows = spark.createDataFrame([("  HTTPS://doi.org/10.1/X ", "  A  B\n", "é  x\x1cy")], "d string, t string, n string")
    got = rows.select(T.doi(F.col("d")), T.title_key(F.col("t")), T.normalise(F.col("n"))).first()
    assert tuple(got) == ("10.1/x", "a b", "é x y")


def test_url_admission(spark):
    urls = {
        "https://example.org/x": None, "http://example.org": "SCHEME_NOT_ALLOWED", "ftp://a": "SCHEME_NOT_ALLOWED",
        "no-scheme": "SCHEME_NOT_ALLOWED", "https://u:p@example.org": "CREDENTIALS_NOT_ALLOWED", "https:///x": "HOST_NOT_ALLOWED",
        "https://example.org:8080/": "PORT_NOT_ALLOWED", "https://example.org:443/": None, "https://127.0.0.1/": "PRIVATE_ADDRESS",
        "https://192.168.3.4/": "PRIVATE_ADDRESS", "https://172.32.0.1/": None, "https://[::1]/": "PRIVATE_ADDRESS",
        "https://224.0.0.1/": "PRIVATE_ADDRESS", "https://8.8.8.8/": None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in rows.select("u", T.url_denial(F.col("u")).alias("c")).collect()} == urls


def test_redaction(spark):
    text = "Bearer abc.def== api_key=xyz sk-" + "a" * 24 + " https://h/p?a=1&X-Amz-Signature=zz"
    row = spark.createDataFrame([(text,)], "t string")
    out = row.select(T.redact(F.col("t")), *T.redaction_hits(F.col("t"))).first()
    assert out[0] == "Bearer [REDACTED] api_key=[REDACTED] sk-[REDACTED] [SIGNED_URL_REDACTED]"
    assert list(out)[1:] == [1, 1, 1, 0, 1]
