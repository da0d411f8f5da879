"""Registered linkage queries (S3, U1, F3-F9, F13, J1, J2, J9, R13-R15, W2, W3, W5, W6, P6, P7,
P18, A1, A2, K1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions import linkage as L
from evidloom.functions import text as T
from evidloom.operators import resolution as R
from evidloom.plans.registry import query
from evidloom.session import through_table
from evidloom.sources import providers as P

REF = "reference_entry_id"
DOI = r"regexp_replace(lower(trim({0})), '^(https?://doi\.org/|doi:)', '')"


@query("s3a_crossref_candidates", rf"""
SELECT reply_id, pos AS result_rank, coalesce(i->>'$.DOI', '') AS provider_record_id,
       coalesce(i->>'$.title[0]', 'Unknown Title') AS title,
       regexp_replace(lower(trim(coalesce(i->>'$.title[0]', 'Unknown Title'))), '\s+', ' ', 'g') AS normalized_title,
       CASE WHEN (i->'$.author') IS NULL THEN '' ELSE concat('Kim ', (i->>'$.author[0].family'), '|', (i->>'$.author[1].family')) END AS authors,
       CAST(i->>'$.issued.date-parts[0][0]' AS INT) AS year, i->>'$.container-title[0]' AS venue,
       lower(i->>'$.DOI') AS doi
FROM (SELECT reply_id, pos, json_extract(reply, concat('$.message.items[', pos - 1, ']')) AS i
      FROM (SELECT *, unnest([1, 2]) AS pos FROM v_crossref_replies) WHERE (reply->>'$.status') = 'ok')""")
def s3a(v):
    rows = P.crossref(v("v_crossref_replies"), "reply", ["reply_id"])
    return rows.select("reply_id", "result_rank", "provider_record_id", "title", "normalized_title",
                       F.array_join("authors", "|").alias("authors"), "year", "venue", "doi")


@query("s3b_openalex_candidates", """
SELECT reply_id, replace((reply->>'$.id'), 'https://openalex.org/', '') AS provider_record_id, reply->>'$.title' AS title,
       reply->>'$.authorships[0].author.display_name' AS authors, CAST((reply->>'$.publication_year') AS INT) AS year,
       reply->>'$.primary_location.source.display_name' AS venue, replace((reply->>'$.doi'), 'https://doi.org/', '') AS doi
FROM v_openalex_records""")
def s3b(v):
    rows = P.openalex(v("v_openalex_records"), "reply", ["reply_id"])
    return rows.select("reply_id", "provider_record_id", "title",
                       F.array_join("authors", "|").alias("authors"), "year", "venue", "doi")


@query("s3c_scholar_candidates", """
SELECT reply_id, reply->>'$.paperId' AS provider_record_id,
       CASE WHEN (reply->>'$.title') = '' THEN 'Unknown Title' ELSE reply->>'$.title' END AS title,
       reply->>'$.authors[0].name' AS authors, CAST((reply->>'$.year') AS INT) AS year, reply->>'$.venue' AS venue,
       reply->>'$.externalIds.DOI' AS doi, reply->>'$.externalIds.ArXiv' AS arxiv
FROM v_scholar_records""")
def s3c(v):
    rows = P.semantic_scholar(v("v_scholar_records"), "reply", ["reply_id"])
    return rows.select("reply_id", "provider_record_id", "title",
                       F.array_join("authors", "|").alias("authors"), "year", "venue", "doi", "arxiv")


@query("s3d_open_access_records", """
SELECT reply_id, reply->>'$.doi' AS doi, CAST((reply->>'$.is_oa') AS BOOLEAN) AS is_oa,
       reply->>'$.best_oa_location.host_type' AS host_type, reply->>'$.best_oa_location.license' AS license,
       CASE WHEN (reply->>'$.is_oa') = 'true' AND (reply->'$.best_oa_location') IS NOT NULL
            THEN coalesce(reply->>'$.best_oa_location.url_for_pdf', reply->>'$.best_oa_location.url') END AS proposed_url
FROM v_open_access_records""")
def s3d(v):
    rows = P.open_access(v("v_open_access_records"), "reply", ["reply_id"])
    return rows.select("reply_id", "doi", "is_oa", "host_type", "license", "proposed_url")


@query("u1_provider_union", """
SELECT provider, count(*) AS n, count(doi) AS with_doi, count(arxiv) AS with_arxiv FROM (
  SELECT 'crossref' AS provider, 'x' AS doi, NULL AS arxiv
  FROM (SELECT unnest([1, 2]) FROM v_crossref_replies WHERE (reply->>'$.status') = 'ok')
  UNION ALL SELECT 'openalex', reply->>'$.doi', NULL FROM v_openalex_records
  UNION ALL SELECT 'semantic_scholar', reply->>'$.externalIds.DOI', reply->>'$.externalIds.ArXiv' FROM v_scholar_records)
GROUP BY provider""")
def u1(v):
    rows = P.union_candidates(
        P.crossref(v("v_crossref_replies"), "reply", ["reply_id"]),
        P.openalex(v("v_openalex_records"), "reply", ["reply_id"]),
        P.semantic_scholar(v("v_scholar_records"), "reply", ["reply_id"]),
    )
    return rows.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"), F.count("doi").alias("with_doi"),
        F.count("arxiv").alias("with_arxiv"))


@query("f3_doi_normalise", f"SELECT provider_record_id, {DOI.format('doi')} AS doi FROM v_candidates")
def f3(v):
    return v("v_candidates").select("provider_record_id", T.doi(F.col("doi")).alias("doi"))


_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("f4_title_author_normalise", f"""
SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '^{_WS}|{_WS}$', '', 'g'), '{_WS}', ' ', 'g')) AS title_hash,
       len(list_filter(string_split(text, '.'), lambda a: regexp_replace(a, '{_WS}', '', 'g') <> '')) AS n_names
FROM documents""")
def f4(v):
    # the rules run on whole texts here: the text as a title, its parts between dots as names
    return v("documents").select(
        "doc_id", F.md5(T.title_key(F.col("text"))).alias("title_hash"),
        F.size(T.author_list(F.split("text", r"\."))).cast("bigint").alias("n_names"))


FIRST_WINS = f"""
WITH c AS (SELECT * REPLACE ({DOI.format('doi')} AS doi) FROM v_candidates),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference_entry_id, coalesce(doi, lower(title))
                     ORDER BY provider_rank, result_rank, provider_record_id) AS rn FROM c) WHERE rn = 1)
"""
AGREEMENT = FIRST_WINS + """,
g AS (SELECT a.reference_entry_id, a.provider_record_id,
             (SELECT count(*) FROM d b WHERE b.reference_entry_id = a.reference_entry_id
                AND (b.doi = a.doi OR lower(b.title) = lower(a.title)))::DOUBLE
             / (SELECT count(*) FROM d b WHERE b.reference_entry_id = a.reference_entry_id) AS agreement
      FROM d a)
"""
FEATURES = AGREEMENT + """,
f AS (SELECT d.reference_entry_id, d.provider, d.provider_rank, d.result_rank, d.provider_record_id, d.title, d.doi,
  CASE WHEN r.doi IS NOT NULL AND lower(r.doi) = lower(d.doi) THEN 1 ELSE 0 END::DOUBLE AS identifier_score,
  CASE WHEN r.doi IS NOT NULL AND d.doi IS NOT NULL AND lower(r.doi) <> lower(d.doi) THEN 'doi_conflict' ELSE '' END AS conflicts,
  CASE WHEN lower(r.title) = lower(d.title) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * length(r.title) / (length(r.title) + length(d.title)) END AS title_score,
  len(list_filter(r.authors, lambda a: len(list_filter(d.authors, lambda x: contains(lower(x), lower(a)))) > 0))::DOUBLE
     / greatest(len(r.authors), len(d.authors)) AS author_score,
  CASE abs(r.year - d.year) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS year_score,
  CASE WHEN contains(lower(d.venue), lower(r.venue)) OR contains(lower(r.venue), lower(d.venue)) THEN 1.0 END::DOUBLE AS venue_score,
  agreement
  FROM d JOIN v_references r USING (reference_entry_id) JOIN g USING (reference_entry_id, provider_record_id)),
sc AS (SELECT *, CASE WHEN conflicts <> '' THEN 0.0::DOUBLE ELSE greatest(0, least(1, identifier_score * 0.35::DOUBLE + title_score * 0.25::DOUBLE
   + author_score * 0.15::DOUBLE + year_score * 0.08::DOUBLE + venue_score * 0.05::DOUBLE + 0.07::DOUBLE + agreement * 0.05::DOUBLE)) END AS score FROM f)
"""
DECISIONS = FEATURES + """,
rk AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS next_score FROM sc
       WINDOW w AS (PARTITION BY reference_entry_id ORDER BY score DESC, provider_rank, result_rank)),
bm AS (SELECT reference_entry_id, score AS top_score, score - coalesce(next_score, 0) AS margin, next_score IS NOT NULL AS has_second,
       provider, provider_record_id FROM rk WHERE rn = 1),
dec AS (SELECT r.reference_entry_id, r.document_id,
  CASE WHEN top_score IS NULL THEN 'unresolved' WHEN top_score >= 0.9 AND margin >= 0.08 THEN 'resolved'
       WHEN top_score >= 0.8 THEN 'ambiguous' ELSE 'unresolved' END AS status,
  CASE WHEN top_score IS NULL THEN 'no_candidates' WHEN top_score >= 0.9 AND margin >= 0.08 THEN NULL
       WHEN top_score >= 0.8 AND has_second AND margin < 0.08 THEN 'ambiguous_candidates'
       WHEN top_score >= 0.8 THEN 'needs_review' ELSE 'low_score' END AS reason_code,
  CASE WHEN top_score >= 0.9 AND margin >= 0.08 THEN concat(provider, ':', provider_record_id) END AS selected_candidate_id,
  top_score, margin, provider_record_id
  FROM v_references r LEFT JOIN bm USING (reference_entry_id))
"""


def _candidates(v):
    return v("v_candidates").withColumn("doi", T.doi(F.col("doi")))


def _features(v):
    return R.resolution_features(v("v_references"), R.first_wins(_candidates(v)))


def _scored(v):
    return R.identity_score(_features(v))


def _decisions(v):
    return R.decide(v("v_references"), _scored(v))


@query("w2_first_wins_dedupe", FIRST_WINS + "SELECT reference_entry_id, provider_record_id, doi FROM d")
def w2(v):
    return R.first_wins(_candidates(v)).select(REF, "provider_record_id", "doi")


@query("w5_provider_agreement", AGREEMENT + """
SELECT reference_entry_id, provider_record_id, round(agreement, 6) AS agreement FROM g""")
def w5(v):
    return R.provider_agreement(R.first_wins(_candidates(v))).select(
        REF, "provider_record_id", F.round("provider_agreement", 6).alias("agreement"))


@query("j1_reference_candidates", """
SELECT reference_entry_id, count(*) AS pairs, count(DISTINCT provider) AS providers
FROM v_references JOIN v_candidates USING (reference_entry_id) GROUP BY reference_entry_id""")
def j1(v):
    pairs = v("v_references").select(REF).join(v("v_candidates").select(REF, "provider"), REF)
    return pairs.groupBy(REF).agg(F.count(F.lit(1)).alias("pairs"),
                                  F.countDistinct("provider").alias("providers"))


@query("f5_sequence_ratio", """
SELECT reference_entry_id, provider_record_id,
       round(CASE WHEN lower(r.title) = lower(c.title) THEN 1 ELSE 2.0::DOUBLE * length(r.title) / (length(r.title) + length(c.title)) END, 6) AS ratio
FROM v_references r JOIN v_candidates c USING (reference_entry_id)""")
def f5(v):
    refs = v("v_references").select(REF, F.col("title").alias("rt"))
    pairs = refs.join(v("v_candidates").select(REF, "provider_record_id", "title"), REF)
    return pairs.select(REF, "provider_record_id", F.round(
        L.sequence_ratio(F.col("rt"), F.col("title")), 6).alias("ratio"))


def _one_feature(name, column, text=False):
    @query(name, FEATURES + f"SELECT reference_entry_id, provider_record_id, "
                 + (f"{column} AS value FROM f" if text else f"round({column}, 6) AS value FROM f"))
    def build(v):
        if text:
            value = F.array_join("hard_conflicts", ",")
        else:
            value = F.round(column, 6)
        return _features(v).select(REF, "provider_record_id", value.alias("value"))


_one_feature("f6_author_overlap", "author_score")
_one_feature("f7_year_proximity", "year_score")
_one_feature("f8_venue_score", "venue_score")
_one_feature("f9_identifier_match", "identifier_score")
_one_feature("f9_identifier_conflicts", "conflicts", text=True)


@query("r13_resolution_features", FEATURES + """
SELECT reference_entry_id, provider, provider_record_id, identifier_score, round(title_score, 6) AS title_score,
       round(author_score, 6) AS author_score, year_score, venue_score, round(agreement, 6) AS agreement, conflicts FROM f""")
def r13(v):
    return _features(v).select(
        REF, "provider", "provider_record_id", "identifier_score",
        F.round("title_score", 6).alias("title_score"), F.round("author_score", 6).alias("author_score"),
        "year_score", "venue_score", F.round("provider_agreement_score", 6).alias("agreement"),
        F.array_join("hard_conflicts", ",").alias("conflicts"))


@query("r14_identity_score", FEATURES + """
SELECT reference_entry_id, provider_record_id, round(score, 6) AS score FROM sc""")
def r14(v):
    return _scored(v).select(REF, "provider_record_id", F.round("score", 6).alias("score"))


@query("w3_top_and_margin", DECISIONS + """
SELECT reference_entry_id, round(top_score, 6) AS top_score, round(margin, 6) AS margin, provider_record_id FROM bm""")
def w3(v):
    return R.best_and_margin(_scored(v)).select(
        REF, F.round("top_score", 6).alias("top_score"), F.round("margin", 6).alias("margin"),
        "provider_record_id")


@query("r15_resolution_decision", DECISIONS + """
SELECT reference_entry_id, status, selected_candidate_id, round(top_score, 6) AS absolute_score,
       round(margin, 6) AS score_margin, reason_code, status = 'ambiguous' AS requires_human_review FROM dec""")
def r15(v):
    return _decisions(v).withColumn("absolute_score", F.round("absolute_score", 6)).withColumn(
        "score_margin", F.round("score_margin", 6))


_UUID = r"regexp_replace(md5({0}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


@query("f13_md5_uuid", f"SELECT provider_record_id, {_UUID.format('provider_record_id')} AS id FROM v_candidates")
def f13(v):
    return v("v_candidates").select("provider_record_id", T.md5_uuid(F.col("provider_record_id")).alias("id"))


@query("j9_selected_candidate", DECISIONS + f"""
SELECT reference_entry_id, selected_candidate_id, {_UUID.format('provider_record_id')} AS work_version_id
FROM dec WHERE status = 'resolved'""")
def j9(v):
    return R.selected_versions(_decisions(v), R.first_wins(_candidates(v))).select(
        REF, "selected_candidate_id", "work_version_id")


@query("a1_resolution_summary", DECISIONS + """
SELECT document_id, count(*) AS total, count(*) FILTER (WHERE status = 'resolved') AS resolved,
       count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE status = 'unresolved') AS unresolved
FROM dec GROUP BY document_id""")
def a1(v):
    owners = v("v_references").select(REF, "document_id")
    return R.resolution_summary(_decisions(v).join(owners, REF), ["document_id"])


_GRAMS = """list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substring(concat('  ', {0}, ' '), i, 3)))"""


def _key(column: str) -> str:
    return f"regexp_replace(regexp_replace(lower({column}), '^{_WS}|{_WS}$', '', 'g'), '{_WS}', ' ', 'g')"


@query("j2_candidate_generation", f"""
WITH r AS (SELECT page_id AS reference_entry_id, doi, {_key('title')} AS t, concat('w', CAST(page_id AS VARCHAR)) AS own,
           CASE WHEN page_id % 7 < 2 THEN concat('w', CAST(page_id AS VARCHAR)) END AS openalex,
           concat('2101.', CAST(page_id AS VARCHAR)) AS arxiv, concat('a', CAST(page_id % 4 AS VARCHAR)) AS hint FROM v_titles),
w AS (SELECT CASE page_id % 3 WHEN 0 THEN 'crossref' WHEN 1 THEN 'openalex' ELSE 'semanticscholar' END AS provider, concat('w', CAST(page_id AS VARCHAR)) AS provider_record_id,
      CASE WHEN page_id % 6 < 3 THEN doi END AS doi, CASE WHEN page_id % 5 < 2 THEN concat('2101.', CAST(page_id AS VARCHAR)) END AS arxiv,
      concat('a', CAST(page_id // 2 % 4 AS VARCHAR)) AS author, {_key('heading')} AS t FROM v_titles),
ex AS (
  SELECT reference_entry_id, w.provider, provider_record_id, 'doi' AS match FROM r JOIN w ON w.provider = 'crossref' AND r.doi = w.doi
  UNION ALL
  SELECT reference_entry_id, w.provider, provider_record_id,
         CASE WHEN w.provider = 'openalex' AND openalex IS NOT NULL THEN 'native' WHEN r.doi IS NOT NULL THEN 'doi' ELSE 'arxiv' END
  FROM r JOIN w ON w.provider <> 'crossref' AND CASE WHEN w.provider = 'openalex' AND openalex IS NOT NULL THEN openalex = provider_record_id
       WHEN r.doi IS NOT NULL THEN r.doi = w.doi ELSE r.arxiv = w.arxiv END),
rt AS (SELECT t, {_GRAMS.format('t')} AS g FROM (SELECT DISTINCT t FROM r WHERE t <> '')),
wt AS (SELECT t, {_GRAMS.format('t')} AS g FROM (SELECT DISTINCT t FROM w WHERE t <> '')),
sim AS (SELECT rt.t AS rt, wt.t AS wt, round(len(list_intersect(rt.g, wt.g))::DOUBLE / (len(rt.g) + len(wt.g) - len(list_intersect(rt.g, wt.g))), 6) AS s
        FROM rt, wt WHERE len(list_intersect(rt.g, wt.g)) > 0),
ti AS (SELECT * FROM (SELECT r.reference_entry_id, w.provider, w.provider_record_id, s, row_number() OVER (
         PARTITION BY r.reference_entry_id, w.provider ORDER BY s DESC, w.provider = 'crossref' AND author = hint DESC, w.provider_record_id) AS rank
       FROM r JOIN sim ON r.t = sim.rt JOIN w ON w.t = sim.wt) WHERE rank <= 5)
SELECT reference_entry_id, provider, provider_record_id, match, NULL::DOUBLE AS similarity, 1 AS result_rank FROM ex
UNION ALL
SELECT reference_entry_id, provider, provider_record_id, 'title', s, rank FROM ti
WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.reference_entry_id = ti.reference_entry_id AND ex.provider = ti.provider)""")
def j2(v):
    page = F.col("page_id")
    own, arxiv = F.concat(F.lit("w"), page.cast("string")), F.concat(F.lit("2101."), page.cast("string"))
    name = lambda n: F.array(F.concat(F.lit("Ann a"), n.cast("string")))
    references = v("v_titles").select(
        page.alias(REF), "title", "doi", arxiv.alias("arxiv"), F.when(page % 7 < 2, own).alias("openalex"),
        name(page % 4).alias("authors"))
    works = v("v_titles").select(
        F.when(page % 3 == 0, "crossref").when(page % 3 == 1, "openalex").otherwise("semanticscholar").alias("provider"),
        own.alias("provider_record_id"), F.col("heading").alias("title"), F.when(page % 6 < 3, F.col("doi")).alias("doi"),
        F.when(page % 5 < 2, arxiv).alias("arxiv"), name(F.expr("page_id DIV 2 % 4")).alias("authors"))
    return R.generate_candidates(references, works).select(
        REF, "provider", "provider_record_id", "match", "similarity", "result_rank")


@query("w6_current_resolution", """
SELECT aggregate_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY occurred_at DESC, event_id DESC) AS rn FROM v_outbox) WHERE rn = 1""")
def w6(v):
    return R.current_rows(v("v_outbox"), "aggregate_id", ["occurred_at", "event_id"]).select(
        "aggregate_id", "event_id", "event_type")


POLICY = """
CASE WHEN is_oa AND host_type = 'publisher' THEN 'publisher_open_full_text' WHEN is_oa AND host_type = 'repository' THEN 'repository_manuscript'
     WHEN is_oa THEN 'open_access_full_text' WHEN has_abstract THEN 'abstract_only' ELSE {last} END"""


@query("p6_acquisition_policy", f"""
SELECT asset_id, {POLICY.format(last="CASE WHEN asset_id % 8 < 6 THEN 'metadata_only' ELSE 'not_accessible' END")} AS access_level,
       CASE WHEN is_oa AND host_type = 'publisher' THEN 'PUBLISHER_OA' WHEN is_oa AND host_type = 'repository' THEN 'REPOSITORY_OA'
            WHEN is_oa THEN 'OA_UNKNOWN_HOST' WHEN has_abstract THEN 'ABSTRACT_AVAILABLE'
            WHEN asset_id % 8 < 6 THEN 'METADATA_AVAILABLE' ELSE 'PAYWALLED' END AS reason_code,
       CASE WHEN NOT is_oa AND NOT has_abstract AND asset_id % 8 >= 6 THEN 0 ELSE 30 END AS retention_days
FROM v_assets""")
def p6(v):
    rule = R.acquisition_policy(F.lit(False), F.col("is_oa"), F.col("host_type"), F.col("has_abstract"),
                                F.col("asset_id") % 8 < 6, F.lit(30))
    return v("v_assets").select("asset_id", rule.alias("p")).select(
        "asset_id", "p.access_level", "p.reason_code", "p.retention_days")


def _requests(assets):
    return assets.select(
        "workspace_id", F.col("asset_id").alias("work_version_id"), "is_oa", "host_type", "has_abstract",
        F.col("url").alias("proposed_url"), F.col("url").startswith("https").alias("fetch_ok"))


def _existing(assets):
    return assets.where("deleted").select(
        "workspace_id", F.col("asset_id").alias("work_version_id"),
        F.col("access_level").alias("existing_level"), F.lit("user_upload").alias("existing_method"))


OUTCOME = f"""
SELECT workspace_id, asset_id AS work_version_id,
  CASE WHEN deleted THEN access_level WHEN is_oa AND starts_with(url, 'https') THEN policy_level
       WHEN is_oa THEN CASE WHEN has_abstract THEN 'abstract_only' ELSE 'metadata_only' END
       WHEN has_abstract THEN 'abstract_only' ELSE 'metadata_only' END AS access_level,
  CASE WHEN deleted THEN 'user_upload' WHEN is_oa AND starts_with(url, 'https') THEN 'unpaywall_oa'
       WHEN has_abstract THEN 'abstract_fallback' ELSE 'metadata_fallback' END AS acquisition_method,
  CASE WHEN deleted OR (is_oa AND starts_with(url, 'https')) THEN NULL WHEN has_abstract THEN 'Full text unavailable'
       ELSE 'Full text and abstract unavailable' END AS limitation
FROM (SELECT *, {POLICY.format(last="'metadata_only'")} AS policy_level FROM v_assets)"""


@query("p7_acquisition_outcome", OUTCOME)
def p7(v):
    return R.acquisition_outcome(_requests(v("v_assets")), _existing(v("v_assets")))


_ACCESS = """count(*) FILTER (WHERE access_level IN ('open_access_full_text', 'publisher_open_full_text', 'repository_manuscript')) AS full_text_available,
  count(*) FILTER (WHERE access_level = 'abstract_only') AS abstract_only,
  count(*) FILTER (WHERE access_level NOT IN ('open_access_full_text', 'publisher_open_full_text', 'repository_manuscript', 'abstract_only')) AS not_accessible"""


@query("a2_source_access_summary", f"SELECT workspace_id, {_ACCESS} FROM v_assets GROUP BY workspace_id")
def a2(v):
    return R.access_summary(v("v_assets"), ["workspace_id"])


# Source situation of a resolved work, derived from its reference number.
ACCESS_OF_REF = """CASE CAST(reference_entry_id % 4 AS INT) WHEN 0 THEN 'open_access_full_text' WHEN 1 THEN 'abstract_only'
  WHEN 2 THEN 'repository_manuscript' ELSE 'metadata_only' END"""
LIMITS = DECISIONS + f""",
ac AS (SELECT *, CASE WHEN status = 'resolved' THEN {ACCESS_OF_REF} END AS access_level FROM dec),
li AS (SELECT reference_entry_id, document_id,
   CASE WHEN status = 'ambiguous' THEN 'reference_ambiguous' WHEN status = 'unresolved' THEN 'reference_unresolved'
        WHEN access_level = 'abstract_only' THEN 'source_abstract_only' WHEN access_level = 'metadata_only' THEN 'source_not_accessible' END AS code,
   CASE WHEN status = 'ambiguous' THEN 'user_resolution_required' WHEN status = 'resolved' THEN 'upload_full_text' END AS recoverable_action
   FROM ac)
"""


@query("p18_limitation_rows", LIMITS + """
SELECT reference_entry_id, code, recoverable_action FROM li WHERE code IS NOT NULL""")
def p18(v):
    rows = _decisions(v).withColumn(
        "access_level", F.expr(f"CASE WHEN status = 'resolved' THEN {ACCESS_OF_REF} END"))
    return R.limitation_rows(rows)


@query("k1_reference_resolution_job", LIMITS + f"""
SELECT document_id, count(*) AS total, count(*) FILTER (WHERE status = 'resolved') AS resolved,
       count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE status = 'unresolved') AS unresolved,
       {_ACCESS}, (SELECT count(code) FROM li WHERE li.document_id = ac.document_id) AS limitations
FROM ac GROUP BY document_id""")
def k1(v):
    refs = v("v_references")
    candidates = R.first_wins(_candidates(v))
    # the decisions feed four results below, so they are computed once
    decisions = through_table(
        R.decide(refs, R.identity_score(R.resolution_features(refs, candidates))), "decisions")
    chosen = R.selected_versions(decisions, candidates)
    # acquisition: the fetch result is an input column; here every open copy was fetched
    place = F.expr("CAST(reference_entry_id % 4 AS INT)")
    requests = chosen.select(
        REF, F.lit("ws").alias("workspace_id"), "work_version_id",
        place.isin(0, 2).alias("is_oa"),
        F.when(place == 2, "repository").otherwise("other").alias("host_type"),
        (place == 1).alias("has_abstract"), F.col("doi").alias("proposed_url"),
        place.isin(0, 2).alias("fetch_ok"))
    none_yet = requests.select(
        "workspace_id", "work_version_id", F.lit("").alias("existing_level"),
        F.lit("").alias("existing_method")).where("existing_level <> ''")
    outcome = R.acquisition_outcome(requests.drop(REF), none_yet).select(
        "work_version_id", "access_level")
    level = chosen.select(REF, "work_version_id").join(outcome, "work_version_id").select(REF, "access_level")
    rows = decisions.join(level, REF, "left").join(refs.select(REF, "document_id"), REF)
    rows = through_table(rows, "resolved")
    limits = R.limitation_rows(rows).join(refs.select(REF, "document_id"), REF)
    return (
        R.resolution_summary(rows, ["document_id"])
        .join(R.access_summary(rows, ["document_id"]), "document_id")
        .join(limits.groupBy("document_id").agg(F.count(F.lit(1)).alias("limitations")), "document_id", "left")
        .withColumn("limitations", F.coalesce("limitations", F.lit(0)))
    )
