"""Provider records to one candidate schema (S3a-S3d, U1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions import text as T

CROSSREF = """status STRING, message STRUCT<items: ARRAY<STRUCT<title: ARRAY<STRING>,
author: ARRAY<STRUCT<family: STRING, given: STRING>>, issued: STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>,
`container-title`: ARRAY<STRING>, DOI: STRING, abstract: STRING>>>"""
OPENALEX = """id STRING, title STRING, publication_year INT,
authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>,
primary_location STRUCT<source: STRUCT<display_name: STRING>>, doi STRING"""
SEMANTIC_SCHOLAR = """paperId STRING, title STRING, year INT, venue STRING,
authors ARRAY<STRUCT<name: STRING>>, externalIds STRUCT<DOI: STRING, ArXiv: STRING>"""
OPEN_ACCESS = """doi STRING, is_oa BOOLEAN, oa_status STRING, title STRING,
best_oa_location STRUCT<url: STRING, url_for_pdf: STRING, license: STRING, version: STRING,
host_type: STRING, is_best: BOOLEAN>"""


def _candidate(keys: list[str], provider: str, **cols: Column) -> list[Column]:
    return [
        *[F.col(k) for k in keys],
        F.lit(provider).alias("provider"),
        F.coalesce(cols["record_id"], F.lit("")).alias("provider_record_id"),
        cols["title"].alias("title"),
        T.title_key(cols["title"]).alias("normalized_title"),
        T.author_list(cols["authors"]).alias("authors"),
        cols["year"].alias("year"),
        cols["venue"].alias("venue"),
        T.doi(cols["doi"]).alias("doi"),
        cols["arxiv"].alias("arxiv"),
    ]


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def crossref(replies: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """One row per item of an ``ok`` reply; ``result_rank`` keeps the reply order."""
    parsed = replies.select(*keys, F.from_json(json_col, CROSSREF).alias("r")).where(
        F.col("r.status") == "ok"
    )
    items = parsed.select(*keys, F.posexplode("r.message.items").alias("pos", "i"))
    i = F.col("i")
    authors = F.filter(
        F.transform(
            F.coalesce(i["author"], F.array().cast("array<struct<family:string,given:string>>")),
            lambda a: F.when(
                (a.family != "") & (a.given != ""), F.concat(a.given, F.lit(" "), a.family)
            ).when(a.family != "", a.family),
        ),
        lambda name: name.isNotNull(),
    )
    none = F.lit(None).cast("string")
    return items.select(
        (F.col("pos") + 1).alias("result_rank"),
        *_candidate(
            keys, "crossref",
            record_id=i["DOI"], title=F.coalesce(F.get(i["title"], F.lit(0)), F.lit("Unknown Title")),
            authors=authors, year=F.get(F.get(i["issued"]["date-parts"], F.lit(0)), F.lit(0)),
            venue=F.get(i["container-title"], F.lit(0)), doi=_filled(i["DOI"]), arxiv=none,
        ),
    )


def openalex(records: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """One record per row; resolver prefixes of ids are removed."""
    rows = records.select(*keys, F.from_json(json_col, OPENALEX).alias("r"))
    r = F.col("r")
    names = F.transform(
        F.coalesce(r["authorships"], F.array().cast("array<struct<author:struct<display_name:string>>>")),
        lambda a: a.author.display_name,
    )
    record_id = F.replace(r["id"], F.lit("https://openalex.org/"), F.lit(""))
    return rows.select(
        F.lit(1).alias("result_rank"),
        *_candidate(
            keys, "openalex", record_id=record_id,
            title=F.coalesce(_filled(r["title"]), F.lit("Unknown Title")),
            authors=F.filter(names, lambda n: n != ""), year=r["publication_year"],
            venue=r["primary_location"]["source"]["display_name"],
            doi=F.replace(r["doi"], F.lit("https://doi.org/"), F.lit("")),
            arxiv=F.lit(None).cast("string"),
        ),
    )


def semantic_scholar(records: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """One record per row with DOI and arXiv id."""
    rows = records.select(*keys, F.from_json(json_col, SEMANTIC_SCHOLAR).alias("r"))
    r = F.col("r")
    names = F.transform(
        F.coalesce(r["authors"], F.array().cast("array<struct<name:string>>")), lambda a: a["name"]
    )
    return rows.select(
        F.lit(1).alias("result_rank"),
        *_candidate(
            keys, "semantic_scholar", record_id=r["paperId"],
            title=F.coalesce(_filled(r["title"]), F.lit("Unknown Title")),
            authors=F.filter(names, lambda n: n != ""), year=r["year"], venue=r["venue"],
            doi=r["externalIds"]["DOI"], arxiv=r["externalIds"]["ArXiv"],
        ),
    )


def open_access(records: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """S3d: open-access flags and the URL to fetch (PDF link first)."""
    rows = records.select(*keys, F.from_json(json_col, OPEN_ACCESS).alias("r"))
    best = F.col("r.best_oa_location")
    open_copy = F.coalesce(F.col("r.is_oa"), F.lit(False)) & best.isNotNull()
    return rows.select(
        *keys, F.col("r.doi").alias("doi"), F.col("r.is_oa").alias("is_oa"),
        best["host_type"].alias("host_type"), best["license"].alias("license"),
        best["version"].alias("version"), open_copy.alias("open_copy"),
        F.when(open_copy, F.coalesce(_filled(best["url_for_pdf"]), best["url"])).alias("proposed_url"),
    )


def union_candidates(*frames: DataFrame) -> DataFrame:
    """Bag union; a provider that failed is simply left out by the caller."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
