"""Comparison features of a reference and a provider candidate."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def ratio(x, y):
        if x is None or y is None:
            return None
        return difflib.SequenceMatcher(None, x, y).ratio()

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of lower-cased texts, 0 when either is missing or empty.

    Equal texts are 1 by definition, so only differing pairs carry text to the Arrow function.
    """
    x, y = F.lower(a), F.lower(b)
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    same = x == y
    work = ~missing & ~same
    return (
        F.when(missing, F.lit(0.0))
        .when(same, F.lit(1.0))
        .otherwise(_matching_blocks_ratio(F.when(work, x), F.when(work, y)))
    )


def author_overlap(ref: Column, cand: Column) -> Column:
    """reference authors contained in any candidate author, over the longer list."""
    hits = F.size(
        F.filter(ref, lambda a: F.exists(cand, lambda c: F.contains(F.lower(c), F.lower(a))))
    )
    longest = F.greatest(F.size(ref), F.size(cand))
    empty = (F.coalesce(F.size(ref), F.lit(0)) <= 0) | (F.coalesce(F.size(cand), F.lit(0)) <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(hits.cast("double") / longest)


def year_proximity(ref: Column, cand: Column) -> Column:
    """1 / .8 / .5 / 0 for a gap of 0 / 1 / 2 / more; a missing or zero year scores 0."""
    gap = F.abs(ref - cand)
    known = (F.coalesce(ref, F.lit(0)) != 0) & (F.coalesce(cand, F.lit(0)) != 0)
    return (
        F.when(known & (gap == 0), F.lit(1.0))
        .when(known & (gap == 1), F.lit(0.8))
        .when(known & (gap == 2), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def first_year(value: Column) -> Column:
    """First four digits of a raw date such as ``2020-05``; NULL when there are none."""
    return F.regexp_extract(value, r"(\d{4})", 1).try_cast("int")


def venue_contained(ref: Column, cand: Column) -> Column:
    a, b = F.lower(ref), F.lower(cand)
    return F.coalesce(F.contains(a, b) | F.contains(b, a), F.lit(False))


def venue_score(ref: Column, cand: Column) -> Column:
    """F8: containment either way is 1, otherwise F5."""
    known = (F.coalesce(ref, F.lit("")) != "") & (F.coalesce(cand, F.lit("")) != "")
    inside = venue_contained(ref, cand)
    other = known & ~inside
    return F.when(known & inside, F.lit(1.0)).otherwise(
        sequence_ratio(F.when(other, ref), F.when(other, cand))
    )


def identifier_score(ref_doi: Column, cand_doi: Column, ref_arxiv: Column,
                     cand_arxiv: Column) -> Column:
    """1 when DOI or arXiv id agree, letter case ignored."""

    def agree(a: Column, b: Column) -> Column:
        return F.coalesce((a != "") & (F.lower(a) == F.lower(b)), F.lit(False))

    return F.when(agree(ref_doi, cand_doi) | agree(ref_arxiv, cand_arxiv), F.lit(1.0)).otherwise(
        F.lit(0.0)
    )


def identifier_conflicts(ref_doi: Column, cand_doi: Column, ref_arxiv: Column,
                         cand_arxiv: Column) -> Column:
    """codes of identifiers that both sides carry and that differ."""

    def differ(a: Column, b: Column, code: str) -> Column:
        return F.when((a != "") & (b != "") & (F.lower(a) != F.lower(b)), F.lit(code))

    return F.array_compact(
        F.array(
            differ(ref_doi, cand_doi, "doi_conflict"),
            differ(ref_arxiv, cand_arxiv, "arxiv_conflict"),
        )
    )
