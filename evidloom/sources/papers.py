"""Structured-paper XML into reference, citation-cluster and section tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

TEI = "{http://www.tei-c.org/ns/1.0}"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"

TABLES = ("refs", "clusters", "sections")
OUT_BYTES = 1 << 20

SCHEMA = """path STRING, error STRING,
refs ARRAY<STRUCT<xml_id: STRING, label: STRING, raw_reference: STRING, title: STRING, authors: ARRAY<STRING>,
  year: STRING, venue: STRING, identifiers: MAP<STRING, STRING>, coords: STRING>>,
clusters ARRAY<STRUCT<anchor_text: STRING, targets: ARRAY<STRING>, coords: STRING, parent_id: STRING>>,
sections ARRAY<STRUCT<xml_id: STRING, head: STRING, text: STRING>>"""


def _text(node) -> str | None:
    return None if node is None else "".join(node.itertext()).strip()


def _titled(entry, level: str):
    return next((t for t in entry.iter(f"{TEI}title") if t.get("level") == level), None)


def _reference(entry) -> dict:
    xml_id = entry.get(XML_ID) or ""
    people = [
        " ".join(part.strip() for part in person.itertext() if part.strip())
        for author in entry.iter(f"{TEI}author") for person in author.findall(f"{TEI}persName")
    ]
    dated = next((d for d in entry.iter(f"{TEI}date") if d.get("type") == "published"), None)
    # identifier types differ in letter case between producers, so keys are lower-cased
    ids = {i.get("type").lower(): _text(i) for i in entry.iter(f"{TEI}idno") if i.get("type")}
    return {
        "xml_id": xml_id, "label": f"[{xml_id}]", "raw_reference": _text(entry),
        "title": _text(_titled(entry, "a")), "authors": [p for p in people if p],
        "year": None if dated is None else dated.get("when"), "venue": _text(_titled(entry, "j")),
        "identifiers": ids, "coords": entry.get("coords"),
    }


def _marks(body) -> Iterator[dict]:
    for parent in body.iter():
        for node in parent.findall(f"{TEI}ref"):
            if node.get("type") == "bibr":
                yield {
                    "anchor_text": _text(node),
                    "targets": [t.lstrip("#") for t in (node.get("target") or "").split()],
                    "coords": node.get("coords"), "parent_id": parent.get(XML_ID),
                }


def _parse(content: bytes, tables: tuple[str, ...]) -> dict:
    # entity declarations are refused instead of expanded
    if b"<!ENTITY" in content:
        raise ValueError("entity declaration")
    root = ET.fromstring(content)
    bodies = list(root.iter(f"{TEI}body"))
    found = {
        "refs": lambda: [_reference(b) for lst in root.iter(f"{TEI}listBibl") for b in lst.findall(f"{TEI}biblStruct")],
        "clusters": lambda: [m for body in bodies for m in _marks(body)],
        "sections": lambda: [
            {"xml_id": d.get(XML_ID), "head": _text(d.find(f"{TEI}head")), "text": _text(d)}
            for body in bodies for d in body.findall(f"{TEI}div")
        ],
    }
    return {name: found[name]() for name in tables}


def _rows(batches: Iterator[pa.RecordBatch], kinds: pa.Schema, tables: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Parsed rows, given out whenever ``OUT_BYTES`` of content have been read: a parsed text stands in memory as
    Python objects, so no more than that is held."""
    out, held = [], 0
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            content, row = content.as_py() or b"", {"path": path.as_py(), "error": None, "refs": [], "clusters": [], "sections": []}
            try:
                row |= _parse(content, tables)
            except (ET.ParseError, ValueError) as exc:
                row["error"] = type(exc).__name__
            out.append(row)
            held += len(content)
            if held >= OUT_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=kinds)


def parse_papers(files: DataFrame, tables: tuple[str, ...] = TABLES) -> DataFrame:
    """One row per file with its three nested tables, or an error for a broken file.

    ``files`` carries path and content, as from the ``binaryFile`` source.  The mixed-content order
    of text needs a document parser, hence one pass of mapInArrow.  ``tables`` names those that are wanted; the others
    stay empty, every file is parsed whole all the same.
    """
    rows = files.select(F.col("path").cast("string"), F.col("content").cast("binary"))
    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], SCHEMA).schema)
    return rows.mapInArrow(lambda batches: _rows(batches, kinds, tables), SCHEMA)


def references(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("refs").alias("r")).select("path", "r.*")


def clusters(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("clusters").alias("position", "c")).select("path", "position", "c.*")


def sections(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("sections").alias("position", "s")).select("path", "position", "s.*")
