"""Columns of the tables: one row per document, per block in reading order, and per issue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

BLOCK = "index int, type string, text string, style_name string, level int, numbered boolean, numbering_optional boolean, kind string, real boolean, inline boolean"
DOCS = "doc_id long, path string, format string, toc_present boolean, toc_anchors array<string>, heading_bookmarks array<string>"
BLOCKS = "doc_id long, " + BLOCK
ERRORS = "doc_id long, path string, format string, error string"


@dataclass(frozen=True)
class Corpus:
    """docs (DOCS) and blocks (BLOCKS), in the order of doc_id and index; errors (ERRORS): files that couldn't be read."""

    docs: DataFrame
    blocks: DataFrame
    errors: DataFrame | None = None
