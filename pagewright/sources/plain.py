"""Plain text: each line that isn't empty is a block, classified by its text alone. Native columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Patterns


def plain_blocks(docs: DataFrame, patterns: Patterns) -> DataFrame:
    """Blocks of docs (columns doc_id, text); no shuffle, as a document's lines stay in its row."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(lines).alias("index", "text"))
    return rows.select("doc_id", "index", "text", patterns.typed_column(F.col("text")).alias("t")).select("doc_id", "index", "t.type", "text", "t.kind")
