"""Conversations as documents: each turn is a block, in the order of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Patterns


def conversation_blocks(turns: DataFrame, patterns: Patterns) -> DataFrame:
    """Blocks of turns (columns conv_id, turn, role, text): the turn is the index, the role the style's name.

    A turn is classified by its text alone, so nothing but a paragraph is real. Null text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("doc_id"), F.col("turn").cast("int").alias("index"), text.alias("text"), F.col("role").alias("style_name"), patterns.typed_column(text).alias("t"))
    nothing = F.lit(None).cast("int").alias("level"), F.lit(False).alias("numbered"), F.lit(False).alias("numbering_optional")
    return rows.select("doc_id", "index", "t.type", "text", "style_name", *nothing, "t.kind", F.when(F.col("t.type") != "paragraph", False).alias("real"), F.lit(False).alias("inline"))
