"""Patterns of typed structure, as Python regular expressions and as Spark predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as typed structure.
MARKER = r"[-•*·▪–]\s+|\d+[.)]\s+|[a-z][.)]\s+"
OPERATORS = "+*/·∙×^√∑∫≤≥≈"
EQUATION = rf"=[^=]*[{OPERATORS}]|[{OPERATORS}][^=]*="
LEADING_NUMBER = r"^\s*\d+(\.\d+)*[.):]?\s*"
TYPED_NUMBER = r"^\s*\d+(\.\d+)*([.):]|\s)"


@dataclass(frozen=True)
class Patterns:
    """caption, list_item: pattern sources; kinds: kind by lower-case label."""

    caption: str
    list_item: str
    kinds: dict[str, str]

    def caption_kind(self, text: str) -> str | None:
        m = re.match(self.caption, text, re.IGNORECASE)
        return self.kinds.get(m[1].lower()) if m else None

    def is_list_item(self, text: str) -> bool:
        return bool(re.match(self.list_item, text))

    def is_equation(self, text: str) -> bool:
        return bool(re.search(EQUATION, text))

    def typed(self, text: str) -> tuple[str, str | None]:
        """Type and kind of a paragraph by its text alone."""
        if re.match(self.caption, text, re.IGNORECASE):
            return "caption", self.caption_kind(text)
        if self.is_list_item(text):
            return "list_item", None
        return ("equation", None) if self.is_equation(text) else ("paragraph", None)

    def caption_column(self, text: Column) -> Column:
        return text.rlike("(?iU)" + self.caption)

    def kind_column(self, text: Column) -> Column:
        label = F.lower(F.regexp_extract(text, "(?iU)" + self.caption, 1))
        out = F.lit(None).cast("string")
        for name, kind in self.kinds.items():
            out = F.when(label == name, kind).otherwise(out)
        return out

    def list_column(self, text: Column) -> Column:
        return text.rlike("(?U)" + self.list_item)

    def typed_column(self, text: Column) -> Column:
        """struct(type, kind), the same cascade as typed()."""
        of = lambda t, k=None: F.struct(F.lit(t).alias("type"), (F.lit(None).cast("string") if k is None else k).alias("kind"))
        return F.when(self.caption_column(text), of("caption", self.kind_column(text))).when(self.list_column(text), of("list_item")).when(equation_column(text), of("equation")).otherwise(of("paragraph"))


def equation_column(text: Column) -> Column:
    return text.rlike(EQUATION)


def compile_patterns(styles: dict) -> Patterns:
    """Labels are taken as patterns, as they are given."""
    kinds = {label.lower(): kind for kind, labels in styles["captions"]["labels"].items() for label in labels}
    return Patterns(rf"^\s*({'|'.join(kinds)})\s+\d+", rf"^\s*(?:{MARKER}|(?:{'|'.join(styles['lists']['labels'])})\d+[.:)]?\s*)", kinds)
