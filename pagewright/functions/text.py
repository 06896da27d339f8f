"""Small text functions that the checks share, on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import LEADING_NUMBER, TYPED_NUMBER

PREVIEW = 45


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def preview(c: Column, limit: int = PREVIEW) -> Column:
    s = strip(c)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)


def normal_heading(c: Column) -> Column:
    """Lower case, without a leading number or outer white space."""
    return strip(F.regexp_replace(F.lower(strip(c)), "(?U)" + LEADING_NUMBER, ""))


def has_typed_number(c: Column) -> Column:
    return c.rlike("(?U)" + TYPED_NUMBER)


def starts_like_number(c: Column) -> Column:
    """A letter or digit comes first, not a bullet."""
    return c.rlike(r"(?U)^\s*[\p{L}\p{N}]")


def normal_name(name: str) -> str:
    return re.sub(LEADING_NUMBER, "", name.strip().lower()).strip()


def accepted_names(section: dict) -> list[str]:
    return sorted({normal_name(n) for n in section.get("accept", [section["name"]])})
