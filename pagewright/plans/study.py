"""Rows of a user study: what a participant's document was found to have, and how the tool was judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .run import LABELS, dense_counts, ueq_scores

# The items of the short questionnaire, in order, with their scales, and the sheet's other columns.
ITEMS = [
    ("obstructive", "supportive", "pragmatic"), ("complicated", "easy", "pragmatic"), ("inefficient", "efficient", "pragmatic"), ("confusing", "clear", "pragmatic"),
    ("boring", "exciting", "hedonic"), ("not interesting", "interesting", "hedonic"), ("conventional", "inventive", "hedonic"), ("usual", "leading edge", "hedonic"),
]
FIRST = ["Time", "Participant ID", "File name", "Result", "Total issues"]
SCORES = {"pragmatic": "Pragmatic Quality (1-7)", "hedonic": "Hedonic Quality (1-7)"}


def item_names() -> list[str]:
    return [f"{left.capitalize()} - {right.capitalize()}" for left, right, _ in ITEMS]


def columns() -> list[str]:
    return [*FIRST, *LABELS.values(), *item_names(), *SCORES.values()]


def study_rows(sessions: DataFrame, docs: DataFrame, issues: DataFrame, answers: DataFrame) -> DataFrame:
    """One row (columns()) for each of sessions whose participant has answered all items.

    sessions: participant, doc_id, time; answers: participant, item (its place in ITEMS, from 0), answer.
    """
    counts = dense_counts(docs, issues)
    total = sum((F.col(f"`{c}`") for c in LABELS), F.lit(0))
    scaled = answers.join(F.broadcast(answers.sparkSession.createDataFrame([(i, x[2]) for i, x in enumerate(ITEMS)], "item int, scale string")), "item")
    wide = answers.groupBy("participant").agg(*(F.max(F.when(F.col("item") == i, F.col("answer"))).alias(f"a{i}") for i in range(len(ITEMS))))
    found = counts.withColumn("total", total).join(docs.select("doc_id", "path"), "doc_id")
    rows = sessions.join(found, "doc_id").join(ueq_scores(scaled), "participant").join(wide, "participant")
    result = F.when(F.col("total") == 0, "Passed").otherwise(F.format_string("%d issue(s)", "total"))
    first = [F.date_format("time", "yyyy-MM-dd HH:mm 'UTC'"), F.col("participant"), F.regexp_extract("path", r"[^/]*$", 0), result, F.col("total")]
    return rows.select(
        *(c.alias(n) for c, n in zip(first, FIRST, strict=True)), *(F.col(f"`{c}`").alias(label) for c, label in LABELS.items()),
        *(F.col(f"a{i}").alias(n) for i, n in enumerate(item_names())), *(F.col(s).alias(n) for s, n in SCORES.items()),
    )


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds the rows to a folder of CSV files, each with the header."""
    rows.select(*(f"`{c}`" for c in columns())).write.mode("append").option("header", True).csv(path)
