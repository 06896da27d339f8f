"""Reports: one text or JSON document for each document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview

# The layout of a text report.
TITLE, CLEAN, COUNT, PLACE, WHOLE = "%s: %s", "No structural issues found.", "%s issue(s) found.", "block %s", "document"


def _collected(docs: DataFrame, issues: DataFrame, item) -> DataFrame:
    rows = issues.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("check_ord", "item_ord", item.alias("x")))).alias("found"))
    return docs.select("doc_id", "path").join(rows, "doc_id", "left").withColumn("found", F.coalesce(F.transform("found", lambda r: r["x"]), F.array()))


def text_reports(docs: DataFrame, issues: DataFrame, program: str = "pagewright") -> DataFrame:
    """doc_id, report: the lines of a report joined by line ends."""
    place = F.when(F.col("block_index").isNull(), WHOLE).otherwise(F.format_string(PLACE, "block_index"))
    line = F.format_string("  [%s]  (%s)  %s", "check", place, "message")
    rows = _collected(docs, issues, line)
    n = F.size("found")
    head = F.format_string(TITLE, F.lit(program), "path")
    body = F.when(n == 0, F.concat_ws("\n", head, F.lit(CLEAN))).otherwise(F.concat_ws("\n", head, F.format_string(COUNT, n), F.lit(""), F.array_join("found", "\n")))
    return rows.select("doc_id", body.alias("report"))


def json_reports(docs: DataFrame, issues: DataFrame, checks_run: list[str]) -> DataFrame:
    """doc_id, report: compact JSON with null block_index kept."""
    rows = _collected(docs, issues, F.struct("check", "message", "block_index", "text"))
    whole = F.struct(F.col("path").alias("file"), F.array(*map(F.lit, checks_run)).alias("checks_run"), (F.size("found") == 0).alias("passed"), F.col("found").alias("issues"))
    return rows.select("doc_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))


def block_lines(blocks: DataFrame) -> DataFrame:
    """doc_id, index, line: what a reader found, a line for each block."""
    level = F.coalesce(F.concat(F.lit("L"), F.col("level").cast("string")), F.lit(""))
    origin = F.when(F.col("real"), "real").when(~F.col("real"), "typed")
    notes = F.concat_ws(", ", F.when(F.col("numbered"), "numbered"), "kind", origin, F.when(F.col("inline"), "in text"))
    line = F.format_string("%5d  %-9s  %-3s  %s%s", "index", "type", level, preview(F.coalesce("text", F.lit(""))), F.when(notes == "", "").otherwise(F.concat(F.lit("  ("), notes, F.lit(")"))))
    return blocks.select("doc_id", "index", F.rtrim(line).alias("line"))


def indented(report: str) -> str:
    return json.dumps(json.loads(report), indent=2, ensure_ascii=False)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("doc_id", "report").write.mode("append").json(path)
