"""Queries over the driver's tables: documents are orders, their blocks are line items; and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STYLES, merge
from ..functions import patterns, text
from ..operators.checks import CHECKS, with_neighbours
from ..schema import Corpus
from ..sources.plain import plain_blocks
from . import reader_queries, report, run

STRUCTURE = {"sections": [{"name": "Small", "accept": ["small ring", "SMALL bolt"]}, {"name": "red widget"}, {"name": "blue bolt"}, {"name": "Never there"}]}
PATTERNS = patterns.compile_patterns(STYLES)

# One text for both engines: braces name the tables.
BLOCKS = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, p, s, d) - 1 AS INT) AS idx, type, level,
  numbered, numbering_optional, CASE WHEN type = 'caption' THEN CASE WHEN s % 2 = 0 THEN 'table' ELSE 'figure' END END AS kind, real, inline,
  CASE WHEN type IN ('table', 'figure') THEN ''
    WHEN type = 'heading' THEN CASE s % 4 WHEN 0 THEN '2.1 ' || name WHEN 1 THEN name WHEN 2 THEN '  3. ' || upper(name) ELSE '3D ' || name || ' and a title that runs on past the preview' END
    WHEN type = 'list_item' THEN CASE s % 4 WHEN 0 THEN '- ' || name WHEN 1 THEN 'RQ2: ' || name WHEN 2 THEN '1) ' || name ELSE name END
    WHEN type = 'caption' THEN CASE WHEN s % 2 = 0 THEN 'Table 3: ' ELSE 'Abbildung 12 ' END || name
    WHEN type = 'equation' THEN CASE s % 3 WHEN 0 THEN 'F1 = 2 * P' WHEN 1 THEN 'a + b = c' ELSE 'p = 0.05' END
    ELSE CASE s % 5 WHEN 0 THEN 'Figure 3 shows ' || name WHEN 1 THEN 'x = y / z' WHEN 2 THEN 'Table1 ' || name WHEN 3 THEN 'b) ' || name ELSE name END END AS text
FROM (
  SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_shipdate AS d, p_name AS name,
    CASE l_partkey % 9 WHEN 0 THEN 'heading' WHEN 1 THEN 'heading' WHEN 2 THEN 'paragraph' WHEN 3 THEN 'list_item' WHEN 4 THEN 'table' WHEN 5 THEN 'figure' WHEN 8 THEN 'equation' ELSE 'caption' END AS type,
    CAST(l_suppkey % 4 + 1 AS INT) AS level, l_returnflag <> 'R' AS numbered, l_linestatus = 'O' AS numbering_optional,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_suppkey % 3 <> 0 END AS real, l_quantity > 25 AS inline
  FROM {lineitem} JOIN {part} ON p_partkey = l_partkey)
"""
ANCHORS = """SELECT l_orderkey AS doc_id, '_Toc' || CAST(l_suppkey % 7 AS VARCHAR(9)) AS name FROM {lineitem} WHERE l_linenumber % 2 = 1"""
MARKS = """SELECT l_orderkey AS doc_id, '_Toc' || CAST(l_suppkey % 7 AS VARCHAR(9)) AS name FROM {lineitem} WHERE l_linenumber <> 3"""


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lineitem = table("lineitem")
    blocks = spark.sql(BLOCKS, lineitem=lineitem, part=table("part")).withColumnRenamed("idx", "index")
    lists = [spark.sql(q, lineitem=lineitem).groupBy("doc_id").agg(F.collect_list("name").alias(to)) for q, to in ((ANCHORS, "toc_anchors"), (MARKS, "heading_bookmarks"))]
    docs = table("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("/d/"), "o_orderkey", F.lit(".docx")).alias("path"), F.lit("docx").alias("format"), (F.col("o_orderstatus") != "P").alias("toc_present"))
    return Corpus(docs.join(lists[0], "doc_id", "left").join(lists[1], "doc_id", "left"), blocks)


def issues(spark: SparkSession, sf_dir: str, only: list[str] | None = None, styles: dict | None = None) -> DataFrame:
    return run.run_checks(corpus(spark, sf_dir), STRUCTURE, styles, only)


def _block_function(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(corpus(spark, sf_dir).blocks)


ALTERED = merge(STYLES, {"headings": {"first_level": 2, "max_deeper_step": 2}, "captions": {"table_position": "below", "figure_position": "above"}, "checks": {"toc-present": False, "list-formatting": False}})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"check_{c.replace('-', '_')}": (lambda s, d, c=c: issues(s, d, [c])) for c in CHECKS}
    both = lambda f: lambda s, d: f((c := corpus(s, d)).docs, run.run_checks(c, STRUCTURE))
    dense = lambda docs, i: run.dense_counts(docs, i).select("doc_id", *(F.col(f"`{c}`").alias(c.replace("-", "_")) for c in CHECKS))
    return out | reader_queries.queries() | {
        "run_checks": issues,
        "run_checks_altered_styles": lambda s, d: issues(s, d, styles=ALTERED),
        "issue_counts": lambda s, d: run.issue_counts(issues(s, d)),
        "checks_fired": lambda s, d: run.checks_fired(issues(s, d)).select("doc_id", F.array_join("checks", ",").alias("checks")),
        "dense_counts": both(dense),
        "status": both(run.status),
        "dashboard": both(run.dashboard),
        "text_reports": both(report.text_reports),
        "json_reports": both(lambda docs, i: report.json_reports(docs, i, CHECKS)),
        "typed_patterns": _block_function(lambda x: x.select("doc_id", "index", PATTERNS.caption_column(F.col("text")).alias("caption"), PATTERNS.kind_column(F.col("text")).alias("caption_kind"), PATTERNS.list_column(F.col("text")).alias("list_item"), patterns.equation_column(F.col("text")).alias("equation"), text.has_typed_number(F.col("text")).alias("numbered"))),
        "classify_text": _block_function(lambda x: x.select("doc_id", "index", PATTERNS.typed_column(F.col("text")).alias("t")).select("doc_id", "index", "t.type", "t.kind")),
        "text_functions": _block_function(lambda x: x.select("doc_id", "index", text.preview(F.col("text")).alias("preview"), text.normal_heading(F.col("text")).alias("heading"), text.starts_like_number(F.col("text")).alias("like_number"))),
        "neighbours": _block_function(lambda x: with_neighbours(x).select("doc_id", "index", "before_type", "after_type", "before_kind", "after_kind", "last_level")),
        "plain_text_blocks": lambda s, d: plain_blocks(s.read.parquet(f"{d}/documents.parquet"), PATTERNS).select("doc_id", "index", "type", "kind", "text"),
        "ueq_scores": lambda s, d: run.ueq_scores(s.read.parquet(f"{d}/lineitem.parquet").select(F.concat_ws("-", "l_orderkey", F.floor((F.col("l_linenumber") - 1) / 4)).alias("participant"), F.explode(F.array(F.struct(F.lit("pragmatic").alias("scale"), (F.col("l_suppkey") % 7 + 1).alias("answer")), F.struct(F.lit("hedonic").alias("scale"), (F.col("l_partkey") % 7 + 1).alias("answer")))).alias("a")).select("participant", "a.*")),
    }


# --- the same in SQL ---

_CTE = (
    "WITH b AS (" + BLOCKS + "), a AS (" + ANCHORS + "), m AS (" + MARKS + r"""),
d AS (SELECT o_orderkey AS doc_id, '/d/' || o_orderkey || '.docx' AS path, o_orderstatus <> 'P' AS toc FROM orders),
t AS (SELECT *, CASE WHEN length(trim(text)) > 45 THEN substr(trim(text), 1, 45) || '...' ELSE trim(text) END AS pv,
  trim(regexp_replace(lower(trim(text)), '^[ ]*[0-9]+([.][0-9]+)*[.):]?[ ]*', '')) AS nm,
  regexp_matches(text, '^[ ]*[0-9]+([.][0-9]+)*([.):]|[ ])') AS typed FROM b),
n AS (SELECT *, lag(type) OVER w AS bt, lag(kind) OVER w AS bk, lag(real) OVER w AS br, lag(pv) OVER w AS bp, lead(type) OVER w AS zt, lead(kind) OVER w AS zk, lead(real) OVER w AS zr, lead(pv) OVER w AS zp,
  last_value(CASE WHEN type = 'heading' THEN level END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
secs(ord, name) AS (VALUES (0, 'Small'), (1, 'red widget'), (2, 'blue bolt'), (3, 'Never there')),
names(ord, nm) AS (VALUES (0, 'small ring'), (0, 'small bolt'), (1, 'red widget'), (2, 'blue bolt'), (3, 'never there')),
f AS (SELECT doc_id, ord, min(idx) AS pos FROM t JOIN names USING (nm) WHERE type = 'heading' GROUP BY ALL),
g AS (SELECT f.*, name, lag(pos) OVER (PARTITION BY doc_id ORDER BY ord) AS pp, lag(name) OVER (PARTITION BY doc_id ORDER BY ord) AS pn FROM f JOIN secs USING (ord)),
al AS (SELECT a.doc_id, count(*) AS n, count(*) FILTER (WHERE k.name IS NULL) AS lost FROM a LEFT JOIN (SELECT DISTINCT * FROM m) k ON a.doc_id = k.doc_id AND a.name = k.name GROUP BY a.doc_id),
"""
)


def _caption_sql(ord_: int, kind: str, side: str) -> str:
    h, o, other = ("b", "z", "below") if side == "above" else ("z", "b", "above")
    fits = lambda s: f"coalesce({s}t = 'caption' AND {s}k = '{kind}', false)"
    where = f"type = '{kind}'" + (" AND NOT inline" if kind == "figure" else "")
    return f"""SELECT doc_id, {ord_} AS check_ord, idx AS item_ord, CASE WHEN {fits(h)} THEN 'The caption {side} this {kind} is typed text, not a real caption with automatic numbering.'
      WHEN {fits(o)} THEN 'This {kind}''s caption sits {other} it; a {kind} caption belongs directly {side} it.' ELSE 'This {kind} has no caption directly {side} it.' END AS message, idx AS block_index,
      CASE WHEN {fits(h)} THEN {h}p WHEN {fits(o)} THEN {o}p ELSE '' END AS text FROM n WHERE {where} AND NOT ({fits(h)} AND coalesce({h}r, false))"""


def issues_sql(first: int = 1, step: int = 1, table: str = "above", figure: str = "below", off: tuple[str, ...] = ()) -> str:
    rows = [
        f"""SELECT doc_id, 0 AS check_ord, idx AS item_ord, 'Heading level ' || level || ' follows level ' || coalesce(pl, {first - 1}) || ', deeper than the allowed step of {step}.' AS message, idx AS block_index, pv AS text FROM n WHERE type = 'heading' AND level > coalesce(pl, {first - 1}) + {step}
        UNION ALL SELECT doc_id, 0, -1, 'No real heading styles found in the document; headings appear to be typed as ordinary text.', NULL, '' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b WHERE type = 'heading')""",
        """SELECT doc_id, 1 AS check_ord, idx AS item_ord, CASE WHEN typed THEN 'Heading ''' || pv || ''' has a typed number instead of automatic numbering.' ELSE 'Heading ''' || pv || ''' is not automatically numbered.' END AS message, idx AS block_index, pv AS text FROM n WHERE type = 'heading' AND NOT numbered AND (typed OR NOT numbering_optional)""",
        """SELECT doc_id, 2 AS check_ord, 0 AS item_ord, 'No real table of contents field found; a table of contents typed by hand does not count.' AS message, CAST(NULL AS INT) AS block_index, '' AS text FROM d WHERE NOT toc""",
        """SELECT d.doc_id, 3 AS check_ord, 0 AS item_ord, CASE WHEN al.n IS NULL THEN 'The table of contents has no links to the headings; its entries do not point anywhere.' ELSE lost || ' of ' || al.n || ' table-of-contents entries point at headings that no longer exist; the table of contents is out of date.' END AS message, CAST(NULL AS INT) AS block_index, '' AS text FROM d LEFT JOIN al ON d.doc_id = al.doc_id WHERE toc AND (al.n IS NULL OR lost > 0)""",
        """SELECT d.doc_id, 4 AS check_ord, ord AS item_ord, 'Required section ''' || name || ''' not found among the document''s headings.' AS message, CAST(NULL AS INT) AS block_index, '' AS text FROM d CROSS JOIN secs WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND f.ord = secs.ord)""",
        """SELECT doc_id, 5 AS check_ord, ord AS item_ord, 'Section ''' || name || ''' appears before ''' || pn || ''', but is expected after it.' AS message, CAST(NULL AS INT) AS block_index, '' AS text FROM g WHERE pos < pp""",
        """SELECT doc_id, 6 AS check_ord, idx AS item_ord, CASE WHEN regexp_matches(text, '^[ ]*[A-Za-z0-9]') THEN 'List item ''' || pv || ''' has a typed number or label instead of automatic list numbering.' ELSE 'List item ''' || pv || ''' has a typed bullet instead of real list formatting.' END AS message, idx AS block_index, pv AS text FROM n WHERE type = 'list_item' AND NOT coalesce(real, false)""",
        _caption_sql(7, "table", table),
        _caption_sql(8, "figure", figure),
        """SELECT doc_id, 9 AS check_ord, idx AS item_ord, 'Equation ''' || pv || ''' is typed as ordinary text instead of using the equation format.' AS message, idx AS block_index, pv AS text FROM n WHERE type = 'equation' AND NOT coalesce(real, false)""",
        """SELECT doc_id, 10 AS check_ord, idx AS item_ord, 'An image is pasted inside the text without a caption; possibly a picture of an equation or symbol.' AS message, idx AS block_index, pv AS text FROM n WHERE type = 'figure' AND inline AND NOT coalesce(bt = 'caption', false) AND NOT coalesce(zt = 'caption', false)""",
    ]
    named = " UNION ALL ".join(f"SELECT *, '{c}' AS \"check\" FROM ({r})" for c, r in zip(CHECKS, rows, strict=True) if c not in off)
    return _CTE.replace("{lineitem}", "lineitem").replace("{part}", "part") + f"i AS ({named})\n"


def oracle_sql() -> dict[str, str]:
    i, columns = issues_sql(), 'doc_id, check_ord, item_ord, "check", message, block_index, text'
    counts = ", ".join(f"count(*) FILTER (WHERE \"check\" = '{c}') AS {c.replace('-', '_')}" for c in CHECKS)
    label = r"'(?i)^[ ]*(table|tabelle|figure|abbildung)[ ]+[0-9]+'"
    item = r"'^[ ]*(?:[-•*·▪–][ ]+|[0-9]+[.)][ ]+|[a-z][.)][ ]+|(?:RQ)[0-9]+[.:)]?[ ]*)'"
    equation = r"'=[^=]*[+*/·∙×^√∑∫≤≥≈]|[+*/·∙×^√∑∫≤≥≈][^=]*='"
    kind = f"CASE lower(regexp_extract(text, {label}, 1)) WHEN 'table' THEN 'table' WHEN 'tabelle' THEN 'table' WHEN 'figure' THEN 'figure' WHEN 'abbildung' THEN 'figure' END"
    place = "CASE WHEN block_index IS NULL THEN 'document' ELSE 'block ' || block_index END"
    out = {f"check_{c.replace('-', '_')}": f"{i} SELECT {columns} FROM i WHERE \"check\" = '{c}'" for c in CHECKS}
    checks_run = ",".join(f'"{c}"' for c in CHECKS)
    quote = lambda c: f"to_json({c})"
    return out | reader_queries.oracle_sql() | {
        "run_checks": f"{i} SELECT {columns} FROM i",
        "run_checks_altered_styles": f"{issues_sql(2, 2, 'below', 'above', ('toc-present', 'list-formatting'))} SELECT {columns} FROM i",
        "issue_counts": f'{i} SELECT doc_id, "check", count(*) AS n FROM i GROUP BY ALL',
        "checks_fired": f"{i} SELECT doc_id, string_agg(DISTINCT \"check\", ',' ORDER BY \"check\") AS checks FROM i GROUP BY doc_id",
        "dense_counts": f"{i} SELECT d.doc_id, {counts} FROM d LEFT JOIN i ON d.doc_id = i.doc_id GROUP BY d.doc_id",
        "status": f"{i} SELECT d.doc_id, count(i.doc_id) = 0 AS passed, count(i.doc_id) AS n_issues, CAST(CASE WHEN count(i.doc_id) = 0 THEN 0 ELSE 1 END AS INT) AS exit_status FROM d LEFT JOIN i ON d.doc_id = i.doc_id GROUP BY d.doc_id",
        "dashboard": f"{i}, x AS (SELECT 'docx' AS format, \"check\" FROM i) SELECT format, \"check\", count(*) AS n FROM x GROUP BY ROLLUP (format, \"check\")",
        "text_reports": f"{i} SELECT d.doc_id, 'pagewright: ' || any_value(d.path) || chr(10) || CASE WHEN count(i.doc_id) = 0 THEN 'No structural issues found.' ELSE count(i.doc_id) || ' issue(s) found.' || chr(10) || chr(10) || string_agg('  [' || \"check\" || ']  (' || {place} || ')  ' || message, chr(10) ORDER BY check_ord, item_ord) END AS report FROM d LEFT JOIN i ON d.doc_id = i.doc_id GROUP BY d.doc_id",
        "json_reports": f"""{i} SELECT d.doc_id, '{{"file":' || {quote("any_value(d.path)")} || ',"checks_run":[{checks_run}],"passed":' || (count(i.doc_id) = 0)::VARCHAR || ',"issues":[' || coalesce(string_agg('{{"check":' || {quote('"check"')} || ',"message":' || {quote("message")} || ',"block_index":' || coalesce(block_index::VARCHAR, 'null') || ',"text":' || {quote("text")} || '}}', ',' ORDER BY check_ord, item_ord), '') || ']}}' AS report FROM d LEFT JOIN i ON d.doc_id = i.doc_id GROUP BY d.doc_id""",
        "typed_patterns": f'{i} SELECT doc_id, idx AS "index", regexp_matches(text, {label}) AS caption, {kind} AS caption_kind, regexp_matches(text, {item}) AS list_item, regexp_matches(text, {equation}) AS equation, typed AS numbered FROM t',
        "classify_text": f"{i} SELECT doc_id, idx AS \"index\", CASE WHEN regexp_matches(text, {label}) THEN 'caption' WHEN regexp_matches(text, {item}) THEN 'list_item' WHEN regexp_matches(text, {equation}) THEN 'equation' ELSE 'paragraph' END AS type, {kind} AS kind FROM t",
        "text_functions": f"{i} SELECT doc_id, idx AS \"index\", pv AS preview, nm AS heading, regexp_matches(text, '^[ ]*[A-Za-z0-9]') AS like_number FROM t",
        "neighbours": f'{i} SELECT doc_id, idx AS "index", bt AS before_type, zt AS after_type, bk AS before_kind, zk AS after_kind, pl AS last_level FROM n',
        "plain_text_blocks": f"WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), x AS (SELECT * FROM t WHERE text <> '') SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS \"index\", CASE WHEN regexp_matches(text, {label}) THEN 'caption' WHEN regexp_matches(text, {item}) THEN 'list_item' WHEN regexp_matches(text, {equation}) THEN 'equation' ELSE 'paragraph' END AS type, {kind} AS kind, text FROM x",
        "ueq_scores": "SELECT l_orderkey || '-' || ((l_linenumber - 1) // 4) AS participant, round(avg(l_suppkey % 7 + 1), 2) AS pragmatic, round(avg(l_partkey % 7 + 1), 2) AS hedonic FROM lineitem GROUP BY 1 HAVING count(*) = 4",
    }
