"""Queries of the readers: documents are made of the lines of `documents`, written in each format, and read back.

Line n of document d takes the form (d + n) mod 8: heading, paragraph, list item, caption, formula, picture in
text, heading without a number, table. The SQL says which blocks must come out.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STYLES
from ..functions.patterns import compile_patterns
from ..sources import corpus_of, extracted
from ..sources.conversations import conversation_blocks
from ..sources.dealing import dealt_out
from ..sources.html import html_corpus
from . import run, study

PATTERNS = compile_patterns(STYLES)
BLANKS = r"[\s\p{Z}\p{Cc}]+"
#: What means something to LaTeX.
SPECIAL = r"[\\{}$%&#_~^\[\]]"
SHOWN = ["doc_id", "index", "type", "text", "level", "numbered", "kind", "real", "inline"]

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
DOCX = {
    "word/styles.xml": f"""<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="H0"/></w:style><w:style w:styleId="H0"><w:pPr><w:outlineLvl w:val="0"/><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style>
<w:style w:styleId="H2"><w:name w:val="heading 2"/><w:pPr><w:outlineLvl w:val="1"/><w:numPr><w:numId w:val="0"/></w:numPr></w:pPr></w:style></w:styles>""",
}
O = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for p, n in (("office", "office"), ("text", "text"), ("table", "table"), ("draw", "drawing"), ("style", "style")))  # noqa: E741
ODT = {
    "styles.xml": f"""<office:document-styles {O}><office:styles><style:style style:name="H2" style:parent-style-name="H3"/><style:style style:name="H3" style:list-style-name=""/></office:styles>
<text:outline-style><text:outline-level-style text:level="1" style:num-format="1"/><text:outline-level-style text:level="2" style:num-format="1"/></text:outline-style></office:document-styles>""",
}


def _lines(spark: SparkSession, sf_dir: str, drop: str | None = None) -> DataFrame:
    """doc_id and lines: whole texts line by line, white space collapsed, without what drop matches."""
    line = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, drop, "") if drop else x, BLANKS, " "))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), lambda x: x != "")
    return dealt_out(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", lines.alias("lines")))


def _body(forms: list[str], escape: bool) -> Column:
    """The lines in their forms, in which TEXT stands for the line, one after the other."""
    xml = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def form(x: Column, n: Column) -> Column:
        shape = F.element_at(F.array(*map(F.lit, forms)), (F.pmod(F.col("doc_id") + n, F.lit(8)) + 1).cast("int"))
        return F.replace(shape, F.lit("TEXT"), xml(x) if escape else x)

    return F.array_join(F.transform("lines", form), "\n")


def _zipped(rows: DataFrame, main: str, others: dict[str, str]) -> DataFrame:
    """path and content: zip files of the column body, as the file main, and others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body in b["body"].to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for name, text in {main: body, **others}.items():
                        z.writestr(name, text)
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(out, pa.binary())], names=["path", "content"])

    return rows.select("path", "body").mapInArrow(run, "path string, content binary")


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda inside, props="": f'<w:p><w:pPr>{props}</w:pPr><w:r><w:t xml:space="preserve">TEXT</w:t></w:r>{inside}</w:p>'
    forms = [
        p('<w:bookmarkStart w:name="_Toc1"/>', '<w:pStyle w:val="H1"/>'), p(""), p("", '<w:numPr><w:numId w:val="3"/></w:numPr>'), p('<w:fldSimple w:instr=" SEQ Table "/>'),
        p("<m:oMath/>"), p("<w:drawing/>"), p("", '<w:pStyle w:val="H2"/>'), f"<w:tbl><w:tr>{p('')}</w:tr></w:tbl>",
    ]
    body = F.concat(F.lit(f"<w:document {W}><w:body>"), _body(forms, True), F.lit("</w:body></w:document>"))
    rows = _lines(spark, sf_dir).select(F.concat(F.lit("/d/"), "doc_id", F.lit(".docx")).alias("path"), body.alias("body"))
    return _zipped(rows, "word/document.xml", DOCX)


def odt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda inside: f"<text:p>TEXT{inside}</text:p>"
    forms = [
        '<text:h text:outline-level="1">TEXT</text:h>', p(""), f"<text:list><text:list-item>{p('')}</text:list-item></text:list>", p('<text:sequence text:name="Table"/>'),
        p("<draw:frame><draw:object/></draw:frame>"), p('<draw:frame text:anchor-type="as-char"><draw:image/></draw:frame>'),
        '<text:h text:outline-level="2" text:style-name="H2">TEXT</text:h>', f"<table:table>{p('')}</table:table>",
    ]
    body = F.concat(F.lit(f"<office:document-content {O}><office:body><office:text>"), _body(forms, True), F.lit("</office:text></office:body></office:document-content>"))
    rows = _lines(spark, sf_dir).select(F.concat(F.lit("/d/"), "doc_id", F.lit(".odt")).alias("path"), body.alias("body"))
    return _zipped(rows, "content.xml", ODT)


def tex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files a document: the main one includes the other, which lies in a folder below."""
    forms = [
        "\\section{TEXT}", "\nTEXT\n", "\\begin{itemize}\\item TEXT\\end{itemize}", "\\begin{table}\\caption{TEXT}\\begin{tabular}{l}x\\end{tabular}\\end{table}",
        "\\[TEXT\\]", "\nTEXT \\includegraphics{f}\n", "\\section*{TEXT}", "\\begin{table*}\\begin{tabular}{l}TEXT\\end{tabular}\\end{table*}",
    ]
    rows = _lines(spark, sf_dir, SPECIAL)
    folder = F.concat(F.lit("hdfs://store/d/"), F.col("doc_id").cast("string"))
    main = rows.select(F.concat(folder, F.lit("/main.tex")).alias("path"), F.lit("\\documentclass{article}\\begin{document}\\input{parts/body}\\include{missing}\\end{document}").alias("body"))
    part = rows.select(F.concat(folder, F.lit("/parts/body.tex")).alias("path"), _body(forms, False).alias("body"))
    return main.unionByName(part).select("path", F.col("body").cast("binary").alias("content"))


def _read_back(files: Callable[[SparkSession, str], DataFrame], number: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        corpus = corpus_of(extracted(files(spark, sf_dir)))
        ids = corpus.docs.select(F.col("doc_id").alias("key"), F.regexp_extract("path", number, 1).cast("long").alias("doc_id"))
        return corpus.blocks.withColumnRenamed("doc_id", "key").join(ids, "key").select(*SHOWN)

    return query


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, every third a broken .odt, every third of an unknown format."""
    files = docx_files(spark, sf_dir).withColumn("n", F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long"))
    ending = F.when(F.col("n") % 3 == 1, ".odt").when(F.col("n") % 3 == 2, ".pdf").otherwise(".docx")
    corpus = corpus_of(extracted(files.select(F.concat(F.lit("/d/"), "n", ending).alias("path"), F.when(F.col("n") % 3 == 0, F.col("content")).otherwise(F.lit(b"none")).alias("content"))))
    out = run.status(corpus.docs, run.run_checks(corpus, only=["heading-hierarchy", "toc-present"]), corpus.errors)
    paths = corpus.docs.select("doc_id", "path").unionByName(corpus.errors.select("doc_id", "path"))
    return out.join(paths, "doc_id").select("path", "passed", "n_issues", "exit_status")


def _study(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import queries

    corpus, table = queries.corpus(spark, sf_dir), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sessions = table("orders").select(F.concat(F.lit("P"), "o_custkey", F.lit("-"), "o_orderkey").alias("participant"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("time"))
    answer = lambda i: F.struct(F.lit(i).alias("item"), (F.pmod(F.col("o_orderkey") * (i + 3) + F.col("o_custkey"), F.lit(7)) + 1).alias("answer"))
    given = table("orders").select(F.concat(F.lit("P"), "o_custkey", F.lit("-"), "o_orderkey").alias("participant"), F.explode(F.array(*map(answer, range(8)))).alias("a"), F.col("o_custkey").alias("k"))
    given = given.where("k % 5 > 0 or a.item < 7").select("participant", "a.item", "a.answer")
    out = study.study_rows(sessions, corpus.docs, run.run_checks(corpus, queries.STRUCTURE), given)
    return out.toDF(*(c.lower().replace(" ", "_").replace("(1-7)", "").replace("_-_", "_").strip("_") for c in out.columns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    pages = lambda s, d: html_corpus(_pages(s, d), PATTERNS)
    return {
        "read_docx": _read_back(docx_files, r"(\d+)\.docx$"),
        "read_odt": _read_back(odt_files, r"(\d+)\.odt$"),
        "read_latex": _read_back(tex_files, r"(\d+)/main\.tex$"),
        "read_html": lambda s, d: pages(s, d).blocks.select(*SHOWN),
        "read_html_facts": lambda s, d: pages(s, d).docs.select("doc_id", "path", "toc_present", F.size("heading_bookmarks").alias("n_marks")),
        "read_conversations": lambda s, d: conversation_blocks(s.read.parquet(f"{d}/conversations.parquet"), PATTERNS).select(*SHOWN, "style_name"),
        "file_status": _file_status,
        "study_rows": _study,
    }


# --- the same in SQL ---

LABEL = r"'(?i)^[ ]*(table|tabelle|figure|abbildung)[ ]+[0-9]+'"
ITEM = r"'^[ ]*(?:[-•*·▪–][ ]+|[0-9]+[.)][ ]+|[a-z][.)][ ]+|(?:RQ)[0-9]+[.:)]?[ ]*)'"
EQUATION = r"'=[^=]*[+*/·∙×^√∑∫≤≥≈]|[+*/·∙×^√∑∫≤≥≈][^=]*='"
TYPED = f"CASE WHEN regexp_matches(text, {LABEL}) THEN 'caption' WHEN regexp_matches(text, {ITEM}) THEN 'list_item' WHEN regexp_matches(text, {EQUATION}) THEN 'equation' ELSE 'paragraph' END"
KIND = f"CASE lower(regexp_extract(text, {LABEL}, 1)) WHEN 'table' THEN 'table' WHEN 'tabelle' THEN 'table' WHEN 'figure' THEN 'figure' WHEN 'abbildung' THEN 'figure' END"


def _split_sql(drop: str | None = None) -> str:
    cut = f"regexp_replace(x, '{drop}', '', 'g')" if drop else "x"
    return rf"""
WITH raw AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace({cut}, '[\s\p{{Z}}\p{{Cc}}]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents),
t AS (SELECT doc_id, unnest(lines) AS text, unnest(range(len(lines))) AS n FROM raw),
f AS (SELECT *, ((doc_id + n) % 8 + 8) % 8 AS form, {TYPED} AS typed, {KIND} AS word FROM t)"""


def _office_sql(caption_first: bool) -> str:
    """caption_first: text typed like a caption is one before it is a heading or an item."""
    typed = "typed = 'caption' AND form IN (0, 2, 6)" if caption_first else "false"
    return rf"""{_split_sql()}
SELECT doc_id, CAST(n AS INT) AS "index", CASE WHEN {typed} THEN 'caption' ELSE CASE form WHEN 0 THEN 'heading' WHEN 1 THEN typed WHEN 2 THEN 'list_item' WHEN 3 THEN 'caption' WHEN 4 THEN 'equation' WHEN 5 THEN 'figure' WHEN 6 THEN 'heading' ELSE 'table' END END AS type,
  CASE WHEN form = 7 THEN '' ELSE text END AS text, CAST(CASE WHEN {typed} THEN NULL WHEN form = 0 THEN 1 WHEN form = 6 THEN 2 END AS INT) AS level, {"form IN (0, 2)" if caption_first else "form = 0"} AS numbered,
  CASE WHEN form = 3 THEN 'table' WHEN form = 1 OR {typed} THEN word END AS kind,
  CASE WHEN {typed} OR form = 1 AND typed <> 'paragraph' THEN false WHEN form IN (2, 3, 4) THEN true END AS real, form = 5 AS inline FROM f"""


def oracle_sql() -> dict[str, str]:
    from . import queries

    special = r"[\\{}$%&#_~^\[\]]"
    latex = rf"""{_split_sql(special)},
b AS (SELECT *, unnest(CASE form WHEN 3 THEN [0, 1] ELSE [0] END) AS j FROM f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, j) - 1 AS INT) AS "index",
  CASE form WHEN 0 THEN 'heading' WHEN 1 THEN typed WHEN 2 THEN 'list_item' WHEN 3 THEN CASE j WHEN 0 THEN 'caption' ELSE 'table' END WHEN 4 THEN 'equation' WHEN 5 THEN 'figure' WHEN 6 THEN 'heading' ELSE 'table' END AS type,
  CASE WHEN form = 7 OR j = 1 THEN '' ELSE text END AS text, CAST(CASE WHEN form IN (0, 6) THEN 1 END AS INT) AS level, form = 0 AS numbered,
  CASE WHEN form = 3 AND j = 0 THEN 'table' WHEN form = 1 THEN word END AS kind, CASE WHEN form = 1 AND typed <> 'paragraph' THEN false WHEN form IN (2, 4) OR form = 3 AND j = 0 THEN true END AS real, form = 5 AS inline FROM b"""
    html = rf"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?(?:-->|$)', ' ', 'gs'), '<head\b.*?</head\s*>|<nav\b.*?</nav\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis'), '</?(?:a|b|em|i|strong|span)\b[^>]*>', '', 'gi'), '<br\b[^>]*>', ' ', 'gi') AS body FROM pages),
e AS (SELECT page_id, regexp_extract_all(body, '<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>([^<]*)', 1) AS tags, regexp_extract_all(body, '<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>([^<]*)', 2) AS texts FROM s),
x AS (SELECT page_id, lower(unnest(tags)) AS tag, unnest(texts) AS raw, unnest(range(len(tags))) AS n FROM e),
y AS (SELECT page_id, tag, n, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(raw, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\s\p{{Z}}]+', ' ', 'g')) AS text FROM x),
z AS (SELECT page_id, tag, n, text, {TYPED} AS typed, {KIND} AS word FROM y WHERE text <> '')
SELECT page_id AS doc_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS "index", CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'li' THEN 'list_item' ELSE typed END AS type, text,
  CAST(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN substr(tag, 2, 1) END AS INT) AS level, false AS numbered, CASE WHEN NOT regexp_matches(tag, '^h[1-6]$') AND tag <> 'li' THEN word END AS kind,
  CASE WHEN tag = 'li' THEN true WHEN NOT regexp_matches(tag, '^h[1-6]$') AND typed <> 'paragraph' THEN false END AS real, false AS inline FROM z"""
    turns = rf"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id AS doc_id, CAST(turn AS INT) AS "index", {TYPED} AS type, text, CAST(NULL AS INT) AS level, false AS numbered, CASE WHEN ({TYPED}) = 'caption' THEN {KIND} END AS kind,
  CASE WHEN ({TYPED}) <> 'paragraph' THEN false END AS real, false AS inline, role AS style_name FROM t"""
    status = rf"""{_split_sql()},
h AS (SELECT doc_id, count(*) FILTER (WHERE form IN (0, 6) AND typed <> 'caption') AS heads FROM f GROUP BY doc_id),
l AS (SELECT doc_id, CASE form WHEN 0 THEN 1 ELSE 2 END AS level, lag(CASE form WHEN 0 THEN 1 ELSE 2 END, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM f WHERE form IN (0, 6) AND typed <> 'caption'),
d AS (SELECT doc_id, count(*) FILTER (WHERE level > before + 1) AS deep FROM l GROUP BY doc_id)
SELECT '/d/' || r.doc_id || CASE r.doc_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.odt' ELSE '.pdf' END AS path, false AS passed,
  CASE r.doc_id % 3 WHEN 0 THEN 1 + CASE WHEN coalesce(heads, 0) = 0 THEN 1 ELSE 0 END + coalesce(deep, 0) ELSE 0 END AS n_issues, CAST(CASE r.doc_id % 3 WHEN 0 THEN 1 ELSE 2 END AS INT) AS exit_status
FROM raw r LEFT JOIN h ON h.doc_id = r.doc_id LEFT JOIN d ON d.doc_id = r.doc_id"""
    i = queries.issues_sql()
    names = {c: label.lower().replace(" ", "_") for c, label in run.LABELS.items()}
    counts = ", ".join(f"count(*) FILTER (WHERE \"check\" = '{c}') AS {n}" for c, n in names.items())
    item = lambda k: f"(o_orderkey * {k + 3} + o_custkey) % 7 + 1"
    answers = ", ".join(f"{item(k)} AS {n.lower().replace(' - ', '_').replace(' ', '_')}" for k, n in enumerate(study.item_names()))
    mean = lambda ks: "round((" + " + ".join(item(k) for k in ks) + ") / 4.0, 2)"
    sheet = rf"""{i}, w AS (SELECT d.doc_id, count(i.doc_id) AS total_issues, {counts} FROM d LEFT JOIN i ON d.doc_id = i.doc_id GROUP BY d.doc_id)
SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') AS time, 'P' || o_custkey || '-' || o_orderkey AS participant_id, o_orderkey || '.docx' AS file_name, CASE WHEN total_issues = 0 THEN 'Passed' ELSE total_issues || ' issue(s)' END AS result,
  total_issues, {", ".join(names.values())}, {answers}, CAST({mean(range(4))} AS DOUBLE) AS pragmatic_quality, CAST({mean(range(4, 8))} AS DOUBLE) AS hedonic_quality
FROM w JOIN orders ON o_orderkey = doc_id WHERE o_custkey % 5 > 0"""
    return {
        "read_docx": _office_sql(True),
        "read_odt": _office_sql(False),
        "read_latex": latex,
        "read_html": html,
        "read_html_facts": r"""SELECT page_id AS doc_id, url AS path, regexp_matches(coalesce(html, ''), '<nav\b.*\bhref\s*=\s*["'']?#', 'is') AS toc_present, CAST(len(regexp_extract_all(html, '<h[1-6]\b[^>]*\bid\s*=', 0, 'i')) AS INT) AS n_marks FROM pages""",
        "read_conversations": turns,
        "file_status": status,
        "study_rows": sheet,
    }
