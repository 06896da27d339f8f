"""HTML pages as documents, in native columns: a block is a tag and the text up to the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Patterns
from ..schema import Corpus

# What is never read, tags inside a line of text, parts of tables, written-out characters.
UNREAD = r"(?is)<!--.*?(?:-->|$)|<(head|nav|script|style|template|noscript|pre|svg)\b.*?(?:</\1\s*>|$)"
INSIDE = r"(?i)</?(?:a|abbr|b|bdi|bdo|cite|code|data|dfn|em|font|i|kbd|label|mark|q|s|samp|small|span|strong|sub|sup|time|tt|u|var)\b[^>]*>"
BREAK = r"(?i)<(?:br|wbr)\b[^>]*>"
TAG = r"<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>([^<]*)"
CELLS = ["thead", "tbody", "tfoot", "tr", "td", "th", "/thead", "/tbody", "/tfoot", "/tr", "/td", "/th", "colgroup", "col"]
CHARACTERS = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _text(c: Column) -> Column:
    for name, character in CHARACTERS.items():
        c = F.replace(c, F.lit(name), F.lit(character))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def html_blocks(pages: DataFrame, patterns: Patterns) -> DataFrame:
    """Blocks of pages (columns doc_id, html): headings, list items, tables, figures, captions, formulas, paragraphs.

    HTML numbers no headings, so numbering is optional; its lists, captions and formulas are real. Text of
    table cells is no block. No shuffle: a page's blocks stay in its row until they are exploded. Null html
    has no blocks.
    """
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", UNREAD, " "), INSIDE, ""), BREAK, " ")
    found = F.arrays_zip(F.transform(F.regexp_extract_all(body, F.lit(TAG), 1), F.lower).alias("tag"), F.transform(F.regexp_extract_all(body, F.lit(TAG), 2), _text).alias("text"))
    wanted = F.filter(found, lambda x: x["tag"].isin("table", "img") | ((x["text"] != "") & ~x["tag"].isin(*CELLS)))
    rows = pages.select("doc_id", F.posexplode(wanted).alias("index", "x")).select("doc_id", "index", "x.tag", "x.text")
    heading, tag = F.col("tag").rlike("^h[1-6]$"), F.col("tag")
    typed = patterns.typed_column(F.col("text"))
    kind = F.when(tag == "caption", "table").when(tag == "figcaption", "figure")
    type_ = F.when(heading, "heading").when(tag == "li", "list_item").when(tag == "table", "table").when(tag == "img", "figure").when(kind.isNotNull(), "caption").when(tag == "math", "equation").otherwise(typed["type"])
    own = tag.isin("li", "math") | kind.isNotNull()
    return rows.select(
        "doc_id", "index", type_.alias("type"), F.when(tag == "table", "").otherwise(F.col("text")).alias("text"), tag.alias("style_name"),
        F.when(heading, F.substring("tag", 2, 1).cast("int")).alias("level"), F.lit(False).alias("numbered"), heading.alias("numbering_optional"),
        F.coalesce(kind, F.when(type_ == "caption", typed["kind"])).alias("kind"),
        F.when(own, True).when(type_.isin("list_item", "caption", "equation"), False).alias("real"), ((tag == "img") & (F.col("text") != "")).alias("inline"),
    )


def html_corpus(pages: DataFrame, patterns: Patterns) -> Corpus:
    """Corpus of pages (columns page_id, url, html): contents are links in a nav to places in the page, bookmarks the headings' ids."""
    nav = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<nav\b.*?(?:</nav\s*>|$)"), 0), " ")
    anchors = F.regexp_extract_all(nav, F.lit(r"""(?i)\bhref\s*=\s*["']?#([^"'\s>]+)"""), 1)
    marks = F.regexp_extract_all("html", F.lit(r"""(?i)<h[1-6]\b[^>]*\bid\s*=\s*["']?([^"'\s>]+)"""), 1)
    pages = pages.select(F.col("page_id").cast("long").alias("doc_id"), F.col("url").alias("path"), "html")
    docs = pages.select("doc_id", "path", F.lit("html").alias("format"), (F.coalesce(F.size(anchors), F.lit(0)) > 0).alias("toc_present"), anchors.alias("toc_anchors"), marks.alias("heading_bookmarks"))
    return Corpus(docs, html_blocks(pages, patterns))
