"""The eleven checks as columns over two frames: blocks with their neighbours, documents with their facts.

A check gives a struct (item_ord, message, block_index, text) or null for a row, so any set of checks is
one pass: one window per document over the blocks, and one aggregate of the same rows beside the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import accepted_names, has_typed_number, normal_heading, preview, starts_like_number

# Published names, in the order in which they run and report.
CHECKS = [
    "heading-hierarchy", "heading-numbering", "toc-present", "toc-linked", "required-sections", "section-order",
    "list-formatting", "table-caption", "figure-caption", "equation-format", "inline-image",
]
# Messages that readers of reports rely on.
NO_HEADINGS = "No real heading styles found in the document; headings appear to be typed as ordinary text."
TOO_DEEP = "Heading level %s follows level %s, deeper than the allowed step of %s."
TYPED_HEADING = "Heading '%s' has a typed number instead of automatic numbering."
UNNUMBERED = "Heading '%s' is not automatically numbered."
NO_TOC = "No real table of contents field found; a table of contents typed by hand does not count."
NO_LINKS = "The table of contents has no links to the headings; its entries do not point anywhere."
DANGLING = "%s of %s table-of-contents entries point at headings that no longer exist; the table of contents is out of date."
NO_SECTION = "Required section '%s' not found among the document's headings."
ORDER = "Section '%s' appears before '%s', but is expected after it."
TYPED_LABEL = "List item '%s' has a typed number or label instead of automatic list numbering."
TYPED_BULLET = "List item '%s' has a typed bullet instead of real list formatting."
TYPED_CAPTION = "The caption %s this %s is typed text, not a real caption with automatic numbering."
WRONG_SIDE = "This %s's caption sits %s it; a %s caption belongs directly %s it."
NO_CAPTION = "This %s has no caption directly %s it."
TYPED_EQUATION = "Equation '%s' is typed as ordinary text instead of using the equation format."
IN_TEXT = "An image is pasted inside the text without a caption; possibly a picture of an equation or symbol."

Check = Callable[[dict, dict], Column]


def _issue(message: Column | str, item: Column, index: Column | None = None, text: Column | None = None) -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    where = F.lit(None).cast("int") if index is None else index
    return F.struct(item.cast("int").alias("item_ord"), m.alias("message"), where.alias("block_index"), (F.lit("") if text is None else text).alias("text"))


def _at(message: Column | str, text: Column | None = None) -> Column:
    return _issue(message, F.col("index"), F.col("index"), text)


def _said(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def _is(kind: str) -> Column:
    return F.col("type") == kind


def _off(column: str) -> Column:
    return ~F.coalesce(F.col(column), F.lit(False))


def with_neighbours(blocks: DataFrame) -> DataFrame:
    """blocks with the previous and next block and the last heading level before; one sort a document."""
    blocks = blocks.withColumn("text", F.coalesce("text", F.lit("")))  # null counts as empty
    w = Window.partitionBy("doc_id").orderBy("index")
    near = {f"{side}_{c}": f(c).over(w) for side, f in (("before", F.lag), ("after", F.lead)) for c in ("type", "kind", "real", "text")}
    last = F.last(F.when(_is("heading"), F.col("level")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumns(near | {"last_level": last})


def heading_hierarchy(structure: dict, styles: dict) -> Column:
    first, step = styles["headings"]["first_level"], styles["headings"]["max_deeper_step"]
    prev = F.coalesce("last_level", F.lit(first - 1))
    return F.when(_is("heading") & (F.col("level") > prev + step), _at(_said(TOO_DEEP, F.col("level"), prev, F.lit(step)), preview(F.col("text"))))


def heading_numbering(structure: dict, styles: dict) -> Column:
    p, typed = preview(F.col("text")), has_typed_number(F.col("text"))
    message = F.when(typed, _said(TYPED_HEADING, p)).otherwise(_said(UNNUMBERED, p))
    return F.when(_is("heading") & _off("numbered") & (typed | _off("numbering_optional")), _at(message, p))


def list_formatting(structure: dict, styles: dict) -> Column:
    p = preview(F.col("text"))
    return F.when(_is("list_item") & _off("real"), _at(F.when(starts_like_number(F.col("text")), _said(TYPED_LABEL, p)).otherwise(_said(TYPED_BULLET, p)), p))


def _caption(kind: str) -> Check:
    def check(structure: dict, styles: dict) -> Column:
        side = "above" if styles["captions"][f"{kind}_position"] == "above" else "below"
        here, there, other = ("before", "after", "below") if side == "above" else ("after", "before", "above")
        fits = lambda s: F.coalesce((F.col(f"{s}_type") == "caption") & (F.col(f"{s}_kind") == kind), F.lit(False))
        typed = F.when(_off(f"{here}_real"), _at(TYPED_CAPTION % (side, kind), preview(F.col(f"{here}_text"))))
        found = F.when(fits(here), typed).when(fits(there), _at(WRONG_SIDE % (kind, other, kind, side), preview(F.col(f"{there}_text")))).otherwise(_at(NO_CAPTION % (kind, side)))
        return F.when(_is(kind) & (_off("inline") if kind == "figure" else F.lit(True)), found)

    return check


def equation_format(structure: dict, styles: dict) -> Column:
    p = preview(F.col("text"))
    return F.when(_is("equation") & _off("real"), _at(_said(TYPED_EQUATION, p), p))


def inline_image(structure: dict, styles: dict) -> Column:
    near = F.coalesce(F.col("before_type") == "caption", F.lit(False)) | F.coalesce(F.col("after_type") == "caption", F.lit(False))
    return F.when(_is("figure") & ~_off("inline") & ~near, _at(IN_TEXT, preview(F.col("text"))))


BLOCK_CHECKS: dict[str, Check] = {
    "heading-hierarchy": heading_hierarchy, "heading-numbering": heading_numbering, "list-formatting": list_formatting, "table-caption": _caption("table"),
    "figure-caption": _caption("figure"), "equation-format": equation_format, "inline-image": inline_image,
}


def heading_facts(structure: dict) -> list[Column]:
    """Of a document's blocks: how many headings, if any, and where the first heading of each configured section is."""
    heading, name = _is("heading"), normal_heading(F.col("text"))
    first = lambda names: F.min(F.when(heading & name.isin(names), F.col("index"))) if names else F.max(F.lit(None).cast("int"))
    count = F.count(F.when(heading, 1))
    return [F.when(count > 0, count).alias("headings"), *(first(accepted_names(s)).alias(f"place_{i}") for i, s in enumerate(structure["sections"]))]


def no_headings(structure: dict, styles: dict) -> Column:
    return F.array(F.when(F.col("headings").isNull(), _issue(NO_HEADINGS, F.lit(-1))))


def toc_present(structure: dict, styles: dict) -> Column:
    return F.array(F.when(_off("toc_present"), _issue(NO_TOC, F.lit(0))))


def toc_linked(structure: dict, styles: dict) -> Column:
    anchors = F.coalesce("toc_anchors", F.array().cast("array<string>"))
    marks = F.coalesce("heading_bookmarks", F.array().cast("array<string>"))
    lost = F.size(F.filter(anchors, lambda a: ~F.array_contains(marks, a)))
    found = F.when(F.size(anchors) == 0, _issue(NO_LINKS, F.lit(0))).when(lost > 0, _issue(_said(DANGLING, lost, F.size(anchors)), F.lit(0)))
    return F.array(F.when(~_off("toc_present"), found))


def required_sections(structure: dict, styles: dict) -> Column:
    return F.array(*(F.when(F.col(f"place_{i}").isNull(), _issue(NO_SECTION % s["name"], F.lit(i))) for i, s in enumerate(structure["sections"])))


def section_order(structure: dict, styles: dict) -> Column:
    """Neighbours among the sections that are found: the later one in the configuration must not come first."""
    sections = structure["sections"]
    out, before, name = [], F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, s in enumerate(sections):
        place = F.col(f"place_{i}")
        out.append(F.when(place < before, _issue(_said(ORDER, F.lit(s["name"]), name), F.lit(i))))
        before, name = F.coalesce(place, before), F.when(place.isNotNull(), F.lit(s["name"])).otherwise(name)
    return F.array(*out)


DOC_CHECKS: dict[str, Check] = {
    "heading-hierarchy": no_headings, "toc-present": toc_present, "toc-linked": toc_linked, "required-sections": required_sections, "section-order": section_order,
}
#: Document checks that look at headings.
NEED_HEADINGS = {"heading-hierarchy", "required-sections", "section-order"}
