"""Reader of .docx: the body's own paragraphs and tables, then equations in footnotes."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from .model import Document, first_along

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
# Fixed value: the field that numbers captions.
SEQ = re.compile(r"SEQ\s+(\w+)")


class Styles:
    """Style definitions by id, looked through from a style to what it is based on."""

    def __init__(self, root: ET.Element | None) -> None:
        self.by_id = {s.get(W + "styleId"): s for s in root.iter(W + "style")} if root is not None else {}

    def name(self, style: str | None) -> str | None:
        found = self.by_id.get(style)
        label = found.find(W + "name") if found is not None else None
        return label.get(W + "val") if label is not None else None

    def value(self, paragraph: ET.Element, path: str) -> str | None:
        """The value at path of the paragraph's properties, or of the first style in its chain that has it."""
        there = lambda e: e.find(f"{W}pPr/{path}")
        own = there(paragraph)
        if own is None:
            own = first_along(style_id(paragraph), self.by_id, _base, there)
        return own.get(W + "val") if own is not None else None


def _base(style: ET.Element) -> str | None:
    found = style.find(W + "basedOn")
    return found.get(W + "val") if found is not None else None


def style_id(paragraph: ET.Element) -> str | None:
    found = paragraph.find(f"{W}pPr/{W}pStyle")
    return found.get(W + "val") if found is not None else None


def _text(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter(W + "t"))


def _instructions(e: ET.Element) -> list[str]:
    return [t.text or "" for t in e.iter(W + "instrText")] + [f.get(W + "instr", "") for f in e.iter(W + "fldSimple")]


def _footnotes(z: zipfile.ZipFile) -> ET.Element | None:
    try:
        relations = ET.fromstring(z.read("word/_rels/document.xml.rels"))
    except KeyError:
        return None
    for r in relations:
        if r.get("Type", "").endswith("/footnotes"):
            target = r.get("Target", "")
            return ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else posixpath.normpath("word/" + target)))
    return None


def extract(data: bytes, patterns) -> Document:
    out = Document()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
        styles = Styles(ET.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None)
        notes = _footnotes(z)
    out.toc_present = any("TOC" in i for i in _instructions(root))
    body = root.find(W + "body")
    for e in body if body is not None else ():
        if e.tag == W + "tbl":
            out.add("table")
        elif e.tag == W + "p":
            _paragraph(out, e, styles, patterns)
    for p in notes.iter(W + "p") if notes is not None else ():
        text = _text(p)
        if p.find(f".//{M}oMath") is not None:
            out.add("equation", text, real=True)
        elif patterns.is_equation(text):
            out.add("equation", text, real=False)
    return out


def _paragraph(out: Document, p: ET.Element, styles: Styles, patterns) -> None:
    text = _text(p)
    outline = styles.value(p, W + "outlineLvl")
    level = int(outline) if outline is not None and outline.isdigit() else None
    is_heading = level is not None and level <= 8
    list_id = styles.value(p, f"{W}numPr/{W}numId")
    numbered = list_id is not None and list_id != "0"
    if is_heading:
        out.heading_bookmarks += [n for b in p.iter(W + "bookmarkStart") if (n := b.get(W + "name", "")).startswith("_Toc")]
    out.toc_anchors += [a for h in p.iter(W + "hyperlink") if (a := h.get(W + "anchor", "")).startswith("_Toc")]
    both = {"style_name": styles.name(style_id(p)), "numbered": numbered}
    sequence = SEQ.search(" ".join(_instructions(p)))
    if p.find(f".//{M}oMath") is not None:
        out.add("equation", text, real=True, **both)
    elif p.find(f".//{W}drawing") is not None:
        out.add("figure", text, inline=bool(text.strip()), **both)
    elif sequence:
        out.add("caption", text, kind=patterns.kinds.get(sequence[1].lower()), real=True, **both)
    elif patterns.typed(text)[0] == "caption":
        out.add_typed(patterns, text, **both)
    elif is_heading:
        out.add("heading", text, level=level + 1, **both)
    elif numbered:
        out.add("list_item", text, real=True, **both)
    else:
        out.add_typed(patterns, text, **both)
