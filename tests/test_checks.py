"""Rules on hand-built documents: each case is (blocks, facts) -> issues by check."""

import json

import pytest

from pagewright.config import STRUCTURE, STYLES, load_structure, load_styles, merge
from pagewright.functions.patterns import compile_patterns
from pagewright.plans import report, run
from pagewright.schema import BLOCKS, DOCS, Corpus

SECTIONS = {"sections": [{"name": "Introduction", "accept": ["introduction", "einleitung"]}, {"name": "Methodology"}, {"name": "Results"}]}


def H(level=1, text="Some Title", numbered=True, optional=False):
    return ("heading", text, level, numbered, optional, None, None, False)


def B(type_, text="", kind=None, real=None, inline=False):
    return (type_, text, None, False, False, kind, real, inline)


def corpus(spark, cases):
    docs = [(i, f"/{i}.docx", "docx", f.get("toc", True), f.get("anchors", ["_Toc1"]), f.get("marks", ["_Toc1"])) for i, (_, f) in enumerate(cases)]
    blocks = [(i, k, b[0], b[1], None, *b[2:]) for i, (bs, _) in enumerate(cases) for k, b in enumerate(bs)]
    return Corpus(spark.createDataFrame(docs, DOCS), spark.createDataFrame(blocks, BLOCKS))


def found(spark, cases, structure=None, styles=None):
    out = [{} for _ in cases]
    for r in run.run_checks(corpus(spark, cases), structure, styles).collect():
        out[r.doc_id].setdefault(r.check, []).append(r)
    return out


def counts(result):
    return {k: len(v) for k, v in result.items()}


TABLE, FIGURE = B("table"), B("figure")
TC, FC = B("caption", "Table 1: x", "table", True), B("caption", "Figure 1: x", "figure", True)
CASES = [
    ([B("paragraph", "Introduction")], {}, {"heading-hierarchy": 1}),
    ([H(1), H(3)], {}, {"heading-hierarchy": 1}),
    ([H(1), H(2), H(3), H(1)], {}, {}),
    ([H(2)], {}, {"heading-hierarchy": 1}),
    ([H(numbered=False)], {}, {"heading-numbering": 1}),
    ([H(text="Abstract", numbered=False, optional=True)], {}, {}),
    ([H(text="2. Related Work", numbered=False, optional=True)], {}, {"heading-numbering": 1}),
    ([H(text="2. Related Work")], {}, {}),
    ([H(text="3D Printing", numbered=False, optional=True)], {}, {}),
    ([], {"toc": False}, {"heading-hierarchy": 1, "toc-present": 1}),
    ([H()], {"anchors": []}, {"toc-linked": 1}),
    ([H()], {"anchors": ["_Toc1", "_Toc2", "_Toc3", "_Toc3"], "marks": ["_Toc1", "_Toc2"]}, {"toc-linked": 1}),
    ([H()], {"anchors": None, "marks": None}, {"toc-linked": 1}),
    ([H(), B("list_item", "- an item", real=False), B("list_item", "1. x", real=None)], {}, {"list-formatting": 2}),
    ([H(), B("list_item", "an item", real=True)], {}, {}),
    ([H(), TC, TABLE], {}, {}),
    ([H(), TABLE, TC], {}, {"table-caption": 1}),
    ([H(), TABLE], {}, {"table-caption": 1}),
    ([H(), B("caption", "Table 1: x", "table", False), TABLE], {}, {"table-caption": 1}),
    ([H(), FIGURE, FC], {}, {}),
    ([H(), FC, FIGURE], {}, {"figure-caption": 1}),
    ([H(), B("figure", inline=True)], {}, {"inline-image": 1}),
    ([H(), B("figure", inline=True), TC], {}, {}),
    ([H(), B("equation", "F1 = 2*P*R", real=False), B("equation", "F1", real=True)], {}, {"equation-format": 1}),
]


def test_each_rule(spark):
    got = found(spark, [c[:2] for c in CASES])
    assert [counts(g) for g in got] == [c[2] for c in CASES]
    said = lambda i, c: got[i][c][0].message
    assert "level 3 follows level 1" in said(1, "heading-hierarchy") and "follows level 0" in said(3, "heading-hierarchy")
    assert "typed number" in said(6, "heading-numbering") and said(11, "toc-linked").startswith("2 of 4 ")
    assert "typed bullet" in got[13]["list-formatting"][0].message and "number or label" in got[13]["list-formatting"][1].message
    assert "sits below it" in said(16, "table-caption") and "no caption directly above" in said(17, "table-caption")
    assert "typed text" in said(18, "table-caption") and got[18]["table-caption"][0].text == "Table 1: x"
    assert got[0]["heading-hierarchy"][0].block_index is None and got[1]["heading-hierarchy"][0].block_index == 1


def test_sections(spark):
    names = lambda *x: [H(text=t) for t in x]
    cases = [
        (names("Introduction", "Results"), {}), (names("1. INTRODUCTION", "Methodology", "  results  "), {}), (names("Einleitung", "Methodology", "Results"), {}),
        ([H(), B("paragraph", "Introduction")], {}), (names("Introduction", "Results", "Methodology"), {}), ([], {"toc": False}),
    ]
    got = [counts(g) for g in found(spark, cases, SECTIONS)]
    assert got[:5] == [{"required-sections": 1}, {}, {}, {"required-sections": 3}, {"section-order": 1}]
    assert found(spark, cases[:1], {"sections": [{"name": "X", "accept": []}]})[0]["required-sections"][0].message == "Required section 'X' not found among the document's headings."


def test_styles_change_rules(spark):
    cases = [([H(1), H(3)], {}), ([H(), FC, FIGURE], {}), ([H()], {"toc": False})]
    styles = merge(STYLES, {"headings": {"max_deeper_step": 2}, "captions": {"figure_position": "above"}, "checks": {"toc-present": False, "unknown": False}})
    assert found(spark, cases, None, styles) == [{}, {}, {}]
    off = merge(STYLES, {"checks": {c: False for c in run.enabled_checks()}})
    assert run.run_checks(corpus(spark, cases), None, off).collect() == []


def test_counts_status_and_reports(spark):
    c = corpus(spark, [([H(1), H(3), B("list_item", "- ä" + "x" * 50, real=False)], {"toc": False}), ([H()], {})])
    issues = run.run_checks(c).persist()
    dense = {r.doc_id: r.asDict() for r in run.dense_counts(c.docs, issues).collect()}
    assert dense[0]["heading-hierarchy"] == dense[0]["list-formatting"] == 1 and set(list(dense[1].values())[1:]) == {0}
    assert {r.doc_id: (r.passed, r.exit_status) for r in run.status(c.docs, issues).collect()} == {0: (False, 1), 1: (True, 0)}
    texts = {r.doc_id: r.report for r in report.text_reports(c.docs, issues, "check").collect()}
    assert texts[1] == "check: /1.docx\nNo structural issues found."
    lines = texts[0].split("\n")
    assert lines[:3] == ["check: /0.docx", "3 issue(s) found.", ""] and lines[3].startswith("  [heading-hierarchy]  (block 1)  Heading") and "(document)" in lines[4]
    data = json.loads(report.indented({r.doc_id: r.report for r in report.json_reports(c.docs, issues, run.enabled_checks()).collect()}[0]))
    assert list(data) == ["file", "checks_run", "passed", "issues"] and data["issues"][1]["block_index"] is None
    assert data["issues"][2]["text"] == "- ä" + "x" * 42 + "..."


def test_config(tmp_path):
    write = lambda x: (tmp_path / "c.json").write_text(json.dumps(x)) and str(tmp_path / "c.json")
    assert load_styles() == STYLES and load_structure() == STRUCTURE
    got = load_styles(write({"_comment": "x", "headings": {"first_level": 2, "_why": "y"}, "captions": {"labels": {"table": ["tab"]}}}))
    assert got["headings"] == {"first_level": 2, "max_deeper_step": 1}
    assert got["captions"] == {"table_position": "above", "figure_position": "below", "labels": {"table": ["tab"]}}
    assert load_structure(write({"sections": [{"name": "A"}]})) == {"sections": [{"name": "A"}]}
    with pytest.raises(KeyError, match="captions, checks, headings, lists"):
        load_styles(write({"cheks": {}}))
    assert STYLES["headings"]["first_level"] == 1


def test_typed_patterns():
    p = compile_patterns(STYLES)
    assert p.typed("Figure 3 shows that") == ("caption", "figure") and p.typed("Tabelle 2") == ("caption", "table")
    assert [p.typed(t)[0] for t in ("Table1", "RQ2: why", "- x", "a) x", "A) x", "p = 0.05", "a = b * c", "x + y = z")] == ["paragraph", "list_item", "list_item", "list_item", "paragraph", "paragraph", "equation", "equation"]
    assert compile_patterns(merge(STYLES, {"lists": {"labels": ["H"]}})).typed("H1: we expect")[0] == "list_item"


def test_null_texts_count_as_empty(spark):
    blocks = [("heading", None, 1, False, False, None, None, False), ("list_item", None, None, False, False, None, False, False), ("equation", None, None, False, False, None, False, False)]
    got = found(spark, [(blocks, {})])[0]
    assert [r.text for c in ("heading-numbering", "list-formatting", "equation-format") for r in got[c]] == ["", "", ""]
    assert got["heading-numbering"][0].message == "Heading '' is not automatically numbered."
