"""Readers on small documents made here: LaTeX bodies, XML fragments and zipped office files."""

import io
import zipfile
from xml.etree import ElementTree as ET

import pytest

from pagewright import cli
from pagewright.config import STYLES
from pagewright.functions.patterns import compile_patterns
from pagewright.plans import run, study
from pagewright.sources import conversations, corpus_of, docx, extracted, extractor_for, html, latex, odt, read_corpus, supported_extensions
from pagewright.streaming.drop_folder import watch

P = compile_patterns(STYLES)


def tex(body, cls="article", before=""):
    return latex.extract(rf"\documentclass[11pt]{{{cls}}}{before}\begin{{document}}{body}\end{{document}}", P)


def heads(d):
    return [(b.level, b.numbered) for b in d.blocks if b.type == "heading"]


def types(d):
    return [b.type for b in d.blocks]


@pytest.mark.parametrize(
    ("cls", "body", "want"),
    [
        ("article", r"\section{A}\subsection{B}", [(1, True), (2, True)]),
        ("report", r"\chapter{A}\section{B}\subsection{C}", [(1, True), (2, True), (3, True)]),
        ("thesis-own", r"\chapter{A}\section{B}", [(1, True), (2, True)]),
        ("book", r"\part{P}\chapter{A}\section{B}\subsection{C}", [(1, True), (2, True), (3, True), (4, True)]),
        ("report", r"\chapter{A}\section{B}\subsection{C}\subsubsection{D}", [(1, True), (2, True), (3, True), (4, False)]),
        ("article", r"\section*{A}", [(1, False)]),
    ],
)
def test_levels(cls, body, want):
    assert heads(tex(body, cls)) == want


def test_latex_paragraphs_lists_and_floats():
    d = tex("\\paragraph{RQ1: when} because\n\nRQ1: typed\n\nRQ2: typed\n\n\\begin{itemize}\\item one \\item[x] two\\end{itemize}")
    assert types(d) == ["paragraph", "list_item", "list_item", "list_item", "list_item"] and [b.real for b in d.blocks] == [None, False, False, True, True]
    d = tex(r"\begin{table*}\caption{T}\centering\begin{tabular}{ll}a&b\end{tabular}\end{table*}\begin{figure*}[t]\includegraphics[width=\textwidth]{f.png}\caption{Stages of the \emph{sorting} line~\cite{x}}\end{figure*}")
    assert [(b.type, b.kind) for b in d.blocks] == [("caption", "table"), ("table", None), ("figure", None), ("caption", "figure")]
    assert d.blocks[3].text == "Stages of the sorting line"
    d = tex("% \\section{no}\n\\begin{lstlisting}\na = b * c % $\n\\end{lstlisting}\nv = s / t * 3\n\nsee $x$ here\n\n\\[y\\]\\begin{align}z\\end{align}\\includegraphics{a.png}\n\nPrice 5\\% \\unknown{kept}")
    assert [(b.type, b.real) for b in d.blocks] == [("equation", False), ("equation", True), ("equation", True), ("equation", True), ("figure", None), ("paragraph", None)]
    assert d.blocks[-1].text == "Price 5% kept"
    d = tex("\\begin{titlepage}\\vspace{2cm}\\includegraphics[width=3cm]{a/b=c.png}\\end{titlepage}")
    assert all("cm" not in b.text and b.type != "equation" for b in d.blocks)
    d = tex(r"Text\footnote{$x$} more\footnote{a = b + c}\footnote{plain}")
    assert [(b.type, b.real) for b in d.blocks] == [("paragraph", None), ("equation", True), ("equation", False)]


def test_latex_counters_and_contents():
    d = tex(r"\tableofcontents\section{A}\section*{B}\subsection{C}", before=r"\setcounter{secnumdepth}{0}\setcounter{tocdepth}{1}")
    assert heads(d) == [(1, False), (1, False), (2, False)] and d.toc_present and d.toc_anchors == d.heading_bookmarks == ["sec0"]
    assert latex.extract("no document here", P).blocks == []


def test_includes():
    files = {"p/a.tex": r"\section{A}\input{sub/b}", "p/sub/b.tex": r"\section{B}\include{c.tex}", "p/sub/c.tex": r"\input{main}\section{C}"}
    main = r"\documentclass{article}\begin{document}\input{a}\input{missing}\input{a}\includegraphics{x}\input{main}\end{document}"
    d = latex.extract(latex.expanded(main, "p/main.tex", files.get), P)
    assert [b.text for b in d.blocks if b.type == "heading"] == ["A", "B", "C"] and "figure" in types(d)


NS = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0" xmlns:svg="urn:oasis:names:tc:opendocument:xmlns:svg-compatible:1.0" xmlns:xlink="http://www.w3.org/1999/xlink"'


def odf(body, styles=""):
    return ET.fromstring(f"<office:document {NS}><office:styles>{styles}</office:styles><office:text>{body}</office:text></office:document>")


def test_odt_text_and_numbering():
    seen = lambda x: odt.visible_text(odf(x)[1][0])
    assert seen("<text:h>4<text:tab/>Outlook</text:h>") == "4 Outlook"
    assert seen("<text:p><draw:frame><svg:desc>a photograph</svg:desc></draw:frame></text:p>") == ""
    assert seen("<text:p>Two <text:span>spans <text:span>deep</text:span></text:span>!</text:p>") == "Two spans deep!"
    on = '<text:outline-level-style text:level="1" style:num-format="1"/>'
    off = on.replace('"1"/>', '""/>')
    style = lambda n, more="": f'<style:style style:name="{n}" {more}/>'
    numbered = lambda s, name: odt.Styles(odf("", s)).numbered(name, "1")
    assert not numbered(on + style("A", 'style:list-style-name=""'), "A")
    assert numbered(on + style("A"), "A") and not numbered(off + style("A"), "A")
    assert not numbered(on + style("P6", 'style:parent-style-name="H"') + style("H", 'style:list-style-name=""'), "P6")
    assert numbered(on + style("S", 'style:parent-style-name="S"'), "S")


ODT = """<text:table-of-content><text:p><text:a xlink:href="#_Toc1">x</text:a></text:p></text:table-of-content>
<text:h text:outline-level="2"><text:bookmark-start text:name="_Toc1"/>Intro</text:h><text:h text:outline-level="x">Bad</text:h><table:table/>
<text:list><text:list-item><text:p>a</text:p><text:list><text:list-item><text:p>b</text:p></text:list-item></text:list></text:list-item></text:list>
<text:p><draw:frame text:anchor-type="as-char"><draw:image/></draw:frame> beside</text:p><text:p><draw:frame><draw:object/></draw:frame></text:p>
<text:p>Figure <text:sequence text:name="Figure">1</text:sequence></text:p><text:p>Table 2: typed</text:p><text:p>- typed</text:p><text:p/>"""


def test_odt_blocks():
    d = odt.walk(odf(ODT), odt.Styles(), P)
    assert types(d) == ["heading", "heading", "table", "list_item", "list_item", "figure", "equation", "caption", "caption", "list_item", "paragraph"]
    assert [b.level for b in d.blocks[:2]] == [2, 1] and d.blocks[5].inline and (d.blocks[7].kind, d.blocks[7].real) == ("figure", True)
    assert d.toc_present and d.toc_anchors == d.heading_bookmarks == ["_Toc1"] and d.blocks[3].text == "ab"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def zipped(**files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x").replace("_r", ".r"), text)
    return data.getvalue()


def word():
    p = lambda x, props="": f"<w:p><w:pPr>{props}</w:pPr>{x}</w:p>"
    t = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    style = lambda s: f'<w:pStyle w:val="{s}"/>'
    body = "".join([
        p('<w:r><w:instrText>TOC \\o</w:instrText></w:r><w:hyperlink w:anchor="_Toc1"/><w:hyperlink w:anchor="other"/>' + t("x")),
        p('<w:bookmarkStart w:name="_Toc1"/>' + t("Intro"), style("Sub")), "<w:tbl><w:tr><w:p/></w:tr></w:tbl><w:sdt><w:p/></w:sdt>",
        p(t("Table ") + '<w:fldSimple w:instr=" SEQ Table "/>'), p("<w:drawing/>"), p(t("see ") + "<w:drawing/>"), p("<m:oMath/>"),
        p(t("item"), '<w:numPr><w:numId w:val="3"/></w:numPr>'), p(t("- typed"), '<w:numPr><w:numId w:val="0"/></w:numPr>'), p(t("Body"), '<w:outlineLvl w:val="9"/>'),
    ])
    styles = '<w:style w:styleId="Sub"><w:name w:val="heading 2"/><w:basedOn w:val="Base"/></w:style><w:style w:styleId="Base"><w:basedOn w:val="Sub"/><w:pPr><w:outlineLvl w:val="1"/><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style>'
    rels = '<Relationships><Relationship Type="http://x/footnotes" Target="footnotes.xml"/></Relationships>'
    files = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>", "word/_rels/document.xml.rels": rels, "word/footnotes.xml": f"<w:footnotes {W}>{p('<m:oMath/>')}{p(t('a = b * c'))}{p(t('plain'))}</w:footnotes>"}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return data.getvalue()


def test_docx_blocks():
    d = docx.extract(word(), P)
    assert types(d) == ["paragraph", "heading", "table", "caption", "figure", "figure", "equation", "list_item", "list_item", "paragraph", "equation", "equation"]
    h = d.blocks[1]
    assert (h.level, h.numbered, h.style_name, h.text) == (2, True, "heading 2", "Intro")
    assert (d.blocks[3].kind, d.blocks[3].real) == ("table", True) and [b.inline for b in d.blocks[4:6]] == [False, True]
    assert [b.real for b in d.blocks[7:9]] == [True, False] and [b.real for b in d.blocks[10:]] == [True, False]
    assert d.toc_present and d.toc_anchors == ["_Toc1"] and d.heading_bookmarks == ["_Toc1"]


# One assignment in growing order: each step mends one thing (golden counts by check).
LADDER = [
    ("Introduction\n\nRQ1: a\n\nRQ2: b\n\nRQ3: c", {"heading-hierarchy": 1, "toc-present": 1, "list-formatting": 3}),
    ("\\section{1 Intro}\\section{2. Work}RQ1: a\n\nRQ2: b\n\nRQ3: c", {"heading-numbering": 2, "toc-present": 1, "list-formatting": 3}),
    ("\\tableofcontents\\section{1 Intro}\\section{2 Work}RQ1: a\n\n- b", {"heading-numbering": 2, "list-formatting": 2}),
    ("\\tableofcontents\\section*{Intro}RQ1: a", {"toc-linked": 1, "list-formatting": 1}),
    ("\\tableofcontents\\section{Intro}\\begin{enumerate}\\item a\\end{enumerate}", {}),
]


def test_corpus_cli_and_stream(spark, tmp_path, capsys):
    root = tmp_path / "in"
    for i, (body, _) in enumerate(LADDER):
        (root / f"v{i}").mkdir(parents=True)
        number = "\\setcounter{secnumdepth}{0}" if "1 Intro" in body else ""
        (root / f"v{i}" / "main.tex").write_text(f"\\documentclass{{article}}{number}\\begin{{document}}\\input{{body}}\\end{{document}}")
        (root / f"v{i}" / "body.tex").write_text(body)
    (root / "w.DOCX").write_bytes(word())
    (root / "o.odt").write_bytes(zipped(content_xml=ET.tostring(odf(ODT)), styles_xml=ET.tostring(odf(""))))
    (root / "broken.odt").write_bytes(b"no zip")
    (root / "note.txt").write_text("x")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    rows = extracted(files.select("path", "content")).persist()
    assert {r.path.rsplit("/", 1)[1]: r.error for r in rows.where("error is not null").collect()} .keys() == {"broken.odt", "note.txt"}
    c = corpus_of(rows)
    counts = {r.path: {} for r in c.docs.collect()}
    for r in run.issue_counts(run.run_checks(c)).join(c.docs, "doc_id").collect():
        counts[r.path][r.check] = r.n
    assert [next(v for k, v in counts.items() if f"/v{i}/" in k) for i in range(len(LADDER))] == [want for _, want in LADDER]
    assert len(counts) == len(LADDER) + 2 and read_corpus(spark, str(root / "v4")).docs.count() == 1
    out = str(tmp_path / "out")
    watch(spark, str(root), out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == run.run_checks(c).count()
    assert cli.main([str(root / "v4" / "main.tex")], spark) == 0 and "No structural issues found." in capsys.readouterr().out
    assert cli.main([str(root / "v0" / "main.tex"), "--json"], spark) == 1 and '"passed": false' in capsys.readouterr().out
    assert cli.main([str(root / "note.txt")], spark) == 2


def test_registry():
    assert supported_extensions() == [".docx", ".odt", ".tex"] and extractor_for("a/B.DOCX") and extractor_for("a.pdf") is None


def test_lists_of_any_shape():
    texts = lambda body: [b.text for b in tex(body).blocks]
    assert texts(r"\begin{itemize}\end{itemize}") == []
    assert texts(r"\begin{itemize}\item a\begin{itemize}\item b\end{itemize}\begin{enumerate}\item c\item d\end{enumerate}\item e\end{itemize}") == ["a b c d", "b", "c", "d", "e"]
    assert texts(r"\begin{enumerate}[i]{\small \item p \item q}\item r\end{enumerate}") == ["p", "q", "r"]


def test_deep_nesting():
    assert [b.text for b in tex("{" * 3000 + "deep" + "}" * 3000).blocks] == ["deep"]
    assert [b.text for b in tex(r"\textbf{" * 3000 + "deep" + "}" * 3000).blocks] == ["deep"]


@pytest.mark.parametrize("root", ["hdfs://nn:8020/p", "s3a://bucket", "file:/p", "file:///p", "/p", "p"])
def test_include_paths(root):
    files = {f"{root}/sub/b.tex": r"\section{B}\input{../c}", f"{root}/c.tex": r"\section{C}"}
    main = r"\documentclass{article}\begin{document}\input{sub/b}\end{document}"
    assert latex.included(main, f"{root}/main.tex") == [f"{root}/sub/b.tex"]
    assert [b.text for b in latex.extract(latex.expanded(main, f"{root}/main.tex", files.get), P).blocks] == ["B", "C"]


def test_each_main_file_gets_its_own_includes(spark):
    main = lambda *names: r"\documentclass{article}\begin{document}" + "".join(rf"\input{{{n}}}" for n in names) + r"\end{document}"
    files = {f"/flat/m{i}.tex": main(f"part{i}", "shared") for i in range(5)} | {f"/flat/part{i}.tex": rf"\section{{Part {i}}}" for i in range(5)}
    files |= {"/flat/shared.tex": r"\input{deep/one}", "/flat/deep/one.tex": r"\input{two}", "/flat/deep/two.tex": r"\section{Two}\input{one}", "/flat/deep/own.tex": main("two", "../part0")}
    rows = extracted(spark.createDataFrame([(p, t.encode()) for p, t in files.items()], "path string, content binary"))
    got = {r.path: [b.text for b in r.blocks] for r in rows.collect()}
    assert got == {f"/flat/m{i}.tex": [f"Part {i}", "Two"] for i in range(5)} | {"/flat/deep/own.tex": ["Two", "Part 0"]}


def test_unread_files_have_status_two(spark):
    rows = extracted(spark.createDataFrame([("/a.docx", word()), ("/b.odt", b"none"), ("/c.txt", b"x")], "path string, content binary"))
    c = corpus_of(rows)
    got = run.status(c.docs, run.run_checks(c), c.errors).join(c.docs.select("doc_id", "path").unionByName(c.errors.select("doc_id", "path")), "doc_id")
    assert {r.path: r.exit_status for r in got.collect()} == {"/a.docx": 1, "/b.odt": 2, "/c.txt": 2}
    assert {r.path: r.error.split(":")[0] for r in c.errors.collect()} == {"/b.odt": "BadZipFile", "/c.txt": "unsupported"}


def test_odt_outline_is_that_of_the_styles_file():
    on = '<text:outline-level-style text:level="1" style:num-format="1"/>'
    assert odt.Styles(odf("", on), odf("")).numbered(None, "1") and not odt.Styles(odf(""), odf("", on)).numbered(None, "1")


def test_html_and_conversations(spark):
    page = """<head><title>no</title></head><nav><a href="#one">One</a></nav><H2 id=one>One &amp; <b>all</b></h2><p>a<br>b<!-- c --><img src=x> beside
<table><caption>Rows</caption><tr><td>cell</td></tr></table><figure><img src=y><figcaption>A view</figcaption></figure><math>x</math><li>item<li>- two<p>Table 3: typed</p><script>no()</script>"""
    c = html.html_corpus(spark.createDataFrame([(1, "http://x/", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string"), P)
    got = [(r.type, r.text, r.level, r.kind, r.real, r.inline) for r in c.blocks.orderBy("index").collect()]
    assert got == [
        ("heading", "One & all", 2, None, None, False), ("paragraph", "a b", None, None, None, False), ("figure", "beside", None, None, None, True), ("table", "", None, None, None, False),
        ("caption", "Rows", None, "table", True, False), ("figure", "", None, None, None, False), ("caption", "A view", None, "figure", True, False), ("equation", "x", None, None, True, False),
        ("list_item", "item", None, None, True, False), ("list_item", "- two", None, None, True, False), ("caption", "Table 3: typed", None, "table", False, False),
    ]
    assert {r.doc_id: (r.toc_present, r.toc_anchors, r.heading_bookmarks) for r in c.docs.collect()}[1] == (True, ["one"], ["one"])
    turns = spark.createDataFrame([(7, 1, "bot", "- yes"), (7, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert [(r["index"], r.type, r.text, r.style_name, r.real) for r in conversations.conversation_blocks(turns, P).orderBy("index").collect()] == [(0, "paragraph", "", "user", None), (1, "list_item", "- yes", "bot", False)]


def test_study_rows_are_appended(spark, tmp_path):
    import datetime

    c = corpus_of(extracted(spark.createDataFrame([("/in/a.docx", word())], "path string, content binary")))
    doc = c.docs.first().doc_id
    sessions = spark.createDataFrame([("P1", doc, datetime.datetime(2020, 1, 2, 3, 4)), ("P2", doc, datetime.datetime(2020, 1, 2, 3, 4))], "participant string, doc_id long, time timestamp")
    answers = spark.createDataFrame([(p, i, 1 + i % 7) for p, n in (("P1", 8), ("P2", 7)) for i in range(n)], "participant string, item int, answer int")
    rows = study.study_rows(sessions, c.docs, run.run_checks(c), answers)
    for _ in range(2):
        study.append_rows(rows, str(tmp_path / "sheet"))
    out = spark.read.option("header", True).csv(str(tmp_path / "sheet"))
    assert out.columns == study.columns() and out.count() == 2
    r = out.first()
    assert (r["Time"], r["Participant ID"], r["File name"], r["Pragmatic Quality (1-7)"], r["Hedonic Quality (1-7)"]) == ("2020-01-02 03:04 UTC", "P1", "a.docx", "2.5", "4.75")


def test_block_dump_and_example_files(spark, tmp_path, capsys):
    from pathlib import Path

    from pagewright.config import load_structure, load_styles

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "main.tex").write_text(r"\documentclass{article}\begin{document}\section{Other}\end{document}")
    (tmp_path / "main.tex").write_text(r"\documentclass{article}\begin{document}\section{Mine}\begin{figure}\includegraphics{x}\caption{View}\end{figure}- typed\end{document}")
    assert cli.main([str(tmp_path / "main.tex"), "--blocks"], spark) == 0
    assert [x.split() for x in capsys.readouterr().out.splitlines()] == [["0", "heading", "L1", "Mine", "(numbered)"], ["1", "figure"], ["2", "caption", "View", "(figure,", "real)"], ["3", "list_item", "-", "typed", "(typed)"]]
    there = Path(__file__).parent.parent / "examples"
    styles = load_styles(str(there / "styles.json"))
    assert styles["checks"] == {"inline-image": False} and compile_patterns(styles).kinds["fig"] == "figure" and compile_patterns(styles).is_list_item("H2: x")
    assert [len(load_structure(str(there / n))["sections"]) for n in ("structure.json", "no_sections.json")] == [4, 0]
    args = [str(tmp_path / "main.tex"), "--json", "--structure", str(there / "structure.json"), "--styles", str(there / "styles.json")]
    assert cli.main(args, spark) == 1 and "Conclusion" in capsys.readouterr().out
