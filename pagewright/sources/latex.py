"""Reader of LaTeX: a small parser of groups, commands, environments and math, and a walk over its tree."""

from __future__ import annotations

import posixpath
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .model import Document

# Names that decide how LaTeX is read.
CHAPTER_CLASSES = set("report book memoir scrreprt scrbook thesis extreport extbook mwrep mwbk".split())
SECTIONING = ["part", "chapter", "section", "subsection", "subsubsection"]
RUN_IN = {"paragraph", "subparagraph"}
INVISIBLE = set(
    "includegraphics label ref pageref eqref autoref nameref cite citep citet nocite bibliography bibliographystyle usepackage documentclass "
    "newcommand renewcommand providecommand DeclareOldFontCommand definecolor setcounter addtocounter setlength addtolength hspace vspace rule "
    "usetikzlibrary geometry hypersetup graphicspath captionsetup pagestyle thispagestyle".split()
)
DISPLAY_MATH = set("$$ displaymath equation equation* align align* gather gather* multline eqnarray".split())
LISTS = {"itemize", "enumerate", "description"}
TABULARS = {"tabular", "tabular*", "tabularx", "longtable", "array"}
CODE = set("verbatim verbatim* lstlisting minted Verbatim alltt listing code".split())
SKIPPED = set("label centering newpage clearpage pagebreak noindent vspace hspace maketitle index".split())
INCLUDE = re.compile(r"\\(?:input|include)(?![a-zA-Z])\s*\{([^}]*)\}")
ROOT = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/*")
COMMAND = re.compile(r"\\([a-zA-Z@]+)(\*?)|\\(.)", re.DOTALL)
#: Levels of nesting that a document may have, about.
DEEPEST = 100_000


@dataclass
class Node:
    """kind: text, group, command, environment or math; args are lists of nodes, each with its raw text."""

    kind: str
    name: str = ""
    text: str = ""
    args: list[Node] = field(default_factory=list)
    body: list[Node] = field(default_factory=list)


class Parser:
    def __init__(self, source: str) -> None:
        self.s, self.i = source, 0

    def nodes(self, stop: str | None = None) -> list[Node]:
        """Nodes up to stop: a closing character, or the name of the environment that is open."""
        out: list[Node] = []
        outer: list[list[Node]] = []  # of the groups that are open
        s = self.s
        while self.i < len(s):
            c = s[self.i]
            if c == stop and len(stop) == 1 and stop in "}]" and not (outer and c == "}"):
                self.i += 1
                break
            if c == "%":
                end = s.find("\n", self.i)
                self.i = len(s) if end < 0 else end + 1
            elif c == "{":
                self.i += 1
                group = Node("group")
                out.append(group)
                outer.append(out)
                out = group.body
            elif c == "}":
                self.i += 1
                out = outer.pop() if outer else out
            elif c == "$":
                out.append(self._math("$$" if s.startswith("$$", self.i) else "$"))
            elif c == "\\":
                if stop and s.startswith(f"\\end{{{stop}}}", self.i):
                    self.i += len(stop) + 6
                    break
                out.append(self._command())
            else:
                m = re.compile(r"[^%{}$\\\]]+|\]").match(s, self.i)
                self.i = m.end()
                out.append(Node("text", text=m[0]))
        return outer[0] if outer else out

    def _math(self, mark: str, close: str | None = None, name: str | None = None) -> Node:
        start = self.i + len(mark)
        end = self.s.find(close or mark, start)
        while end > 0 and self.s[end - 1] == "\\" and mark[0] == "$":
            end = self.s.find(mark, end + 1)
        end = len(self.s) if end < 0 else end
        self.i = end + len(close or mark)
        return Node("math", name or mark, self.s[start:end])

    def _command(self) -> Node:
        m = COMMAND.match(self.s, self.i)
        if not m:
            self.i += 1
            return Node("text")
        if m[3] is not None:
            if m[3] == "[":
                return self._math("\\[", "\\]", "displaymath")
            if m[3] == "(":
                return self._math("\\(", "\\)", "$")
            self.i = m.end()
            return Node("text", text=m[3] if m[3] in "%&#_${}" else " ")
        self.i = m.end()
        if m[1] == "begin":
            return self._environment()
        if m[1] == "end":  # of something that isn't open
            self._argument()
            return Node("text")
        return Node("command", m[1] + m[2], args=list(self._arguments(m[1])))

    def _arguments(self, name: str) -> Iterator[Node]:
        while True:
            m = re.compile(r"[ \t]*\n?[ \t]*(?=[\[{])").match(self.s, self.i)
            if not m or name == "item" and self.s[m.end()] == "{":
                return
            self.i = m.end()
            yield self._argument()

    def _argument(self) -> Node:
        if self.i >= len(self.s) or self.s[self.i] not in "[{":
            return Node("group")
        kind, start = self.s[self.i], self.i + 1
        self.i += 1
        body = self.nodes("}" if kind == "{" else "]")
        return Node("group", kind, self.s[start : self.i - 1], body=body)

    def _environment(self) -> Node:
        name = self._argument().text
        close = f"\\end{{{name}}}"
        if name in CODE or name in DISPLAY_MATH or name == "math":
            end = self.s.find(close, self.i)
            text = self.s[self.i : end if end >= 0 else len(self.s)]
            self.i += len(text) + len(close)
            return Node("environment" if name in CODE else "math", "$" if name == "math" else name, text)
        # a group that follows a list's begin is its content
        args = [] if name == "document" else list(self._arguments("item" if name in LISTS else "env"))
        return Node("environment", name, args=args, body=self.nodes(name))


def flat(nodes: list[Node]) -> str:
    out = []
    for n in nodes:
        if n.kind in ("text", "math"):
            out.append(n.text)
        elif n.kind == "command":
            out.append("" if n.name.rstrip("*") in INVISIBLE else flat(n.args) or " ")
        elif not (n.kind == "environment" and n.name in CODE):
            out.append(flat(n.body))
    return "".join(out)


def clean(text: str) -> str:
    return " ".join(text.replace("~", " ").split())


def every(nodes: list[Node]) -> Iterator[Node]:
    for n in nodes:
        yield n
        yield from every(n.args)
        yield from every(n.body)


def ungrouped(nodes: list[Node]) -> Iterator[Node]:
    """nodes, with those of a group that has items in its place."""
    for n in nodes:
        if n.kind == "group" and any(x.name == "item" for x in n.body):
            yield from ungrouped(n.body)
        else:
            yield n


def outermost_lists(nodes: list[Node]) -> Iterator[Node]:
    for n in nodes:
        if n.kind == "environment" and n.name in LISTS:
            yield n
        else:
            yield from outermost_lists(n.args)
            yield from outermost_lists(n.body)


def beside(folder: str, name: str) -> str:
    """The path of the file that a document in folder includes by name; a scheme and host stay as they are."""
    root = ROOT.match(folder)[0]
    inside = folder[len(root) :]
    full = posixpath.normpath("/" + posixpath.join(inside, name if posixpath.splitext(name)[1] else name + ".tex").lstrip("/"))
    return root + ("/" if folder and folder == root.rstrip("/") else "") + full[1:]


def included(source: str, path: str) -> list[str]:
    """Paths that source names in includes, whether or not there are such files."""
    return [beside(posixpath.dirname(path), m[1].strip()) for m in INCLUDE.finditer(source)]


def expanded(source: str, path: str, read: Callable[[str], str | None]) -> str:
    """source with included files in place, each once; read gives a path's text or None."""
    seen = {path}

    def put(text: str, base: str) -> str:
        def one(m: re.Match) -> str:
            target = beside(base, m[1].strip())
            if target in seen:
                return ""
            found = read(target)
            if found is None:
                return ""
            seen.add(target)
            return put(found, posixpath.dirname(target))

        return INCLUDE.sub(one, text)

    return put(source, posixpath.dirname(path))


class Walker:
    def __init__(self, tree: list[Node], patterns) -> None:
        self.out, self.patterns = Document(), patterns
        used = {n.name.rstrip("*") for n in every(tree) if n.kind == "command"}
        classes = [n.args[-1].text.strip().lower() for n in every(tree) if n.kind == "command" and n.name == "documentclass" and n.args]
        chapters = "chapter" in used or bool(classes) and classes[0] in CHAPTER_CLASSES
        levels = [x for x in SECTIONING if (x != "chapter" or chapters) and (x != "part" or "part" in used)]
        self.depth = {x: i + 1 for i, x in enumerate(levels)}
        self.latex_level = {"part": -1, "chapter": 0} if chapters else {"part": 0}
        self.latex_level |= {"section": 1, "subsection": 2, "subsubsection": 3}
        default = 2 if chapters else 3
        self.secnumdepth, self.tocdepth = (self._counter(tree, c, default) for c in ("secnumdepth", "tocdepth"))
        self.buffer, self.flags, self.notes = [], set(), []
        self.listed: list[bool] = []

    @staticmethod
    def _counter(tree: list[Node], name: str, default: int) -> int:
        for n in every(tree):
            if n.kind == "command" and n.name == "setcounter" and len(n.args) == 2 and n.args[0].text.strip() == name and re.fullmatch(r"\s*[+-]?\d+\s*", n.args[1].text):
                return int(n.args[1].text)
        return default

    def flush(self) -> None:
        text, flags = clean("".join(self.buffer)), self.flags
        self.buffer, self.flags = [], set()
        if "math" in flags:
            self.out.add("equation", text, real=True)
        elif "image" in flags:
            self.out.add("figure", text, inline=bool(text))
        elif text and "run-in" in flags:
            self.out.add("paragraph", text)
        elif text:
            self.out.add_typed(self.patterns, text)

    def feed(self, text: str) -> None:
        first, *rest = re.split(r"\n[ \t]*\n\s*", text)
        self.buffer.append(first)
        for part in rest:
            self.flush()
            self.buffer.append(part)

    def caption(self, n: Node, kind: str) -> None:
        self.out.add("caption", clean(flat(n.args[-1:])), kind=kind, real=True)

    def walk(self, nodes: list[Node]) -> None:
        for n in nodes:
            name = n.name.rstrip("*")
            if n.kind == "text":
                self.feed(n.text)
            elif n.kind == "math":
                if n.name in DISPLAY_MATH:
                    self.flush()
                    self.out.add("equation", clean(n.text), real=True)
                else:
                    self.flags.add("math")
                    self.buffer.append(n.text)
            elif n.kind == "group":
                self.walk(n.body)
            elif n.kind == "environment":
                self.environment(n)
            elif name in self.depth:
                self.heading(n, name)
            elif name in RUN_IN:
                self.flags.add("run-in")
                self.buffer.append(flat(n.args[-1:]) + " ")
            elif name == "tableofcontents":
                self.flush()
                self.out.toc_present = True
            elif name == "par":
                self.flush()
            elif name == "footnote":
                self.notes.append(n)
            elif name == "includegraphics":
                self.flags.add("image")
            elif name not in SKIPPED:
                self.buffer.append(flat([n]))

    def heading(self, n: Node, name: str) -> None:
        self.flush()
        starred = n.name.endswith("*")
        self.out.add("heading", clean(flat(n.args[-1:])), level=self.depth[name], numbered=not starred and self.latex_level[name] <= self.secnumdepth, numbering_optional=True)
        self.listed.append(not starred and self.latex_level[name] <= self.tocdepth)

    def environment(self, n: Node) -> None:
        name = n.name
        if name in CODE:
            self.flush()
        elif name in LISTS:
            self.flush()
            self.items(n.body)
        elif name.rstrip("*") in ("table", "figure"):
            self.flush()
            kind = name.rstrip("*")
            for c in n.body:
                if c.kind == "command" and c.name.rstrip("*") == "caption":
                    self.caption(c, kind)
                elif kind == "table" and c.kind == "environment" and c.name in TABULARS:
                    self.out.add("table")
                elif kind == "figure" and c.kind == "command" and c.name.rstrip("*") == "includegraphics":
                    self.out.add("figure")
        else:
            self.buffer.append(flat([n]))

    def items(self, nodes: list[Node]) -> None:
        """Each item with all its text; items of lists inside it, however many, follow it."""
        held = list(ungrouped(nodes))
        at = [i for i, n in enumerate(held) if n.kind == "command" and n.name == "item"]
        for a, z in zip(at, [*at[1:], len(held)]):  # noqa: B905  without items there is no first
            inside = held[a + 1 : z]
            self.out.add("list_item", clean(flat(held[a].args) + " " + flat([x for x in inside if x.name != "item"])), real=True)
            for x in outermost_lists(inside):
                self.items(x.body)

    def finish(self) -> Document:
        self.flush()
        for n in self.notes:
            body = n.args[-1].body if n.args else []
            text = clean(flat(body))
            if any(x.kind == "math" for x in body):
                self.out.add("equation", text, real=True)
            elif self.patterns.is_equation(text):
                self.out.add("equation", text, real=False)
        if self.out.toc_present:
            names = [f"sec{i}" for i, there in enumerate(self.listed) if there]
            self.out.toc_anchors, self.out.heading_bookmarks = list(names), list(names)
        return self.out


def extract(source: str, patterns) -> Document:
    """The document of a main file's text with its includes in place; nesting may be as deep as DEEPEST."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, DEEPEST))
    try:
        return _extract(source, patterns)
    finally:
        sys.setrecursionlimit(limit)


def _extract(source: str, patterns) -> Document:
    tree = Parser(source).nodes()
    walker = Walker(tree, patterns)
    for n in tree:
        if n.kind == "environment" and n.name == "document":
            walker.walk(n.body)
    return walker.finish()
