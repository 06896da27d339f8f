"""What a reader gives for one document, and the classification that the office formats share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

Style, Value = TypeVar("Style"), TypeVar("Value")


@dataclass
class Block:
    index: int
    type: str
    text: str = ""
    style_name: str | None = None
    level: int | None = None
    numbered: bool = False
    numbering_optional: bool = False
    kind: str | None = None
    real: bool | None = None
    inline: bool = False


@dataclass
class Document:
    blocks: list[Block] = field(default_factory=list)
    toc_present: bool = False
    toc_anchors: list[str] = field(default_factory=list)
    heading_bookmarks: list[str] = field(default_factory=list)

    def add(self, type: str, text: str = "", **more: object) -> Block:
        block = Block(len(self.blocks), type, text, **more)
        self.blocks.append(block)
        return block

    def add_typed(self, patterns, text: str, **more: object) -> Block:
        """A paragraph that is what its text looks like; only a plain paragraph has no `real`."""
        type_, kind = patterns.typed(text)
        return self.add(type_, text, kind=kind, real=None if type_ == "paragraph" else False, **more)


def first_along(start: str | None, styles: dict[str, Style], parent: Callable[[Style], str | None], value: Callable[[Style], Value | None]) -> Value | None:
    """The first value there is on the way from a style to what it goes back to; a loop ends the way."""
    way: dict[str, Style] = {}
    while start in styles and start not in way:
        way[start] = styles[start]
        start = parent(styles[start])
    return next((found for style in way.values() if (found := value(style)) is not None), None)
