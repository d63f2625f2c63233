"""The grammar of keyword queries: words, "phrases", prefixes*, AND, OR, NOT, column filters, ^ and NEAR."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from vaultspark.functions.text import MARKED, PLAIN

_FOLD = str.maketrans(MARKED, PLAIN)
_PIECE = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(){}:^*+,-])|([^\s"(){}:^*+,-]+))')


def words(text: str) -> list[str]:
    """Index words of a text on the driver, as ``functions.text.tokens`` gives them on the executors."""
    out, run = [], []
    for c in text.lower().translate(_FOLD) + " ":
        if unicodedata.category(c)[0] in "LN":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out


@dataclass(frozen=True)
class Phrase:
    """Words in a row, the last one perhaps a prefix, perhaps in some columns only or at their start."""

    words: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] = ()
    first: bool = False


@dataclass(frozen=True)
class Node:
    """and, or, not (left without right), near (phrases within ``distance`` words) or phrase."""

    op: str
    parts: tuple = field(default_factory=tuple)
    distance: int = 10

    def phrases(self) -> list[Phrase]:
        """Phrases that count for the score: all but those of what is left out."""
        if self.op == "phrase":
            return [self.parts[0]]
        return [p for part in (self.parts[:1] if self.op == "not" else self.parts) for p in part.phrases()]


class _Reader:
    def __init__(self, text: str, columns: tuple[str, ...]) -> None:
        self.columns, self.at, self.items, end = columns, 0, [], 0
        for m in _PIECE.finditer(text):
            if m.start() != end:
                raise ValueError("stray text")
            end = m.end()
            self.items.append(("string", m[1].replace('""', '"')) if m[1] is not None else ("sign", m[2]) if m[2] else ("word", m[3]))
        if text[end:].strip():
            raise ValueError("stray text")

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.items[self.at + k] if self.at + k < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.items[self.at - 1]

    def either(self, scope: tuple[str, ...]) -> Node:
        parts = [self.both(scope)]
        while self.peek() == ("word", "OR"):
            self.take()
            parts.append(self.both(scope))
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both(self, scope: tuple[str, ...]) -> Node:
        parts = [self.without(scope)]
        while True:
            if self.peek() == ("word", "AND"):
                self.take()
            elif self.peek()[0] == "end" or self.peek() in (("sign", ")"), ("word", "OR")):
                break
            parts.append(self.without(scope))
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def without(self, scope: tuple[str, ...]) -> Node:
        left = self.atom(scope)
        while self.peek() == ("word", "NOT"):
            self.take()
            left = Node("not", (left, self.atom(scope)))
        return left

    def atom(self, scope: tuple[str, ...]) -> Node:
        kind, text = self.peek()
        if (kind, text) == ("sign", "("):
            self.take()
            inner = self.either(scope)
            self.close(")")
            return inner
        if (kind, text) == ("sign", "{"):
            self.take()
            names = []
            while self.peek()[0] == "word":
                names.append(self.column(self.take()[1]))
            self.close("}")
            self.close(":")
            return self.atom(tuple(names))
        if kind == "word" and self.peek(1) == ("sign", ":"):
            name = self.column(self.take()[1])
            self.take()
            return self.atom((name,))
        if (kind, text) == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            self.at += 2
            parts, distance = [], 10
            while self.peek() != ("sign", ")"):
                if self.peek() == ("sign", ","):
                    self.take()
                    distance = int(self.take()[1])
                else:
                    parts.append(self.phrase(scope))
            self.close(")")
            return Node("near", tuple(parts), distance)
        return self.phrase(scope)

    def phrase(self, scope: tuple[str, ...]) -> Node:
        first = self.peek() == ("sign", "^")
        if first:
            self.take()
        found: list[str] = []
        while True:
            kind, text = self.peek()
            if kind not in ("word", "string") or (kind == "word" and text in ("AND", "OR", "NOT")):
                raise ValueError("a word is missing")
            self.take()
            found += words(text)
            if self.peek() != ("sign", "+"):
                break
            self.take()
        prefix = self.peek() == ("sign", "*")
        if prefix:
            self.take()
        return Node("phrase", (Phrase(tuple(found), prefix, scope, first),))

    def column(self, name: str) -> str:
        if name not in self.columns:
            raise ValueError(f"no column {name}")
        return name

    def close(self, sign: str) -> None:
        if self.peek() != ("sign", sign):
            raise ValueError(f"{sign} is missing")
        self.take()


def parse(text: str, columns: tuple[str, ...]) -> Node | None:
    """The query's tree; None if it has no word. What can't be parsed is taken as literal words, all required."""
    try:
        reader = _Reader(text, columns)
        tree = reader.either(())
        if reader.peek()[0] != "end":
            raise ValueError("stray text")
    except (ValueError, IndexError):
        tree = Node("and", tuple(Node("phrase", (Phrase((w,)),)) for w in words(text)))
    return _solid(tree)


def _solid(tree: Node) -> Node | None:
    """The tree without phrases that have no word."""
    if tree.op == "phrase":
        return tree if tree.parts[0].words else None
    parts = tuple(p for p in map(_solid, tree.parts) if p)
    if tree.op == "not":
        return Node("not", parts) if len(parts) == 2 else (parts[0] if parts and _solid(tree.parts[0]) else None)
    if tree.op == "near":
        return Node("near", parts, tree.distance) if parts else None
    return None if not parts else parts[0] if len(parts) == 1 else Node(tree.op, parts)
