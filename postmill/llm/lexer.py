"""Name-literal pairs of source and configuration syntax, in one pass over the text.

Strings may hold escapes or be triple-quoted, comments are passed over, maps and
lists give their names to what they hold, by brackets or by indentation. Each character is
looked at a bounded number of times, whatever the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

QUOTES = "\"'`"
_TOKEN = re.compile(r"""(?P<word>[A-Za-z0-9_$][A-Za-z0-9_.$/+-]*)|(?P<quote>["'`])|(?P<open>[\[{(])|(?P<close>[\]})])|(?P<line>\n)|(?P<no>[=!<>]=+)|(?P<sign>=>|:=|=|:)|(?P<note>//|/\*|\#|<!--)|(?P<part>[,;])""")
_BARE = re.compile(r"[A-Za-z0-9+/_.$=-]+")
_BLANKS = re.compile(r"[ \t]*")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\|\|)[ \t]*(?=[\"'`A-Za-z_])")
_TYPED = re.compile(r"[ \t]*(?:=|:=)(?!=)")
_BODIES = {quote: re.compile(rf"[^{quote}\\\n]*(?:\\.[^{quote}\\\n]*)*") for quote in QUOTES}
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*\Z")
_LETTERS = re.compile(r"[A-Za-z0-9_]")
#: Letters before a quote that say how the string is read.
_PREFIXES = frozenset(["r", "b", "f", "u", "rb", "br", "fr", "rf"])


class Binding(NamedTuple):
    """A name, the greatest weight of the names of the maps around it, and the pieces (is literal, start, end) of its value."""

    name: str
    around: float
    pieces: list[tuple[bool, int, int]]


class _Strings:
    """Strings of one text; a quote that is never closed is looked for once."""

    def __init__(self, text: str):
        self.text, self.open_until, self.unclosed = text, dict.fromkeys(QUOTES, -1), set()

    def at(self, start: int) -> tuple[int, int, int] | None:
        """Body and end of the string that opens at `start`, None if it does not close."""
        text, quote = self.text, self.text[start]
        triple = quote * 3
        if quote != "`" and text.startswith(triple, start) and triple not in self.unclosed:
            end = text.find(triple, start + 3)
            if end >= 0:
                return start + 3, end, end + 3
            self.unclosed.add(triple)
        if start < self.open_until[quote]:
            return None
        end = _BODIES[quote].match(text, start + 1).end()
        if text[end : end + 1] != quote:
            self.open_until[quote] = end
            return None
        return start + 1, end, end + 1


class _Maps:
    """Open brackets and indented blocks, each with its name and the greatest weight of its name and those around it."""

    def __init__(self, weigh: Callable[[str], float]):
        self.weigh, self.open = weigh, [("", -1, "", 0.0)]
        self.count = Counter()

    def enter(self, closing: str, indent: int, name: str) -> None:
        self.open.append((closing, indent, name, max(self.open[-1][3], self.weigh(name) if name else 0.0)))
        self.count[closing] += 1

    def leave(self, closing: str) -> None:
        """Close the innermost bracket of this kind, and what is open within it; without one do nothing."""
        while self.count[closing]:
            last = self.open.pop()[0]
            self.count[last] -= 1
            if last == closing:
                return

    def dedent(self, indent: int) -> None:
        while self.open[-1][0] == "" and self.open[-1][1] >= indent:
            self.open.pop()
            self.count[""] -= 1


def bindings(text: str, weigh: Callable[[str], float] = lambda name: 0.0) -> Iterator[Binding]:
    """Bindings in order of the text. A value that names a map or list is told by what that holds."""
    strings, maps = _Strings(text), _Maps(weigh)
    unclosed: set[str] = set()
    last: tuple[int, int, int] | None = None  # start and end of a name, and where it stops
    indent, at = 0, 0
    while found := _TOKEN.search(text, at):
        kind, start, at = found.lastgroup, found.start(), found.end()
        if kind == "word":
            last = (start, at, at)
        elif kind == "quote":
            if text[start] == "'" and start and text[start - 1].isalnum() and text[start - 2 : start].strip("rbfuRBFU( ,="):
                continue
            string = strings.at(start)
            if string:
                last, at = string, string[2]
                closing, _, name, heaviest = maps.open[-1]
                if closing == "]" and name:
                    yield Binding(name, heaviest, [(True, string[0], string[1])])
        elif kind == "note":
            at = _after_comment(text, start, found[0], unclosed) or at
        elif kind == "line":
            last, indent = None, _BLANKS.match(text, at).end() - at
            if text[at + indent : at + indent + 1] not in ("", "\n", "#"):
                maps.dedent(indent)
        elif kind == "open":
            maps.enter(_closing(found[0]), indent, "")
            last = None
        elif kind == "close":
            maps.leave(found[0])
            last = None
        elif kind == "sign":
            name, last = last, None
            if name and not text[name[2] : start].strip(" \t"):
                title = text[name[0] : name[1]].strip(".-/+")
                value = _BLANKS.match(text, at).end()
                head = text[value : value + 1]
                if head in ("{", "["):
                    maps.enter(_closing(head), indent, title)
                    at = value + 1
                elif head in ("\n", "") and found[0] == ":":
                    maps.enter("", indent, title)
                elif title:
                    pieces, at = _value(text, value, strings)
                    if pieces:
                        yield Binding(title, maps.open[-1][3], pieces)
        else:
            last = None


def _closing(bracket: str) -> str:
    return {"{": "}", "[": "]", "(": ")"}[bracket]


def _after_comment(text: str, start: int, mark: str, unclosed: set[str]) -> int | None:
    """Where the comment at `start` ends, None if it is none."""
    if mark in ("/*", "<!--"):
        close = "*/" if mark == "/*" else "-->"
        end = -1 if mark in unclosed else text.find(close, start + len(mark))
        if end < 0:
            unclosed.add(mark)
            return None
        return end + len(close)
    before = text[start - 1] if start else "\n"
    if mark == "//" and before == ":" or mark == "#" and not before.isspace():
        return None
    end = text.find("\n", start)
    return len(text) if end < 0 else end


def _value(text: str, at: int, strings: _Strings) -> tuple[list[tuple[bool, int, int]], int]:
    """Pieces of the value at `at`, and where it ends."""
    pieces: list[tuple[bool, int, int]] = []
    while True:
        head = text[at : at + 1]
        if head and head in QUOTES:
            string = strings.at(at)
            if not string:
                return pieces, at
            pieces.append((True, string[0], string[1]))
            at = string[2]
        else:
            bare = _BARE.match(text, at)
            if not bare:
                return pieces, at
            if bare[0].lower() in _PREFIXES and text[bare.end() : bare.end() + 1] in ("'", '"'):
                at = bare.end()
                continue
            typed = _TYPED.match(text, bare.end()) if not pieces and _IDENTIFIER.match(bare[0]) else None
            if typed:  # the type of a name; its value follows
                at = _BLANKS.match(text, typed.end()).end()
                if text[at : at + 1] in ("{", "[", "\n", ""):
                    return [], at
                continue
            at = bare.end()
            if text[at : at + 1] != "(":
                literal = not _IDENTIFIER.match(bare[0]) or any(c.isdigit() for c in bare[0])
                pieces.append((literal, bare.start(), bare.end()))
        joined = _JOIN.match(text, at)
        if joined:
            at = joined.end()
            continue
        beside = _BLANKS.match(text, at).end()
        if pieces and pieces[-1][0] and text[beside : beside + 1] in ("'", '"') and text[at - 1] in QUOTES:
            at = beside
            continue
        return pieces, at
