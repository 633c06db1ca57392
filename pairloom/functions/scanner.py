"""Rust comments of one text in one pass, however deep they nest.

Column patterns (:mod:`pairloom.functions.text`) cannot match balanced brackets, and search the
rest of a text again for each raw string that is never closed.  Texts with one or the other
come here; they are few.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql.functions import udf

# Where a literal or a comment may begin in code.  Character literals are short enough to be
# matched whole, line comments end by themselves.
_BEGIN = r"""
    (?P<raw>(?<![A-Za-z0-9_])[bc]?r(?P<hashes>\#*)")
  | (?P<quote>")
  | (?P<char>'(?:\\u\{[0-9a-fA-F_]*\}|\\x[0-9a-fA-F]{2}|\\.|[^'\\])')
  | (?P<block>/\*)
  | (?P<line>LINE)
"""
_LINE = r"//[^\n]*"
_LINE_DOC = r"//(?:/(?!/)|!)[^\n]*\n?|//[^\n]*"
_STRING = re.compile(r'"(?:[^"\\]+|\\.)*+"', re.S)
_MARK = re.compile(r"/\*|\*/")
_BEGINNINGS = {
    habit: re.compile(_BEGIN.replace("LINE", line), re.X | re.S)
    for habit, line in ((False, _LINE), (True, _LINE_DOC))
}


class _Blocks:
    """Ends of the block comments of a text, by the place of their opening.

    An opening is closed where as many closings as openings follow it, so one pass with a stack
    answers for all of them, whatever stands before.
    """

    def __init__(self, text: str):
        self.text = text
        self.ends: dict[int, int | None] = {}

    def end(self, at: int) -> int | None:
        # marks may share a character (`*/*`): an opening read otherwise is looked at anew
        if at not in self.ends:
            open_at: list[int] = []
            for mark in _MARK.finditer(self.text, at):
                if mark[0] == "/*":
                    open_at.append(mark.start())
                    self.ends[mark.start()] = None
                elif open_at:
                    self.ends[open_at.pop()] = mark.end()
        return self.ends[at]


def rust_comments(text: str, doc_newline: bool = False) -> list[tuple[int, int]]:
    """Places [start, end) of the outermost comments.

    A quote, a raw string or a block comment that is never closed is ordinary text.  Once a
    quote is open to the end, so are all after it; the same goes for raw strings with one
    number of hashes.
    """
    begin = _BEGINNINGS[doc_newline]
    blocks = _Blocks(text)
    found: list[tuple[int, int]] = []
    never_closed: set[str] = set()
    at = 0
    while token := begin.search(text, at):
        kind, start, at = token.lastgroup, token.start(), token.end()
        if kind in ("raw", "hashes"):
            close = '"' + token["hashes"]
            end = -1 if close + "r" in never_closed else text.find(close, at)
            if end < 0:
                never_closed.add(close + "r")
                at -= 1  # its quote may begin a plain string
            else:
                at = end + len(close)
        elif kind == "quote":
            string = None if kind in never_closed else _STRING.match(text, start)
            if string:
                at = string.end()
            else:
                never_closed.add(kind)
        elif kind == "line":
            found.append((start, at))
        elif kind == "block":
            end = blocks.end(start)
            at = start + 1 if end is None else end
            if end is not None:
                found.append((start, end))
    return found


def rust_pieces(text: str, doc_newline: bool = False) -> list[str]:
    """The text cut into code, comment, code, ..., code; stretches of code may be empty."""
    cuts = [0, *(place for span in rust_comments(text, doc_newline) for place in span), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def scanned_pieces(code: Column, doc_newline: bool = False) -> Column:
    """:func:`rust_pieces` of a column; null where the text is null."""
    return _by_row(lambda text: rust_pieces(text, doc_newline), "array<string>")(code)


def scanned_code(code: Column, doc_newline: bool = False) -> Column:
    """A column's texts without their comments; null where the text is null."""
    return _by_row(lambda text: "".join(rust_pieces(text, doc_newline)[::2]), "string")(code)


def _by_row(function: Callable[[str], object], kind: str):
    """A function of one text as a UDF.

    Rows come pickled, a hundred at a time: a worker holds these and the pieces of one text. An
    Arrow batch has up to 10,000 texts, and the pieces of all of them are in memory at once.
    """
    return udf(lambda text: None if text is None else function(text), kind, useArrow=False)
