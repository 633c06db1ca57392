"""Snippet text: whitespace, comments, byte ranges, fenced code.

Comments are found by a lexical rule: a comment is what the language's scanner would
skip, and comment marks inside string, character and raw-string literals are text.
``keep_macro_text`` / ``doc_newline`` switch on two habits of syntax-tree based tools
where they differ from that rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.constants import LANG_C, LANG_RUST, NBSP, WHITESPACE
from pairloom.functions.arrays import bound, running_total
from pairloom.functions.scanner import scanned_code, scanned_pieces

# Patterns have the form ``(kept)|comment``.  The kept part takes a whole stretch of code
# and literals at once, so a text has about two matches per comment; a character no
# alternative matches is stepped over and stays.  Possessive groups keep the matcher from
# recursing, so the length of a text is not limited by the stack.
#
# A quote that is not closed is an ordinary character.  The escaped quotes after it are not
# closed either, so the open forms, tried last, step over them together; otherwise each
# would search the rest of the line (C) or of the text (Rust) again.
_C_LITERAL = r"""
    "(?:[^"\\\n]+|\\.)*+"
  | '(?:[^'\\\n]+|\\.)*+'
"""
_C_OPEN = r"""
    "(?:[^"'/\\\n]+|\\["\\]|\\(?!["\\])|/(?![/*]))*+
  | '(?:[^"'/\\\n]+|\\['\\]|\\(?!['\\])|/(?![/*]))*+
"""
_C_COMMENT = r"//(?:[^\\\n]+|\\(?:\r\n|.)?+)*+ | /\*(?:[^*]+|\*(?!/))*+\*/"
# A macro's value up to the end of the line: a `//` in it belongs to the value, a block
# comment does not.
_C_MACRO = r"""
    \#[ \t]*+define[ \t]++\w++(?:\([^)\n]*+\))?+[ \t]++(?!/[/*])[^\s]
    (?:[^/\n\\]+|\\\r?\n|\\|/(?![*]))*+
"""

# Group 2 are the hashes of a raw string.
_RUST_LITERAL = r"""
    (?<![A-Za-z0-9_])[bc]?r(\#*+)".*?"\2
  | "(?:[^"\\]+|\\.)*+"
  | '(?:\\u\{[0-9a-fA-F_]*+\}|\\x[0-9a-fA-F]{2}|\\.|[^'\\])'
"""
_RUST_OPEN = r"""
    "(?:[^"'/\\]+|\\["\\]|\\(?!["\\])|/(?![/*]))*+
"""
_RUST_LINE = r"//[^\n]*+"
_RUST_LINE_DOC = r"//(?:/(?!/)|!)[^\n]*+\n?+ | //[^\n]*+"
# Letters that can start a raw string are taken only where none starts.
_RUST_PLAIN = r"""[^"'/rbc]+ | [rbc]++(?!["\#])"""


def _compact(pattern: str) -> str:
    """Drop the layout: line breaks and blanks between the parts."""
    lines = [line.strip() for line in pattern.splitlines()]
    return "".join(lines).replace(" | ", "|").replace("| ", "|")


# A block comment with no other one inside, and two openings without a closing between them.
_RUST_BLOCK = r"/\*(?:[^*/]+|\*(?!/)|/(?!\*))*+\*/"
_RUST_NESTED = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+/\*"
_RUST_RAW = r'(?<![A-Za-z0-9_])[bc]?r(#*)"'


def _c_parts(keep_macro_text: bool) -> tuple[str, str]:
    """(kept, comment) for C."""
    if keep_macro_text:
        kept = rf"""[^"'/\#]+|{_C_MACRO}|{_C_LITERAL}|{_C_OPEN}"""
    else:
        kept = rf"""[^"'/]+|{_C_LITERAL}|{_C_OPEN}"""
    return _compact(kept), _compact(_C_COMMENT)


def _c_pattern(keep_macro_text: bool, capture: bool = False) -> str:
    """Kept text is in the first and the last group; with ``capture`` group 2 is the comment.

    The last group starts at a block comment that is never closed.  Nothing after it is closed
    either, so it takes all code up to the next line comment without looking for an end.
    """
    kept, comment = _c_parts(keep_macro_text)
    comment = f"({comment})" if capture else comment
    return rf"(?s)((?:{kept})++)|{comment}|(/\*(?:{kept}|/(?!/))*+)"


def _rust_pattern(doc_newline: bool, capture: bool = False) -> str:
    """Kept text is in the first group; with ``capture`` group 3 is the comment."""
    line = _compact(_RUST_LINE_DOC if doc_newline else _RUST_LINE)
    kept = _compact(f"{_RUST_PLAIN}|{_RUST_LITERAL}|{_RUST_OPEN}")
    comment = f"{line}|{_RUST_BLOCK}"
    return f"(?s)((?:{kept})++)|{f'({comment})' if capture else comment}"


_FENCE_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def remove_nbsp(code: Column) -> Column:
    """Delete every no-break space (nothing is put in its place)."""
    return F.replace(code, F.lit(NBSP), F.lit(""))


def strip_whitespace(text: Column) -> Column:
    """Trim all Unicode whitespace at both ends (``trim`` alone knows U+0020 only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """Trimming on the left only ends at the first visible character."""
    return F.ltrim(text, F.lit(WHITESPACE)) == F.lit("")


def normalize_code(code: Column) -> Column:
    return strip_whitespace(remove_nbsp(code))


def strip_c_comments(code: Column, keep_macro_text: bool = False) -> Column:
    """Delete C comments."""
    return F.regexp_replace(code, _c_pattern(keep_macro_text), "$1$2")


def _for_scanner(code: Column) -> Column:
    """Texts the Rust pattern is not made for: block comments that nest, raw strings never closed.

    Both tests take in a few texts too many (marks inside literals), which the scanner reads
    just as well.  The last opening with so many hashes is closed if its quote stands before
    the last quote with as many hashes; seen from the end of the text, behind it.
    """
    hashes = F.array_distinct(F.regexp_extract_all(code, F.lit(_RUST_RAW), F.lit(1)))
    backwards = F.reverse(code)

    def open_to_the_end(h: Column) -> Column:
        opening = F.instr(backwards, F.concat(F.lit('"'), h, F.lit("r")))
        closing = F.instr(backwards, F.concat(h, F.lit('"')))
        return (closing == 0) | (closing + F.length(h) >= opening)

    raw = F.contains(code, F.lit('r"')) | F.contains(code, F.lit("r#"))
    return F.rlike(code, F.lit(_RUST_NESTED)) | (raw & F.exists(hashes, open_to_the_end))


def _to_scanner(code: Column) -> Column:
    """Texts that go to the scanner, null for all others."""
    return F.when(_for_scanner(code), code)


def _scanned(code: Column, doc_newline: bool) -> Column:
    """Pieces of the texts that go to the scanner, null for all others.

    To be referred to once: each reference may become a call of the scanner.
    """
    return scanned_pieces(_to_scanner(code), doc_newline)


def _is_comment(_: Column, place: Column) -> Column:
    return place % 2 == 1


def strip_rust_comments(code: Column, doc_newline: bool = False) -> Column:
    """Delete Rust line, doc and block comments, nested to any depth."""
    usual = F.regexp_replace(code, _rust_pattern(doc_newline), "$1")
    return F.coalesce(scanned_code(_to_scanner(code), doc_newline), usual)


def strip_comments(code: Column, lang: Column | str, grammar_habits: bool = False) -> Column:
    """Comment removal by language; an unknown language is an error."""
    c_form = strip_c_comments(code, keep_macro_text=grammar_habits)
    rust_code = code if isinstance(lang, str) else F.when(lang == LANG_RUST, code)
    rust_form = strip_rust_comments(rust_code, doc_newline=grammar_habits)
    if isinstance(lang, str):
        forms = {LANG_C: c_form, LANG_RUST: rust_form}
        if lang not in forms:
            raise ValueError(f"unknown language: {lang!r}")
        return forms[lang]
    unknown = F.raise_error(
        F.concat(F.lit("unknown language: "), F.coalesce(lang, F.lit("null")))
    )
    return (
        F.when(lang == LANG_C, c_form)
        .when(lang == LANG_RUST, rust_form)
        .otherwise(F.when(code.isNotNull(), unknown))
    )


def finalize_snippet(
    code: Column, lang: Column | str, grammar_habits: bool = False
) -> Column:
    """Clean one snippet.

    null or blank -> null; a snippet made of comments only -> ``""``.
    """
    text = F.nullif(normalize_code(code), F.lit(""))
    return strip_whitespace(strip_comments(text, lang, grammar_habits))


def _captured(lang: str, grammar_habits: bool) -> tuple[str, int]:
    """Pattern with comments captured as well, and the number of their group."""
    if lang == LANG_C:
        return _c_pattern(grammar_habits, capture=True), 2
    if lang == LANG_RUST:
        return _rust_pattern(grammar_habits, capture=True), 3
    raise ValueError(f"unknown language: {lang!r}")


def extract_comments(code: Column, lang: str, grammar_habits: bool = False) -> Column:
    """Outermost comments in text order, as ARRAY<STRING>."""
    pattern, group = _captured(lang, grammar_habits)
    found = F.regexp_extract_all(code, F.lit(pattern), F.lit(group))
    usual = F.filter(found, lambda x: x != "")
    if lang != LANG_RUST:
        return usual
    scanned = _scanned(code, grammar_habits)
    return F.coalesce(F.filter(scanned, _is_comment), usual)


def comment_ranges(code: Column, lang: str, grammar_habits: bool = False) -> Column:
    """UTF-8 byte ranges of the outermost comments, ARRAY<STRUCT<start INT, end INT>>.

    The text is cut into kept stretches and comments; the running total of their sizes gives
    each comment its range.
    """
    pattern, group = _captured(lang, grammar_habits)
    pieces_re = F.lit(f"{pattern}|.")

    def piece(text: Column, hit: Column) -> Column:
        return F.struct(F.octet_length(text).alias("size"), hit.alias("hit"))

    pieces = F.zip_with(
        F.regexp_extract_all(code, pieces_re, F.lit(0)),
        F.regexp_extract_all(code, pieces_re, F.lit(group)),
        lambda p, c: piece(p, c != ""),
    )
    if lang == LANG_RUST:
        scanned = _scanned(code, grammar_habits)
        own = F.transform(scanned, lambda p, i: piece(p, _is_comment(p, i)))
        pieces = F.coalesce(own, pieces)

    def ranges(cut: Column) -> Column:
        ends = running_total(F.transform(cut, lambda p: p["size"]))
        placed = F.zip_with(
            cut,
            ends,
            lambda p, end: F.struct(
                (end - p["size"]).alias("start"), end.alias("end"), p["hit"].alias("hit")
            ),
        )
        hits = F.filter(placed, lambda p: p["hit"])
        return F.transform(hits, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))

    return bound(pieces, ranges)


def delete_ranges(text: Column, ranges: Column) -> Column:
    """Delete byte ranges from the UTF-8 form of ``text``.

    Ranges that do not overlap leave stretches between them, which are put together in
    one pass.  Overlapping ranges are deleted one after the other, the last one first.
    """
    both = F.struct(F.encode(text, "UTF-8").alias("data"), F.array_sort(ranges).alias("cuts"))
    return F.decode(bound(both, lambda x: _without(x["data"], x["cuts"])), "UTF-8")


def _without(data: Column, cuts: Column) -> Column:
    """``data`` without the stretches in ``cuts``, which come in order."""
    from_ = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda r: r["end"]))
    to = F.concat(F.transform(cuts, lambda r: r["start"]), F.array(F.octet_length(data)))

    def left(kept: Column) -> Column:
        disjoint = F.forall(kept, lambda k: k["from"] <= k["to"]) & F.forall(
            cuts, lambda r: r["start"] <= r["end"]
        )
        stretches = F.transform(
            kept, lambda k: F.hex(F.substr(data, k["from"] + 1, k["to"] - k["from"]))
        )
        one_by_one = F.aggregate(
            F.reverse(cuts),
            data,
            lambda b, r: F.overlay(b, F.lit(b""), r["start"] + F.lit(1), r["end"] - r["start"]),
        )
        return F.when(disjoint, F.unhex(F.array_join(stretches, ""))).otherwise(one_by_one)

    pairs = F.zip_with(from_, to, lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    return bound(pairs, left)


def extract_fenced_code(text: Column, tag: str = "rust") -> Column:
    """First fenced block with the given tag, or the whole text; trimmed.

    ``rlike`` decides, because an empty block is a match with an empty capture.
    """
    pattern = rf"(?isu)```{tag}{_FENCE_SPACE}+(.*?){_FENCE_SPACE}+```"
    body = F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))
    return strip_whitespace(body.otherwise(text))

