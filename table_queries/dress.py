"""SQL expressions that dress prose up as code.

They use only functions that Spark and DuckDB share, so both sides see the same text.
"""

NBSP = "chr(160)"
EM_SPACE = "'\u2003'"

# Whitespace and no-break spaces around and inside the text.
PADDED = (
    f"concat(chr(9), {NBSP}, ' ', {EM_SPACE}, replace(text, ' ', concat(' ', {NBSP})), "
    f"chr(13), chr(10), {NBSP}, chr(9))"
)

# C: comments at every sentence end and line break, string literals at every comma.
AS_C = (
    f"concat({NBSP}, '/* head', chr(10), ' more */ ', "
    "replace(replace(replace(text, '. ', '. /* gap \"x */ '), "
    "', ', ', \"a // b /* c */\" '), chr(10), concat(' // tail ''y', chr(10))), ' // end')"
)

# Rust: nested block comments, line and doc comments, raw strings.
AS_RUST = (
    "concat('//! top', chr(10), "
    "replace(replace(replace(text, '. ', '. /* a /* b // */ c */ '), "
    "', ', ', r#\"keep // \" /* this */\"# '), chr(10), concat(' /// tail', chr(10))), "
    "chr(10), '/* last */')"
)

# Every sentence on its own line, with a line of blanks after it.
SENTENCE_LINES = f"replace(text, '. ', concat('.', chr(10), {NBSP}, chr(9), chr(10)))"

# Model answers: assistant turns are fenced, with a second block after the first.
AS_ANSWER = (
    "CASE WHEN role = 'assistant' THEN concat('Here you go:', chr(10), '```Rust', chr(10), "
    "text, chr(10), '```', chr(10), 'or', chr(10), '```rust', chr(10), 'x', chr(10), '```') "
    "ELSE concat('  ', text, chr(10)) END"
)

# The same lexical rules in RE2, which has neither look-around nor possessive quantifiers.
SQL_C_LITERAL = r'''("(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*'')'''
SQL_C_COMMENT = r"//(?:[^\\\n]|\\(?:\r\n|.)?)*|/\*.*?\*/"
SQL_STRIP_C = f"regexp_replace({{0}}, '{SQL_C_LITERAL}|{SQL_C_COMMENT}', '\\1', 'gs')"
# Comments of the dressed Rust text, the nested one spelled out.
SQL_RUST_LITERAL = r'''(r#".*?"#|"(?:[^"\\]|\\.)*")'''
SQL_RUST_COMMENT = r"//[^\n]*|/\* a /\* b // \*/ c \*/|/\* last \*/"
SQL_STRIP_RUST = (
    f"regexp_replace({{0}}, '{SQL_RUST_LITERAL}|{SQL_RUST_COMMENT}', '\\1', 'gs')"
)
SQL_SPACE = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ', chr(133), chr(160), '\u2003')"


def sql_normalize(expression: str) -> str:
    return f"trim(replace({expression}, {NBSP}, ''), {SQL_SPACE})"


def sql_strip_c(expression: str) -> str:
    return SQL_STRIP_C.replace("{0}", expression)


def sql_strip_rust(expression: str) -> str:
    return SQL_STRIP_RUST.replace("{0}", expression)
