"""Text functions against hand cases and short plain-Python statements of each rule."""

import random
import re
import time
from itertools import accumulate

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairloom.constants import NBSP, WHITESPACE
from pairloom.functions import text as T
from pairloom.functions.arrays import running_total


def python_strip_c(code: str) -> str:
    out, i = [], 0
    while i < len(code):
        if code.startswith("/*", i) and code.find("*/", i + 2) >= 0:
            i = code.find("*/", i + 2) + 2
        elif code.startswith("//", i):
            while i < len(code) and code[i] != "\n":
                if code[i] == "\\":
                    i += 3 if code.startswith("\r\n", i + 1) else 2
                else:
                    i += 1
        else:
            end = python_c_literal(code, i)
            out.append(code[i:end])
            i = end
    return "".join(out)


def python_c_literal(code: str, i: int) -> int:
    """End of the literal at i, or i + 1 where there is none."""
    if code[i] not in "\"'":
        return i + 1
    j = i + 1
    while j < len(code) and code[j] not in (code[i], "\n"):
        j += 2 if code[j] == "\\" else 1
    return j + 1 if j < len(code) and code[j] == code[i] else i + 1


def python_strip_rust(code: str) -> str:
    out, i = [], 0
    while i < len(code):
        if code.startswith("//", i):
            end = code.find("\n", i)
            i = len(code) if end < 0 else end
            continue
        if code.startswith("/*", i):
            end = python_block_end(code, i)
            if end:
                i = end
                continue
        end = python_rust_literal(code, i)
        out.append(code[i:end])
        i = end
    return "".join(out)


def python_block_end(code: str, i: int) -> int | None:
    depth = 0
    while i < len(code):
        if code.startswith("/*", i):
            depth, i = depth + 1, i + 2
        elif code.startswith("*/", i):
            depth, i = depth - 1, i + 2
            if depth == 0:
                return i
        else:
            i += 1
    return None


def python_rust_literal(code: str, i: int) -> int:
    before = code[i - 1] if i else " "
    raw = re.match(r'[bc]?r(#*)"', code[i:])
    if raw and not re.match(r"[A-Za-z0-9_]", before):
        end = code.find('"' + raw[1], i + raw.end())
        if end >= 0:
            return end + 1 + len(raw[1])
    if code[i] == '"':
        j = i + 1
        while j < len(code) and code[j] != '"':
            j += 2 if code[j] == "\\" else 1
        return j + 1 if j < len(code) else i + 1
    char = re.compile(r"'(?:\\u\{[^}]*\}|\\x[0-9a-fA-F]{2}|\\.|[^'\\])'", re.S).match(code, i)
    return char.end() if char else i + 1


def random_codes(parts: list[str], n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


C_PARTS = ["/", "*", "//", "/*", "*/", '"', "'", "\\", "\n", "\r\n", "a", " ", "#", "é", "\U0001f600"]
RUST_PARTS = [*C_PARTS, "r", "b", "c", 'r#"', '"#', 'br"', "##", "_", "'a", "\\u{1F}", "'\\''"]


def test_normalize_removes_nbsp_everywhere_and_trims(evaluate):
    cases = [None, "", NBSP, f" a{NBSP}b\t", f"　x {NBSP}\x1c", f'"{NBSP}"', "a  b"]
    want = [None if c is None else c.replace(NBSP, "").strip() for c in cases]
    assert evaluate(cases, T.normalize_code) == want


def test_whitespace_is_pythons():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


@pytest.mark.parametrize("seed", range(3))
def test_c_comments_random(evaluate, seed):
    codes = random_codes(C_PARTS, 2000, seed)
    assert evaluate(codes, T.strip_c_comments) == [python_strip_c(c) for c in codes]


@pytest.mark.parametrize("seed", range(3))
def test_rust_comments_random(evaluate, seed):
    codes = random_codes(RUST_PARTS, 2000, seed)
    assert evaluate(codes, T.strip_rust_comments) == [python_strip_rust(c) for c in codes]


def test_c_comment_cases(evaluate):
    cases = {
        'char *s = "// no /* no */"; // yes': 'char *s = "// no /* no */"; ',
        "char c = '\"'; // x\nint y; /* a\n b */": "char c = '\"'; \nint y; ",
        "// one \\\n still one\nint z;": "\nint z;",
        "int a = 1 /* open": "int a = 1 /* open",
        "x = a /*in*/ / b": "x = a  / b",
    }
    assert evaluate(list(cases), T.strip_c_comments) == list(cases.values())


def test_rust_comment_cases(evaluate):
    cases = {
        "a /* x /* y /* z */ */ */ b": "a  b",
        'let r = r##"// "# no "##; // yes': 'let r = r##"// "# no "##; ',
        "let l: &'a str = \"/*\"; /* c */": "let l: &'a str = \"/*\"; ",
        "/// doc\nfn f() {}\n//! in": "\nfn f() {}\n",
        "x */* c */y": "x *y",
        "b'\\'' // c": "b'\\'' ",
    }
    assert evaluate(list(cases), T.strip_rust_comments) == list(cases.values())


@pytest.mark.parametrize("seed", range(3))
def test_rust_nested_comments_random(spark, seed):
    """Mostly marks, so that comments nest, and stay open, at every depth."""
    parts = ["/*", "*/", "/*", "*/", "*", "/", "//", "\n", '"', "\\", "'", 'r#"', '"#', 'br##"', 'r"', "é"]
    codes = random_codes(parts, 1500, seed + 50)
    df = spark.createDataFrame([(c,) for c in codes], "c STRING")
    code = F.col("c")
    rows = df.select(
        "c",
        T.strip_rust_comments(code).alias("stripped"),
        T.comment_ranges(code, "Rust").alias("ranges"),
        T.extract_comments(code, "Rust").alias("comments"),
    ).collect()
    for r in rows:
        raw = r["c"].encode()
        assert r["stripped"] == python_strip_rust(r["c"])
        assert [raw[x["start"] : x["end"]].decode() for x in r["ranges"]] == r["comments"]
        left, at = b"", 0
        for x in r["ranges"]:
            left, at = left + raw[at : x["start"]], x["end"]
        assert (left + raw[at:]).decode() == r["stripped"]


@pytest.mark.parametrize("depth", [64, 65, 66, 512, 5000])
def test_rust_comments_nest_to_any_depth(spark, depth):
    nested = "/* " * depth + "*/ " * (depth - 1) + "*/"
    texts = [f"x {nested} y // z", f"x /* {nested} y", f"'\"' {nested[:-2]} \"/*\""]
    df = spark.createDataFrame([(t,) for t in texts], "c STRING")
    code = F.col("c")
    got = df.select(
        T.strip_rust_comments(code).alias("left"),
        T.comment_ranges(code, "Rust").alias("ranges"),
        T.extract_comments(code, "Rust").alias("comments"),
    ).collect()
    assert [r["left"] for r in got] == [python_strip_rust(t) for t in texts]
    assert got[0]["comments"] == [nested, "// z"]
    assert [tuple(x) for x in got[0]["ranges"]] == [(2, 2 + len(nested)), (len(nested) + 5, len(nested) + 9)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("form", ["left", "ranges", "comments"])
def test_scanner_gets_few_texts_at_a_time(spark, form):
    """An Arrow batch of 10,000 texts, with the pieces of all of them, filled a worker's memory."""
    df = spark.createDataFrame([(i, f"a{i} /* b /* c */ */ d // e") for i in range(300)], "i INT, c STRING")
    code = F.col("c")
    forms = {
        "left": T.strip_rust_comments(code),
        "ranges": T.comment_ranges(code, "Rust"),
        "comments": T.extract_comments(code, "Rust"),
    }
    out = df.select("i", forms[form].alias("out"))
    assert "BatchEvalPython" in _plan(out) and "ArrowEvalPython" not in _plan(out)
    got = {r["i"]: r["out"] for r in out.collect()}
    for i, found in got.items():
        at = len(f"a{i} ")
        assert len(got) == 300 and found == {
            "left": f"a{i}  d ",
            "ranges": [(at, at + 15), (at + 18, at + 22)],
            "comments": ["/* b /* c */ */", "// e"],
        }[form]


def test_scanner_runs_once_for_a_cleaned_snippet(spark):
    """Trimming gives each mention of the text its own name, so two mentions were two scans."""
    df = spark.createDataFrame([(" x /* a /* b */ */ y ",), ("/* /* */ */",), (" ",), (None,)], "c STRING")
    out = df.select(T.finalize_snippet(F.col("c"), "Rust").alias("out"))
    assert "pythonUDF0" in _plan(out) and "pythonUDF1" not in _plan(out)
    assert [r["out"] for r in out.collect()] == ["x  y", "", None, None]


def test_corpus_build_scans_by_row_and_once(spark, tmp_path):
    from table_queries import QUERIES

    body = "One, two. Three\nfour. " * 20
    rows = [(1, f"a {body}", "s", 500), (2, f"a {body}", "t", 500), (3, f"b {body}", "t", 500), (4, "c", "t", 1), (5, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING, n_chars LONG")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    built = QUERIES["corpus_build"](spark, str(tmp_path))
    plan = _plan(built)
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan and "pythonUDF1" not in plan
    got = {r["doc_id"]: r for r in built.collect()}
    assert set(got) == {1, 3} and got[1]["task_name"] == "s"
    assert got[3]["safe_rust_code"] == python_strip_rust(
        "//! top\n" + rows[2][1].replace(". ", ". /* a /* b // */ c */ ")
        .replace(", ", ', r#"keep // " /* this */"# ').replace("\n", " /// tail\n") + "\n/* last */"
    ).strip()


def test_many_comments_and_open_literals_take_time_in_proportion(spark):
    """Each of these took minutes or more when a text was searched or copied again per mark."""
    many = "/* é */ x // y\n" * 50_000
    cases = {
        many: " x \n" * 50_000,
        'br#"' * 500_000 + " // z": 'br#"' * 500_000 + " ",
        'r##"r#"' * 100_000 + "/* a /* b */ */": 'r##"r#"' * 100_000,
        "/* " * 200_000 + "// z": "/* " * 200_000,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c STRING")
    code = F.col("c")
    start = time.monotonic()
    got = df.select(
        T.strip_rust_comments(code).alias("left"), F.size(T.comment_ranges(code, "Rust")).alias("n")
    ).collect()
    assert [r["left"] for r in got] == list(cases.values())
    assert [r["n"] for r in got] == [100_000, 1, 1, 1]
    none = df.limit(1).select(F.lit(None).cast("string").alias("c"))
    for lang in ("C", "Rust"):
        ranges = T.comment_ranges(code, lang)
        made = [ranges, T.extract_comments(code, lang), T.delete_ranges(code, ranges)]
        assert tuple(none.select(*made).first()) == (None, None, None)
    c = df.limit(1).select(T.delete_ranges(code, T.comment_ranges(code, "C")).alias("left"))
    assert c.first()["left"] == " x \n" * 50_000
    assert time.monotonic() - start < 60


def test_long_comments_do_not_exhaust_the_stack(evaluate):
    inside = "* a / b ** " * 200_000
    texts = [f"x /*{inside}*/ y", f"x /* /*{inside}*/ */ y", f'r#"{inside}"# /*{inside}', f"/// {inside}\ny"]
    want = ["x  y", "x  y", f'r#"{inside}"# /*{inside}', "\ny"]
    assert evaluate(texts, T.strip_rust_comments) == want


def test_running_total(spark):
    sizes = [(list(range(n)),) for n in (0, 1, 2, 511, 512, 513, 1024, 3000)]
    df = spark.createDataFrame([*sizes, (None,)], "v ARRAY<INT>")
    got = [r[0] for r in df.select(running_total(F.col("v"))).collect()]
    assert got == [list(accumulate(v)) for (v,) in sizes] + [None]


def test_long_inputs_do_not_exhaust_the_stack(evaluate):
    unit = 'int a; /* c */ "s // x" // l\n'
    (out,) = evaluate([unit * 40000], T.strip_c_comments)
    assert out == 'int a;  "s // x" \n' * 40000
    (out,) = evaluate(['"' + "x\\n" * 400000 + '" // c'], T.strip_rust_comments)
    assert out.endswith('" ')


def test_grammar_habits(evaluate):
    code = ["#define X 5 // kept\n#define Y(a) a /* cut */ // cut\n#define Z // cut\nint a; // cut"]
    want = ["#define X 5 // kept\n#define Y(a) a  \n#define Z \nint a; "]
    assert evaluate(code, lambda c: T.strip_c_comments(c, keep_macro_text=True)) == want
    rust = ["/// doc\nfn f() {}\n//// plain\nx"]
    assert evaluate(rust, lambda c: T.strip_rust_comments(c, doc_newline=True)) == ["fn f() {}\n\nx"]


def test_finalize(spark):
    rows = [
        (1, "C", None, None),
        (2, "C", f" {NBSP}\n", None),
        (3, "C", "/* only */", ""),
        (4, "Rust", "// only", ""),
        (5, "C", f"{NBSP} int{NBSP} a; // x ", "int a;"),
        (6, "Rust", "a /* /* */ */", "a"),
    ]
    df = spark.createDataFrame(rows, "i INT, lang STRING, code STRING, want STRING")
    got = df.select("want", T.finalize_snippet(F.col("code"), F.col("lang")).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect())


def test_unknown_language_is_an_error(spark):
    df = spark.createDataFrame([("x", "Go")], "code STRING, lang STRING")
    with pytest.raises(PySparkException, match="unknown language: Go"):
        df.select(T.finalize_snippet(F.col("code"), F.col("lang"))).collect()
    with pytest.raises(ValueError, match="unknown language"):
        T.finalize_snippet(F.col("code"), "Go")
    blank = spark.createDataFrame([(" ", "Go")], "code STRING, lang STRING")
    assert blank.select(T.finalize_snippet(F.col("code"), F.col("lang"))).first()[0] is None


@pytest.mark.parametrize("lang,strip", [("C", T.strip_c_comments), ("Rust", T.strip_rust_comments)])
def test_ranges_and_extraction_agree_with_stripping(spark, lang, strip):
    codes = random_codes(C_PARTS if lang == "C" else RUST_PARTS, 800, 11)
    df = spark.createDataFrame([(c,) for c in codes], "c STRING")
    code = F.col("c")
    rows = df.select(
        "c",
        strip(code).alias("stripped"),
        T.comment_ranges(code, lang).alias("ranges"),
        T.extract_comments(code, lang).alias("comments"),
        T.delete_ranges(code, F.shuffle(T.comment_ranges(code, lang))).alias("cut"),
    ).collect()
    for r in rows:
        raw = r["c"].encode()
        assert r["cut"] == r["stripped"]
        assert [raw[x["start"] : x["end"]].decode() for x in r["ranges"]] == r["comments"]


@pytest.mark.parametrize(
    ("ranges", "left"),
    [
        ([(7, 8), (1, 3)], "a\U0001f600c"),
        ([], "aé\U0001f600bc"),
        ([(0, 9)], ""),
        ([(3, 7), (3, 7)], "aé"),
        ([(7, 9), (0, 9), (7, 8)], ""),
        ([(0, 1), (1, 3), (8, 9), (5, 5)], "\U0001f600b"),
        ([(8, 12)], "aé\U0001f600b"),
    ],
)
def test_delete_ranges_multibyte_unsorted_overlapping(spark, ranges, left):
    df = spark.createDataFrame(
        [("aé\U0001f600bc", ranges)], "t STRING, r ARRAY<STRUCT<start:INT,end:INT>>"
    )
    assert df.select(T.delete_ranges(F.col("t"), F.col("r"))).first()[0] == left


def test_fenced_code(evaluate):
    pattern = re.compile(r"```rust\s+(.*?)\s+```", re.S | re.I)
    cases = [
        "no fence ",
        "x\n```rust\nfn a() {}\n```\ny",
        "```RUST\n a \n```",
        "```rust\na\n```\n```rust\nb\n```",
        "```rust\n\n```",
        "```rust\n a\x1c```",
        "```rust a```",
        "```c\na\n```",
    ]
    want = [(m[1] if (m := pattern.search(c)) else c).strip() for c in cases]
    assert evaluate(cases, T.extract_fenced_code) == want
