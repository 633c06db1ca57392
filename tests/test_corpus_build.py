"""The corpus build on a small folder tree with known answers."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pairloom.__main__ import main
from pairloom.constants import CORPUS_NAME, DROP_KEYS_BY_FOLDER
from pairloom.plans.corpus_build import (
    CorpusOptions,
    build_corpus,
    cleaned_lines,
    corpus_table,
    first_keys,
    paired_rows,
    run_corpus_build,
    unique_records,
)
from pairloom.operators.placing import in_order
from pairloom.operators.reports import clean_report
from pairloom.sources import files
from pairloom.sources.sinks import write_corpus

(ID_FOLDER,) = DROP_KEYS_BY_FOLDER


def write_parquet(path, rows, extra=True):
    columns = {
        "task_name": pa.array([r[0] for r in rows], pa.string()),
        "language_name": pa.array([r[1] for r in rows], pa.string()),
        "code": pa.array([r[2] for r in rows], pa.string()),
    }
    if extra:
        columns["task_url"] = pa.array(["u"] * len(rows), pa.string())
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path, row_group_size=2)


def write_lines(path, lines, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("".join(x + end for x in lines).encode())


def line(**record):
    return json.dumps(record, ensure_ascii=False)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "raw data+1"
    write_parquet(
        root / "b_pairs" / "one.parquet",
        [
            ("sum", "C", "int old;"),
            ("sum", "C++", "no"),
            ("sum", "c", "no"),
            ("sum", None, "no"),
            ("sum", "Rust", "let a; // x"),
            ("sum", "C", "int new; /* y */"),
            ("erased", "C", "int a;"),
            ("erased", "Rust", "fn a() {}"),
            ("erased", "C", None),
            ("blanked", "C", "int a;"),
            ("blanked", "Rust", "fn a() {}"),
            ("blanked", "Rust", "  \n"),
            (None, "C", "int n;"),
            (None, "Rust", "fn n() {}"),
            ("", "C", "int e;"),
            ("", "Rust", "fn e() {}"),
            ("comment", "C", "// only"),
            ("comment", "Rust", "fn c() {}"),
            ("split", "C", "int s;"),
            ("Zed", "Rust", "fn z() {}"),
            ("Zed", "C", "int z;"),
        ],
    )
    write_parquet(
        root / "b_pairs" / "two.PARQUET",
        [("split", "Rust", "fn s() {}"), ("sum", "C", "int new;"), ("sum", "Rust", "let a;")],
        extra=False,
    )
    write_lines(
        root / "a_json" / "x.jsonl",
        [
            line(name="n1", C="int p; // 1", Rust="fn p() {}", id=5),
            "",
            " \t",
            line(task_name=None, name="n2", C="int q;", Rust="fn q() {}", k=[1, {"é": None}]),
            line(task_name="t3", name="n3", C="int r;", Rust="fn r() {}"),
            line(C="int s;", Rust="fn s() {}", n=1.5),
            line(name="bad", C=1, Rust="fn a() {}"),
            line(name="bad", C=None, Rust="fn a() {}"),
            line(name="bad", Rust="fn a() {}"),
            line(name="bad", C="/* c */", Rust="fn a() {}"),
            line(name="first", C="int p; ", Rust="fn p() {} // same pair"),
        ],
        end="\r\n",
    )
    write_lines(
        root / ID_FOLDER / "y.JSONL",
        [
            line(id=1, name="late", C="int p;", Rust="fn p() {}"),
            line(id=2, name="new", C="int new;", Rust="let a;"),
        ],
    )
    write_lines(root / "a_json" / "deeper" / "z.jsonl", [line(C="int d;", Rust="fn d() {}")])
    write_lines(root / "a_json" / "notes.txt", ["not read"])
    write_lines(root / "top.jsonl", [line(C="int t;", Rust="fn t() {}")])
    (root / "empty").mkdir()
    return root


EXPECTED = [
    # folder order: the upper-case name sorts first
    {"task_name": "late", "c_code": "int p;", "safe_rust_code": "fn p() {}"},
    {"task_name": "new", "c_code": "int new;", "safe_rust_code": "let a;"},
    {"task_name": None, "name": "n2", "k": [1, {"é": None}], "c_code": "int q;", "safe_rust_code": "fn q() {}"},
    {"task_name": "t3", "c_code": "int r;", "safe_rust_code": "fn r() {}"},
    {"n": 1.5, "c_code": "int s;", "safe_rust_code": "fn s() {}"},
    {"task_name": "", "c_code": "int e;", "safe_rust_code": "fn e() {}"},
    {"task_name": "Zed", "c_code": "int z;", "safe_rust_code": "fn z() {}"},
    {"task_name": "sum", "c_code": "int new;", "safe_rust_code": "let a;"},
    {"task_name": "sum", "c_code": "int new;", "safe_rust_code": "let a;"},
]


def test_build_and_report(spark, tree, tmp_path):
    report = run_corpus_build(spark, str(tree), str(tmp_path / "out"))
    corpus = tmp_path / "out" / CORPUS_NAME
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(corpus.rglob("part-*")))
    written = [json.loads(x) for x in text.splitlines()]
    assert [list(w.items()) for w in written] == [list(e.items()) for e in EXPECTED]
    columns = ["task_name", "c_code", "safe_rust_code"]
    placed = files.load_corpus_with_position(spark, str(corpus)).orderBy("position").collect()
    assert [r.asDict() for r in placed] == [
        {"position": i, **{c: e.get(c) for c in columns}} for i, e in enumerate(EXPECTED)
    ]
    loaded = files.load_corpus(spark, str(corpus))
    assert loaded.columns == columns and loaded.count() == len(EXPECTED)
    more = files.load_corpus_with_position(spark, str(corpus), "c_code STRING, n DOUBLE")
    assert [r["n"] for r in more.orderBy("position").collect()] == [e.get("n") for e in EXPECTED]
    assert "é" in text
    assert report.total_files == 4
    pairs = {r["file"]: r["written"] for r in report.parquet_files.collect()}
    assert pairs == {"one.parquet": 3, "two.PARQUET": 1}
    lines = {
        r["file"]: (r["folder"], r["lines_read"], r["with_both"], r["written"], r["duplicates"])
        for r in report.jsonl_files.collect()
    }
    assert lines == {"x.jsonl": ("a_json", 9, 5, 3, 2), "y.JSONL": (ID_FOLDER, 2, 2, 2, 0)}


def test_lazy_form_gives_the_same_records(spark, tree):
    corpus = corpus_table(build_corpus(spark, str(tree)))
    got = sorted((r["task_name"] or "", r["c_code"]) for r in corpus.collect())
    assert got == sorted((e.get("task_name") or "", e["c_code"]) for e in EXPECTED)


def test_second_run_overwrites(spark, tree, tmp_path):
    for _ in range(2):
        run_corpus_build(spark, str(tree), str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out" / CORPUS_NAME))
    assert lines.count() == len(EXPECTED)


def test_missing_and_empty_roots(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run_corpus_build(spark, str(tmp_path / "nowhere"), str(tmp_path / "out"))
    (tmp_path / "root" / "folder").mkdir(parents=True)
    report = run_corpus_build(spark, str(tmp_path / "root"), str(tmp_path / "out"))
    assert report.total_files == 0 and not (tmp_path / "out").exists()
    assert build_corpus(spark, str(tmp_path / "root")) is None


def test_command_line(spark, tree, tmp_path, capsys):
    assert main(["build", str(tree), str(tmp_path / "out"), "--batch-size", "3", "--unordered"]) == 0
    assert spark.read.text(str(tmp_path / "out" / CORPUS_NAME)).count() == len(EXPECTED)
    out = capsys.readouterr().out
    assert "files=4" in out and "lines_read=11" in out
    report = spark.read.parquet(str(tmp_path / "out" / f"{CORPUS_NAME}.report" / "parquet"))
    assert "one.parquet" in {r["file"] for r in report.collect()}
    assert main(["build", str(tmp_path / "nowhere"), str(tmp_path / "out")]) == 1
    (tmp_path / "bare").mkdir()
    assert main(["build", str(tmp_path / "bare"), str(tmp_path / "out2")]) == 0
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")


def test_malformed_line_aborts(spark, tmp_path):
    write_lines(tmp_path / "r" / "d" / "x.jsonl", ['{"C": "a"'])
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        run_corpus_build(spark, str(tmp_path / "r"), str(tmp_path / "out"))


def test_duplicate_json_keys_last_value(spark, tmp_path):
    write_lines(tmp_path / "r" / "d" / "x.jsonl", ['{"C": 1, "Rust": "r", "C": "int a;", "z": 1, "z": 2}'])
    corpus = build_corpus(spark, str(tmp_path / "r"))
    row = corpus.select("c_code", F.to_json("extras").alias("extras")).first()
    assert (row["c_code"], json.loads(row["extras"])) == ("int a;", {"z": 2})


def test_first_wins_over_many_splits(spark, tmp_path):
    """A file read in many blocks: the first of equal pairs is found all the same."""
    records = [line(n=i, C=f"int a{i % 50};", Rust="fn a() {}", pad="x" * 200) for i in range(4000)]
    write_lines(tmp_path / "r" / "d" / "x.jsonl", records)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        lines = files.scan_jsonl(spark, str(tmp_path / "r"))
        assert lines.rdd.getNumPartitions() > 10
        kept = unique_records(cleaned_lines(lines, CorpusOptions()))
        got = {r["n"] for r in kept.select(F.to_json("extras").alias("e")).collect() for r in [json.loads(r["e"])]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == set(range(50))


def test_plans_prune_push_down_and_limit_groups(spark, tree):
    options = CorpusOptions()
    rows = paired_rows(files.scan_parquet(spark, str(tree)), options)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "In(language_name, [C,Rust])" in plan and "IsNotNull(task_name)" in plan
    assert "task_url" not in plan and plan.count("Exchange hashpartitioning") == 1
    records = unique_records(cleaned_lines(files.scan_jsonl(spark, str(tree)), options))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


def test_report_has_every_file(spark, tmp_path):
    root = tmp_path / "r"
    write_lines(root / "d" / "good.jsonl", [line(C="int a;", Rust="fn a() {}")])
    write_lines(root / "d" / "blank.jsonl", ["", "  "])
    (root / "d" / "empty.jsonl").write_bytes(b"")
    write_parquet(root / "d" / "none.parquet", [("t", "C", "int a;")])
    write_lines(root / "sub.jsonl" / "inner.txt", ["{}"])
    write_lines(root / "d" / "folder.jsonl" / "inside.jsonl", ["not json"])
    write_lines(root / "key=1" / "more.jsonl", [line(C="int b;", Rust="fn b() {}")])
    report = run_corpus_build(spark, str(root), str(tmp_path / "out"))
    rows = {(r["folder"], r["file"]): r["lines_read"] for r in report.jsonl_files.collect()}
    assert rows == {("d", "good.jsonl"): 1, ("d", "blank.jsonl"): 0, ("d", "empty.jsonl"): 0, ("key=1", "more.jsonl"): 1}
    assert [r["written"] for r in report.parquet_files.collect()] == [0]
    assert report.total_files == 5


def test_root_must_be_a_folder(spark, tmp_path):
    write_lines(tmp_path / "file.jsonl", ["{}"])
    with pytest.raises(FileNotFoundError):
        run_corpus_build(spark, str(tmp_path / "file.jsonl"), str(tmp_path / "out"))


def test_bytes_that_are_not_utf8_stop_the_build(spark, tmp_path):
    path = tmp_path / "r" / "d" / "x.jsonl"
    path.parent.mkdir(parents=True)
    path.write_bytes(b'{"C": "int a; \xff", "Rust": "fn a() {}"}\n')
    with pytest.raises(Exception, match="INVALID_UTF8"):
        run_corpus_build(spark, str(tmp_path / "r"), str(tmp_path / "out"))


def test_digest_keeps_different_pairs_apart(spark):
    from pairloom.operators.pairs import pair_digest

    rows = spark.createDataFrame([("a\0b", "c"), ("a", "b\0c"), ("a", None)], "x STRING, y STRING")
    assert rows.select(pair_digest(["x", "y"])).distinct().count() == 3


def test_part_files_order_by_number(spark):
    names = spark.createDataFrame([("part-99999-x.txt",), ("part-100000-x.txt",), ("other",)], "f STRING")
    got = [r[0] for r in names.orderBy(files.part_number(F.col("f")), "f").collect()]
    assert got == ["other", "part-99999-x.txt", "part-100000-x.txt"]


def test_order_over_many_chunks(spark, tmp_path):
    """Files read in many blocks, later copies and named pairs: positions are those of one reader."""
    root, pad = tmp_path / "r", "x" * 300
    records = [[line(name=f"{f}-{i}", C=f"int a{i % 700};", Rust=f"fn a{f}() {{}}", pad=pad) for i in range(1000)] for f in range(3)]
    for f, lines in enumerate(records):
        write_lines(root / "d" / f"{f}.jsonl", lines)
    write_parquet(root / "e" / "p.parquet", [(f"t{i:03}", lang, "int a;") for i in range(200) for lang in ("C", "Rust")][::-1])
    want = [f"{f}-{i}" for f in range(3) for i in range(700)] + [f"t{i:03}" for i in range(200)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        run_corpus_build(spark, str(root), str(tmp_path / "out"))
        corpus = tmp_path / "out" / CORPUS_NAME
        table = files.load_corpus_with_position(spark, str(corpus))
        rows = table.orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["position"], r["task_name"]) for r in rows] == list(enumerate(want))
    parts = sorted(corpus.rglob("part-*"))
    names = [json.loads(x)["task_name"] for p in parts for x in p.read_text().splitlines()]
    assert len(parts) > 40 and names == want


def test_plans_move_text_once_and_read_positions_in_one_scan(spark, tree, tmp_path):
    """No range exchange of text; reading back is a scan of the columns asked for."""
    run_corpus_build(spark, str(tree), str(tmp_path / "out"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cleaned = cleaned_lines(files.scan_jsonl(spark, str(tree)), CorpusOptions())
        placed = in_order(cleaned.where("digest IS NOT NULL"), first_keys(cleaned))
        plan = placed._jdf.queryExecution().executedPlan().toString()
        back = files.load_corpus_with_position(spark, str(tmp_path / "out" / CORPUS_NAME))
        scan = back.select("position")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "rangepartitioning" not in plan
    moved = [x for x in plan.split("(initial plan)")[-1].splitlines() if "Exchange" in x]
    assert moved and scan.count("FileScan") == 1
    assert "Exchange" not in scan and "Window" not in scan and "c_code" not in scan


def test_folders_order_past_any_number_of_parts(spark, tmp_path):
    rows = [(str(f), "", 0, r, "", f * 10**5 + r, f * 10**5) for f in (0, 9, 10, 99_999, 100_000) for r in range(3)]
    kinds = "folder STRING, file STRING, block BIGINT, row BIGINT, task_order STRING, position BIGINT, first BIGINT"
    df = spark.createDataFrame(rows, kinds).withColumns(
        {"label": F.col("position").cast("variant"), "c_code": F.lit("c"), "safe_rust_code": F.lit("r"), "extras": F.from_json(F.lit("{}"), "map<string,variant>")}
    )
    write_corpus(df.orderBy(F.desc("position")).coalesce(1), str(tmp_path / "c"))
    found = [json.loads(x)["task_name"] for p in sorted((tmp_path / "c").rglob("part-*")) for x in p.read_text().splitlines()]
    assert found == [r[5] for r in rows]


def test_files_of_different_types(spark, tmp_path):
    """A code column that is no text clears the slot; the other files are read as they are."""
    folder = tmp_path / "r" / "d"
    write_parquet(folder / "a.parquet", [("t", "C", "int a;"), ("t", "Rust", "fn a() {}")])
    odd = {
        "b": ([("t", "C", 5), ("t", "Rust", 6)], pa.int32()),
        "c": ([("t", "C", 5), ("t", "Rust", None)], pa.int64()),
        "e": ([("t", "C", b"int a;"), ("t", "Rust", b"x")], pa.binary()),
    }
    for name, (rows, kind) in odd.items():
        names, langs, codes = zip(*rows)
        pq.write_table(pa.table({"task_name": pa.array(names), "language_name": pa.array(langs), "code": pa.array(codes, kind)}), folder / f"{name}.parquet")
    pq.write_table(pa.table({"task_name": pa.array(["t"]), "language_name": pa.array([1]), "code": pa.array(["x"])}), folder / "f.parquet")
    pq.write_table(pa.table({"task_name": pa.array([7, 7]), "language_name": pa.array(["C", "Rust"]), "code": pa.array(["int g;", "fn g() {}"])}), folder / "g.parquet")
    pq.write_table(pa.table({"task_name": pa.array(["u", "u"]), "language_name": pa.array(["Rust", "C"])}), folder / "h.parquet")
    write_parquet(folder / "z.parquet", [("z", "C", "int z;"), ("z", "Rust", "fn z() {}")])
    report = run_corpus_build(spark, str(tmp_path / "r"), str(tmp_path / "out"))
    written = {r["file"]: r["written"] for r in report.parquet_files.collect()}
    assert written == {"a.parquet": 1, "b.parquet": 0, "c.parquet": 0, "e.parquet": 0, "f.parquet": 0, "g.parquet": 1, "h.parquet": 0, "z.parquet": 1}
    scan = files.scan_parquet(spark, str(tmp_path / "r"))
    kinds = [r for r in scan.where("file IN ('b.parquet', 'c.parquet')").collect()]
    assert len(kinds) == 4 and all(r["code"] is None and r["language_name"] for r in kinds)


def test_relative_root(spark, tree, tmp_path, monkeypatch):
    """Spark resolves relative paths in the folder it was started in."""
    home = spark._jvm.java.lang.System.getProperty("user.dir")
    root = os.path.relpath(tree, home)
    write_lines(tree / "a_json" / "more.jsonl" / "inside.jsonl", ["not json"])
    assert files.scan_jsonl(spark, root).count() == files.scan_jsonl(spark, str(tree)).count() == 11
    assert files.scan_parquet(spark, root).count() == 24
    listed = {(r["folder"], r["file"]) for r in files.listed_files(spark, root, "jsonl").collect()}
    assert listed == {("a_json", "x.jsonl"), (ID_FOLDER, "y.JSONL")}
    assert files.listed_files(spark, str(tmp_path / "nowhere"), "jsonl") is None


def test_report_reads_its_lines_once(spark, tmp_path):
    """Complete and incomplete lines were two branches, and each cleaned every line again."""
    rows = [("a", "1"), ("a", "1"), ("a", None), ("b", "1"), ("b", "2"), ("c", None), ("c", None), (None, None), (None, "2")]
    spark.createDataFrame(rows, "file STRING, digest STRING").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    report = clean_report(lines, ["file"], F.col("digest"))
    assert report._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r["file"]: tuple(r)[1:] for r in report.collect()}
    assert got == {"a": (3, 2, 1, 1), "b": (2, 2, 0, 2), "c": (2, 0, 0, 0), None: (2, 1, 1, 0)}
