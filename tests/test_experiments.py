"""Scoring, prediction tables, corpus loading, streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pairloom.constants import BASELINE_PREFIX, CORPUS_NAME
from pairloom.operators import grid, scoring
from pairloom.plans import experiments
from pairloom.plans.corpus_build import CorpusOptions, run_corpus_build
from pairloom.sources import files, sinks
from pairloom.streaming.incremental import append_batch, start_corpus_stream


@pytest.fixture
def corpus(spark):
    rows = [(i, f"int a{i};", f"fn a{i}() {{}}") for i in range(11)]
    return spark.createDataFrame(rows, "key BIGINT, c_code STRING, safe_rust_code STRING")


def local(answer):
    """A factory that travels to the workers by value; they cannot import this file."""

    def factory():
        return answer

    return factory


echo_model = local(lambda prompts: [f" [{len(prompts)}] {p} \n" for p in prompts])


def test_batches_of_four_in_order(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(9)], "p STRING").coalesce(1)
    out = [r[0] for r in df.select(scoring.score(F.col("p"), echo_model)).collect()]
    sizes = [4] * 8 + [1]
    assert out == [f"[{n}] p{i}" for i, n in enumerate(sizes)]


def test_model_answering_too_little_is_an_error(spark):
    df = spark.createDataFrame([("p",)], "p STRING")
    with pytest.raises(Exception, match="0 answers for 1 inputs"):
        df.select(scoring.score(F.col("p"), local(lambda ps: []))).collect()


code_points = local(lambda texts: [[ord(c) for c in t] for t in texts])


def test_own_tokenizer(spark, corpus):
    encoder = lambda text: scoring.encode_with(text, code_points, max_length=5)
    rows = experiments.training_examples(corpus, encoder=encoder)
    assert rows.columns == ["input_ids", "attention_mask"]
    assert {(tuple(r[0]), tuple(r[1])) for r in rows.collect()} == {
        (tuple(map(ord, "<|im_")), (1,) * 5)
    }


def test_trained_tokenizer_plugs_in(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")

    def factory():
        tok = tokenizers.Tokenizer(tokenizers.models.BPE())
        trainer = tokenizers.trainers.BpeTrainer(vocab_size=60, show_progress=False)
        tok.train_from_iterator(["int a; fn a() {}"], trainer)
        return lambda texts: [e.ids for e in tok.encode_batch(texts)]

    mine = factory()
    rows = corpus.select("c_code", scoring.encode_with(F.col("c_code"), factory).alias("ids"))
    assert all(r["ids"] == list(mine([r["c_code"]])[0]) for r in rows.collect())


upper_rows = local(lambda pdf: pdf.assign(c_code=pdf.c_code.str.upper()))


def test_map_rows(corpus):
    rows = scoring.map_rows(corpus.select("key", "c_code"), upper_rows, "key BIGINT, c_code STRING")
    assert {r["key"]: r["c_code"] for r in rows.collect()}[3] == "INT A3;"


def test_cross_validation_resumes(spark, corpus, tmp_path):
    out = str(tmp_path / "predictions")
    args = dict(models=["Baseline", "Proposed"], seeds=[42, 7], k=2)
    assert sinks.finished_runs(spark, out).count() == 0
    experiments.run_cross_validation(spark, corpus, "key", echo_model, out, **(args | {"models": ["Baseline"]}))
    first = {tuple(r) for r in sinks.read_predictions(spark, out).collect()}
    assert len(first) == 22
    experiments.run_cross_validation(spark, corpus, "key", echo_model, out, **args)
    rows = sinks.read_predictions(spark, out).collect()
    assert len(rows) == 44 and first <= {tuple(r) for r in rows}
    assert sinks.finished_runs(spark, out).count() == 8
    for r in rows:
        c = r["original_c"]
        shown = f"{BASELINE_PREFIX}{c}<" if r["model_type"] == "Baseline" else f"\n{c}<"
        assert shown in r["predicted_rust"]
        assert r["predicted_rust"].endswith("<|im_start|>assistant")
    # every row is tested exactly once per model and seed
    tested = sinks.read_predictions(spark, out).groupBy("model_type", "seed", "original_c").count()
    assert {r["count"] for r in tested.collect()} == {1} and tested.count() == 44
    plan = sinks.read_predictions(spark, out).where("seed = 7")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(seed" in plan


def test_null_sides_are_kept_in_predictions(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "r")], "key BIGINT, c_code STRING, safe_rust_code STRING")
    out = str(tmp_path / "p")
    assert experiments.run_single(spark, df, "key", echo_model, out)
    assert not experiments.run_single(spark, df, "key", echo_model, out)
    (text,) = [p.read_text() for p in (tmp_path / "p").rglob("part-*")]
    assert json.loads(text)["original_c"] is None


def test_training_rows(corpus):
    rows = experiments.cross_validation_training(corpus, "key", "key", seeds=[42])
    sizes = {(r["fold"], r["split"]): r["count"] for r in rows.groupBy("fold", "split").count().collect()}
    assert sizes == {(0, "train"): 4, (0, "val"): 1, (1, "train"): 5, (1, "val"): 1}


def test_zip_and_records(spark, corpus):
    predictions = spark.createDataFrame([(1, " x "), (2, "y")], "key BIGINT, answer STRING")
    zipped = scoring.zip_predictions(corpus, predictions, ["key"])
    rows = scoring.prediction_records(zipped, "c_code", "safe_rust_code", "answer").collect()
    assert {(r["original_c"], r["predicted_rust"]) for r in rows} == {("int a1;", "x"), ("int a2;", "y")}


fencing_model = local(lambda prompts: [f"Sure\n```rust\nfn n{len(p)}() {{}}\n```" for p in prompts])


def test_translate_single_snippet(spark):
    df = spark.createDataFrame([("int main() {}",)], "snippet STRING")
    got = experiments.translate(df, "snippet", fencing_model).first()["translation"]
    assert got.startswith("fn n") and got.endswith("() {}")


def test_corpus_positions_over_blocks(spark, tmp_path):
    for name, start in (("part-0", 0), ("part-1", 1500)):
        lines = [json.dumps({"task_name": str(start + i), "c_code": "x" * 90}) for i in range(1500)]
        (tmp_path / f"{name}.json").write_text("\n\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = files.load_corpus_with_position(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3000
    assert all(r["position"] == int(r["task_name"]) for r in rows)


def test_load_corpus(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"task_name": "t", "c_code": "c", "safe_rust_code": "r", "n": 1}\n')
    assert files.load_corpus(spark, str(tmp_path)).first().asDict() == {
        "task_name": "t", "c_code": "c", "safe_rust_code": "r",
    }
    assert files.load_corpus(spark, str(tmp_path), None).first()["n"] == 1


def test_prediction_array_read_back(spark, tmp_path):
    records = [{"original_c": "c", "true_rust": None, "predicted_rust": "é"}] * 2
    (tmp_path / "p.json").write_text(json.dumps(records, indent=2))
    assert [r.asDict() for r in sinks.read_prediction_array(spark, str(tmp_path)).collect()] == records


def test_stream_keeps_pairs_of_earlier_files(spark, tmp_path):
    root, out, state = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    (root / "d").mkdir(parents=True)

    def land(name, *pairs):
        lines = [json.dumps({"C": c, "Rust": r, "name": n}) for c, r, n in pairs]
        (root / "d" / name).write_text("\n".join(lines))
        start_corpus_stream(spark, str(root), str(out), state).awaitTermination()
        text = "".join(p.read_text() for p in sorted(out.rglob("part-*")))
        return sorted(json.loads(x)["task_name"] for x in text.splitlines())

    assert land("1.jsonl", ("int a;", "fn a(){}", "one"), ("// c", "x", "dropped")) == ["one"]
    again = ("int a; // same", "fn a(){}", "two")
    assert land("2.jsonl", again, ("int b;", "fn b(){}", "three")) == ["one", "three"]


def test_runs_before_a_failure_stay_and_are_not_repeated(spark, tmp_path):
    df = spark.createDataFrame([(i, f"int a{i};", f"let a{i};") for i in range(40)], "key INT, c_code STRING, safe_rust_code STRING")
    out, args = str(tmp_path / "out"), {"models": ["Baseline"], "seeds": [1, 2]}

    def failing():
        def call(texts):
            if any("a39;" in t for t in texts):
                raise ValueError("model failed")
            return texts
        return call

    with pytest.raises(Exception, match="model failed"):
        experiments.run_cross_validation(spark, df, "key", failing, out, **args)
    experiments.run_cross_validation(spark, df, "key", echo_model, out, **args)
    saved = sinks.read_predictions(spark, out)
    assert saved.groupBy("model_type", "seed", "fold").count().count() == 4
    assert saved.count() == 80 and saved.select("seed", "position").distinct().count() == 80
    first = saved.where("position = 7").first()
    assert first["original_c"] == "int a7;"


def test_dry_run_and_training_rows_of_the_single_run(spark, tmp_path):
    df = spark.createDataFrame([(i, f"int a{i};", f"let a{i};") for i in range(60)], "key INT, c_code STRING, safe_rust_code STRING")
    out = str(tmp_path / "single")
    assert experiments.run_single(spark, df, "key", echo_model, out, batch_size=2, dry_run=True)
    assert spark.read.json(out).count() == 2
    rows = experiments.single_run_training(df, "key")
    assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 48, "val": 6}


def test_all_runs_share_one_scan_of_the_corpus(spark, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "c"))
    runs = grid.run_grid(spark)
    tests = experiments.cross_validation_tests(rows, runs, "key", [42, 1337, 2024, 777, 999])
    assert runs.count() == 20 and tests.count() == 10 * rows.count()
    plan = tests._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    # all others read the key alone, for the cut points
    assert len([x for x in scans if "c_code" in x]) == 1


def test_no_rows_no_runs(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    experiments.run_cross_validation(spark, corpus.limit(0), "key", echo_model, out, seeds=[5])
    assert sinks.finished_runs(spark, out).count() == 0


def test_only_failed_runs_are_left_out(spark, corpus, tmp_path):
    out, args = str(tmp_path / "out"), {"seeds": [5, 6, 7]}
    failing = local(lambda ps: [p[len("x") - 1 :] if "int a3;" not in p else p + 1 for p in ps])
    with pytest.raises(RuntimeError, match="can only concatenate str") as error:
        experiments.run_cross_validation(spark, corpus, "key", failing, out, **args)
    # row 3 is a test row once per model and seed
    assert str(error.value).count("TypeError") == 6
    assert sinks.finished_runs(spark, out).count() == 6
    experiments.run_cross_validation(spark, corpus, "key", echo_model, out, **args)
    saved = sinks.read_predictions(spark, out)
    assert sinks.finished_runs(spark, out).count() == 12 and saved.count() == 66
    assert not list((tmp_path / "out").glob("_staging*"))


def test_batches_hold_rows_of_one_run_in_order(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    whole = corpus.coalesce(1)
    experiments.run_cross_validation(spark, whole, "key", echo_model, out, models=["Baseline"], seeds=[42])
    rows = sinks.read_predictions(spark, out).orderBy("fold", "position").collect()
    sizes = {f: [r["predicted_rust"][1] for r in rows if r["fold"] == f] for f in (0, 1)}
    assert sizes == {0: list("444422"), 1: list("44441")}


def test_prediction_arrays(spark, tmp_path):
    texts = ["plain", 'q"\\/\n\t\x01', "é😀\u2028", "", None, "  }\n"]
    rows = [("M", 1, f, 10 * i, t, texts[i - 1], f"{f}{t}") for f in (0, 1) for i, t in enumerate(texts)]
    kinds = "model_type STRING, seed INT, fold INT, position INT, original_c STRING, true_rust STRING, predicted_rust STRING"
    sinks.write_prediction_arrays(spark.createDataFrame(rows[::-1], kinds).repartition(3), str(tmp_path / "a"))
    names = ["original_c", "true_rust", "predicted_rust"]
    for f in (0, 1):
        folder = tmp_path / "a" / "model_type=M" / "seed=1" / f"fold={f}"
        text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
        want = [dict(zip(names, r[4:])) for r in rows if r[2] == f]
        assert text == json.dumps(want, indent=2) + "\n"
        (tmp_path / "one" / "model_type=M" / "seed=1" / f"fold={f}").mkdir(parents=True)
        (tmp_path / "one" / "model_type=M" / "seed=1" / f"fold={f}" / "predictions.json").write_text(text.strip())
    for path in ("a", "one"):
        back = sinks.read_prediction_arrays(spark, str(tmp_path / path)).collect()
        assert sorted(map(str, back)) == sorted(str(r) for r in spark.createDataFrame([(*r[4:], *r[:3]) for r in rows], "original_c STRING, true_rust STRING, predicted_rust STRING, model_type STRING, seed INT, fold INT").collect())


def test_dry_run_scores_the_first_batch_of_each_run(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    experiments.run_cross_validation(spark, corpus, "key", echo_model, out, seeds=[42], batch_size=2, dry_run=True)
    rows = sinks.read_predictions(spark, out).collect()
    assert len(rows) == 8 and len({(r["fold"], r["position"]) for r in rows}) == 4


def test_training_tables_store_every_row_once(spark, corpus, tmp_path):
    tables = experiments.write_training_tables(corpus, "key", "key", str(tmp_path / "t"), seeds=[42, 7])
    assert tables.encoded.count() == 11 and tables.members.count() == 22
    again = experiments.training_tables(spark, str(tmp_path / "t"), "key")
    one = again.run(42, 1, "train")
    assert one.count() + again.run(42, 1, "val").count() + again.run(42, 0, "train").count() + again.run(42, 0, "val").count() == 11
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seed" in plan and plan.count("FileScan") == 2
    direct = experiments.training_examples(corpus, ["key"]).collect()
    stored = {r["key"]: tuple(r["input_ids"]) for r in tables.encoded.collect()}
    assert stored == {r["key"]: tuple(r["input_ids"]) for r in direct}


def test_stream_keeps_no_state_and_equals_the_batch_job(spark, tmp_path):
    """Many micro-batches of files in name order: the corpus of the batch job, no state in memory."""
    root, out, state = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    (root / "d").mkdir(parents=True)
    for f in range(12):
        lines = [json.dumps({"C": f"int a{(7 * f + i) % 40};", "Rust": "fn a() {}", "name": f"{f:02}-{i}"}) for i in range(9)]
        (root / "d" / f"{f:02}.jsonl").write_text("\n".join([*lines, lines[0]]))
        os.utime(root / "d" / f"{f:02}.jsonl", (1_000_000 + f, 1_000_000 + f))
    query = start_corpus_stream(spark, str(root), str(out), state, max_files_per_batch=1)
    query.awaitTermination()
    assert len(list(out.glob("batch=*"))) == 12
    assert all(not p["stateOperators"] for p in query.recentProgress)
    streamed = [json.loads(x)["task_name"] for p in sorted(out.rglob("part-*")) for x in p.read_text().splitlines()]
    run_corpus_build(spark, str(root), str(tmp_path / "batch"))
    corpus = files.load_corpus_with_position(spark, str(tmp_path / "batch" / CORPUS_NAME))
    assert streamed == [r["task_name"] for r in corpus.orderBy("position").collect()]


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    rows = [(json.dumps({"C": f"int a{i % 5};", "Rust": "fn a() {}", "name": str(i)}), "d", "f", 0) for i in range(9)]
    batch = spark.createDataFrame(rows, "value STRING, folder STRING, file STRING, block BIGINT").coalesce(1)
    for number in (0, 1, 0):
        append_batch(batch, number, str(tmp_path / "o"), str(tmp_path / "s"), CorpusOptions())
    lines = [sorted(json.loads(x)["task_name"] for p in (tmp_path / "o").glob(f"batch=*{n}/part-*") for x in p.read_text().splitlines()) for n in (0, 1)]
    assert lines == [["0", "1", "2", "3", "4"], []]
    assert [p.name for p in (tmp_path / "s").iterdir()] == ["seen"]
