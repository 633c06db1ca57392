"""Each stage of the pipeline on its own input, against a plain version of what it decides."""

import corpus_pipeline
from conftest import SF
from pairloom.llm import pieces, secrets, simhash, toxicity
from pairloom.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F
from test_operators import plain_leaks, plain_spans


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after_df = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in after_df.collect()}
        assert after_df.columns[: len(columns)] == columns and set(after) <= set(before)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert after_df.columns == columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            scored = toxicity.toxicity(docs, labels).collect()
            assert set(after) == {r["doc_id"] for r in scored if r["predicted"] == 0}
        elif name == "near_copies":
            rows = [(i, simhash.fingerprint(r["text"], 4) & (1 << 64) - 1) for i, r in sorted(before.items())]
            low = {i: i for i, _ in rows}
            for _ in rows:
                changed = False
                for i, a in rows:
                    least = min(low[j] for j, b in rows if (a ^ b).bit_count() <= 4)
                    changed |= least != low[i]
                    low[i] = least
                if not changed:
                    break
            assert set(after) == {i for i in low if low[i] == i}
        elif name == "benchmark":
            items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
            leaks = plain_leaks([(i, r["text"]) for i, r in before.items()], items)
            assert set(after) == {i for i, found in leaks.items() if not found}
        elif name == "secrets":
            assert set(after) == set(before)
            for i, r in after.items():
                assert plain_spans(r["text"]) == [] and r["n_chars"] == (len(r["text"]) if r["text"] != before[i]["text"] else before[i]["n_chars"])
        elif name == "pieces":
            back = after_df.where(F.col("text") != pieces.decode(F.col("piece_ids"), pieces.model_path()))
            assert set(after) == set(before) and back.count() == 0
        docs = after_df


def test_queries_are_registered(spark):
    from __spark_entry__ import oracle_sql, queries

    found = queries()
    assert set(QUERIES) < set(found) and "pipeline" in found
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(oracle_sql())
