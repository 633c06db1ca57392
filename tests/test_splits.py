import hashlib
import math

import pytest
from pyspark.sql import functions as F

from pairloom.constants import NUM_FOLDS, SEEDS
from pairloom.operators import batches, grid, ranks, splits


def table(spark, n, start=0):
    return spark.range(start, start + n).withColumnRenamed("id", "key").repartition(3)


def by_hash(seed, keys):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("n,k", [(2, 2), (10, 2), (11, 2), (11, 3), (500, 7)])
def test_kfold_equals_the_rule(spark, n, k):
    rows = splits.kfold_split(table(spark, n), "key", [42, 7], k).collect()
    for seed in (42, 7):
        order = by_hash(seed, range(n))
        sizes = [n // k + (i < n % k) for i in range(k)]
        want, at = {}, 0
        for fold, size in enumerate(sizes):
            want |= {key: fold for key in order[at : at + size]}
            at += size
        assert {r["key"]: r["fold"] for r in rows if r["seed"] == seed} == want


@pytest.mark.parametrize("n", [2, 10, 11, 300])
def test_validation_is_the_tail_in_corpus_order(spark, n):
    df = table(spark, n, start=1000)
    rows = splits.kfold_train_val(df, "key", "key").collect()
    folds = {(r["seed"], r["key"]): r["fold"] for r in splits.kfold_split(df, "key").collect()}
    assert len(rows) == n * len(SEEDS) * NUM_FOLDS
    for seed in SEEDS:
        for fold in range(NUM_FOLDS):
            mine = {r["key"]: r["split"] for r in rows if (r["seed"], r["fold"]) == (seed, fold)}
            rest = sorted(k for k in mine if folds[seed, k] != fold)
            cut = int(len(rest) * 0.9)
            want = {k: "train" for k in rest[:cut]} | {k: "val" for k in rest[cut:]}
            want |= {k: "test" for k in mine if folds[seed, k] == fold}
            assert mine == want


@pytest.mark.parametrize("n", [1, 2, 5, 10, 11, 257])
def test_shares(spark, n):
    rows = splits.split_by_shares(table(spark, n), "key", 42)
    sizes = {r["split"]: r["n_rows"] for r in splits.split_sizes(rows).collect()}
    held = math.ceil(0.2 * n)
    test = math.ceil(0.5 * held)
    want = {"train": n - held, "test": test, "val": held - test}
    assert sizes == {k: v for k, v in want.items() if v}


def test_splits_do_not_depend_on_partitioning(spark):
    one = splits.kfold_split(table(spark, 200).coalesce(1), "key").collect()
    many = splits.kfold_split(table(spark, 200).repartition(9), "key").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_splits_survive_skewed_ordinals(spark):
    """Most ordinals close together, a few far away: buckets follow the rows."""
    df = spark.range(1000).select(
        F.col("id").alias("key"),
        F.when(F.col("id") < 990, F.col("id")).otherwise(F.col("id") * 10**12).alias("pos"),
    )
    bucketed = ranks.with_ordinal_bucket(df, "pos", "b", ranges=50)
    assert max(r["count"] for r in bucketed.groupBy("b").count().collect()) < 60
    ranked = ranks.global_rank(bucketed, [], ["pos"], "b", "rank")
    assert all(r["rank"] == r["key"] for r in ranked.collect())


def test_global_rank_in_groups_with_equal_ordinals(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").alias("key"), F.lit(5).alias("pos"))
    bucketed = ranks.with_ordinal_bucket(df, "pos", "b")
    ranked = ranks.global_rank(bucketed, ["g"], ["pos", "key"], "b", "rank")
    assert all(r["rank"] == r["key"] // 2 for r in ranked.collect())


ORDINALS = {
    "equal": "CASE WHEN id % 10 > 0 THEN 7 ELSE id END",
    "task ids": "shiftleft(id % 8, 33) + id DIV 8",
    "far apart": "CASE WHEN id < 5 THEN -1000000000000000000 WHEN id < 9 THEN 100000000000000000 ELSE id * 3 END",
    "null": "CASE WHEN id % 50 > 0 THEN id END",
}


@pytest.mark.parametrize("name", ORDINALS)
def test_ranks_of_any_ordinals_stay_balanced(spark, name):
    """No job runs while the plan is made; ranks are those of one sort, buckets stay small."""
    rows, tie = 20_000, ["key"]
    df = spark.range(rows).select(F.col("id").alias("key"), F.expr(ORDINALS[name]).cast("bigint").alias("pos"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "ranks")
    bucketed = ranks.with_ordinal_bucket(df, "pos", "b", tie, ranges=256)
    ranked = ranks.global_rank(bucketed, [], [F.col("pos"), *ranks.tie_order(tie)], "b", "rank")
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("running", "ranks")
    sizes = [r["count"] for r in bucketed.groupBy("b").count().collect()]
    assert max(sizes) <= 6 * rows / 256 or name == "null" and sorted(sizes)[-2] <= 6 * rows / 256
    got = {r["key"]: r["rank"] for r in ranked.collect()}
    order = df.select("key", "pos", *[c.alias(f"t{i}") for i, c in enumerate(ranks.tie_order(tie))]).collect()
    order.sort(key=lambda r: (r["pos"] is not None, r["pos"] or 0, r["t0"], r["key"]))
    assert [got[r["key"]] for r in order] == list(range(rows))


def test_every_text_is_encoded_once(spark):
    """The plan of padded batches reads the ids that were written; no text is cut again."""
    df = spark.createDataFrame([(i, "a b " * (i % 5)) for i in range(30)], "key INT, text STRING")
    padded = batches.padded_batches(df, "key", F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), F.lit("_"))
    plan = padded._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "[a-z]" not in plan
    for r in padded.collect():
        width = max(2 * (i % 5) for i in range(r["key"] // 4 * 4, min(30, r["key"] // 4 * 4 + 4)))
        own = 2 * (r["key"] % 5)
        assert r["input_ids"] == ["_"] * (width - own) + ["a", "b"] * (own // 2)
        assert r["attention_mask"] == [0] * (width - own) + [1] * own


def test_batches(spark):
    rows = batches.batch_ids(table(spark, 9), "key", 4).collect()
    assert {r["key"]: r["batch_id"] for r in rows} == {i: i // 4 for i in range(9)}
    assert [r["key"] for r in batches.first_batch(table(spark, 9), ["key"]).collect()] == [0, 1, 2, 3]


def test_left_pad(spark):
    df = spark.createDataFrame([(0, [1]), (0, [1, 2, 3]), (1, [7])], "batch_id INT, ids ARRAY<INT>")
    got = {(r["batch_id"], tuple(r["ids"]), tuple(r["attention_mask"])) for r in batches.left_pad(df, "ids", F.lit(0)).collect()}
    assert got == {(0, (0, 0, 1), (0, 0, 1)), (0, (1, 2, 3), (1, 1, 1)), (1, (7,), (1,))}


def test_grid_and_pending(spark):
    runs = grid.run_grid(spark)
    assert runs.count() == 20 and runs.distinct().count() == 20
    done = spark.createDataFrame([("Proposed", 42, 1)] * 3, "model_type STRING, seed INT, fold INT")
    left = {tuple(r) for r in grid.pending_runs(runs, done).collect()}
    assert len(left) == 19 and ("Proposed", 42, 1) not in left


def test_select_by_index(spark):
    index = spark.createDataFrame([(3,), (3,), (5,)], "key BIGINT")
    assert {r["key"] for r in splits.select_by_index(table(spark, 9), index, "key").collect()} == {3, 5}


def test_split_plan_moves_no_rows(spark):
    """The labelled table itself is joined to broadcast cuts, never shuffled."""
    df = table(spark, 50).withColumn("text", F.lit("x"))
    plan = splits.kfold_split(df.coalesce(1), "key")._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in top and "Exchange hashpartitioning" not in top
