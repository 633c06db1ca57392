"""Splits of ``documents`` and the run grid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.constants import MODEL_TYPES, SEEDS
from pairloom.operators import grid, splits
from table_queries.registry import query, table

_SEEDS = ", ".join(f"({s})" for s in SEEDS)


def _sql_folds(source: str) -> str:
    """Two folds per seed; the first takes the odd row."""
    return f"""
        seeds(seed) AS (VALUES {_SEEDS}),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY seed
                      ORDER BY md5(concat(seed, '|', doc_id)), doc_id) - 1 AS place,
                 count(*) OVER (PARTITION BY seed) AS n
          FROM {source}, seeds
        ),
        members AS (
          SELECT *, CASE WHEN place < n - n // 2 THEN 0 ELSE 1 END AS test_fold FROM ranked
        )
    """


@query(f"WITH {_sql_folds('documents')} SELECT seed, doc_id, test_fold AS fold FROM members")
def kfold_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.kfold_split(docs, "doc_id")


@query(
    f"""
    WITH {_sql_folds('documents')},
    runs AS (SELECT seed, fold, doc_id, test_fold FROM members, (VALUES (0), (1)) f(fold)),
    train_val AS (
      SELECT seed, fold, doc_id,
        row_number() OVER (PARTITION BY seed, fold ORDER BY doc_id) - 1 AS place,
        count(*) OVER (PARTITION BY seed, fold) AS n
      FROM runs WHERE test_fold <> fold
    )
    SELECT seed, fold, doc_id, 'test' AS split FROM runs WHERE test_fold = fold
    UNION ALL
    SELECT seed, fold, doc_id,
      CASE WHEN place < floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'val' END
    FROM train_val
    """
)
def kfold_train_val(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.kfold_train_val(docs, "doc_id", "doc_id")


_SQL_SHARES = """
    WITH ranked AS (
      SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42|', doc_id)), doc_id) - 1 AS place,
             ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS held
      FROM documents
    ), shares AS (
      SELECT doc_id, CASE WHEN place < ceil(held * CAST(0.5 AS DOUBLE)) THEN 'test'
             WHEN place < held THEN 'val' ELSE 'train' END AS split
      FROM ranked
    )
"""


def _shares(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.split_by_shares(docs, "doc_id", 42)


@query(_SQL_SHARES + "SELECT doc_id, split FROM shares")
def split_80_10_10(spark, sf_dir):
    return _shares(spark, sf_dir)


@query(_SQL_SHARES + "SELECT split, count(*) AS n_rows FROM shares GROUP BY split")
def split_sizes(spark, sf_dir):
    return splits.split_sizes(_shares(spark, sf_dir))


@query(
    f"""
    WITH {_sql_folds('documents')}
    SELECT doc_id, source, text FROM documents
    WHERE doc_id IN (SELECT doc_id FROM members WHERE seed = 42 AND test_fold = 1)
    """
)
def select_by_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    index = splits.kfold_split(docs.select("doc_id"), "doc_id", [42]).where("fold = 1")
    return splits.select_by_index(docs, index, "doc_id")


_MODELS = ", ".join(f"('{m}')" for m in MODEL_TYPES)


@query(
    f"""
    WITH {_sql_folds('documents')}
    SELECT model_type, seed, test_fold AS fold, count(*) AS n_test
    FROM members, (VALUES {_MODELS}) m(model_type) GROUP BY ALL
    """
)
def run_grid(spark, sf_dir):
    """The grid with the number of rows each run has to score."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    sizes = splits.kfold_split(docs, "doc_id").groupBy("seed", "fold").agg(
        F.count("*").alias("n_test")
    )
    return grid.run_grid(spark).join(sizes, ["seed", "fold"]).select(*grid.RUN_KEYS, "n_test")


@query(
    f"""
    WITH {_sql_folds('labels')},
    counts AS (
      SELECT CASE WHEN quality = 1 THEN 'Proposed' ELSE 'Baseline' END AS model_type,
             seed, test_fold AS fold, count(*) AS n
      FROM members GROUP BY ALL
    ), done AS (
      SELECT model_type, seed, fold FROM (
        SELECT *, sum(n) OVER (PARTITION BY model_type, seed) AS total FROM counts)
      WHERE 2 * n >= total
    )
    SELECT model_type, seed, fold
    FROM (VALUES {_MODELS}) m(model_type), seeds, (VALUES (0), (1)) f(fold)
    WHERE (model_type, seed, fold) NOT IN (SELECT (model_type, seed, fold) FROM done)
    """
)
def pending_runs(spark, sf_dir):
    """Labels stand in for predictions: a run with half of its model's rows is finished."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = F.when(F.col("quality") == 1, "Proposed").otherwise("Baseline")
    predicted = splits.kfold_split(labels, "doc_id").withColumn("model_type", model)
    counts = predicted.groupBy(*grid.RUN_KEYS).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("model_type", "seed"))
    done = counts.withColumn("total", total).where("2 * n >= total")
    return grid.pending_runs(grid.run_grid(spark), done)
