"""Parallel-corpus preparation on PySpark.

``functions``  Column -> Column building blocks (text, JSON records, chat, tokens)
``operators``  DataFrame -> DataFrame steps (filters, pairing, dedup, splits, scoring)
``sources``    folder discovery, Parquet / JSONL scans, JSON sinks
``plans``      whole jobs put together from the above
``streaming``  the incremental form of the corpus build
"""

__version__ = "0.1.0"
