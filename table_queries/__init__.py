"""Every operator as a query over the given tables, with its SQL counterpart.

The tables hold prose, so text queries first dress the whole text up as code
(``dress.py``): comments, literals and blank edges at every sentence end, comma and line
break.  Work therefore grows with the tables.
"""

from __future__ import annotations

from table_queries import chat, pairs, records, scoring, splits, text
from table_queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chat", "pairs", "records", "scoring", "splits", "text"]
