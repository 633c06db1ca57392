"""Plan shape helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(
    df: DataFrame, columns: dict[str, Column], keep: Column | None = None
) -> DataFrame:
    """Add columns that later steps use several times, and optionally filter on them.

    A plain ``withColumn`` followed by ``where`` lets the optimizer copy the expression
    into the filter, so a costly one (JSON parsing, comment removal) runs twice per row.
    As the output of a generator it is computed once.  ``keep`` may refer to the new
    columns as fields of ``F.col("it")``.
    """
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    if keep is not None:
        made = F.filter(made, lambda it: keep(it))
    return df.select("*", F.inline(made))

