"""How a costly step is computed: once a row, and by all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with further columns, each computed once a row.

    A condition on a projected column is pushed below the projection and holds
    its whole expression as often as it names the column; it is not pushed
    below a generator. Every row gives one row.
    """
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return rows.select(*(c for c in rows.columns if c not in columns), made)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all tasks: many rows of a small file, or of one row group, are a single task otherwise."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
