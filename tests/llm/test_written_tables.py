"""Written steps: shuffle files and tables go when they are no longer read, settings are put back."""

import os

import pytest
from pyspark.sql import functions as F

from postledger.llm.common import components, cut, drop, shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _tables(spark):
    return {n for n in os.listdir(shared_dir(spark).removeprefix("file://")) if n.startswith("cut-")}


def test_cut_and_drop(spark):
    before, setting = _tables(spark), spark.conf.get(CLEANUP)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = cut(counts)
    assert spark.conf.get(CLEANUP) == setting
    assert {tuple(r) for r in table.collect()} == {tuple(r) for r in counts.collect()}
    assert len(_tables(spark) - before) == 1
    drop(table)
    assert _tables(spark) == before
    with pytest.raises(KeyError):
        drop(table)


def test_components_keep_only_the_last_round(spark):
    before = _tables(spark)
    edges = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = components(edges)
    assert {tuple(r) for r in found.collect()} == {(n, 0) for n in range(41)}
    assert len(_tables(spark) - before) == 1
