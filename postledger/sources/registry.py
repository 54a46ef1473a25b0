"""Connectors by name: each reads landed files into common postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postledger.sources import boards

Reader = Callable[..., DataFrame]
CONNECTORS: dict[str, Reader] = {"board": boards.board, "paged": boards.paged, "extract": boards.extract}


def register(name: str, reader: Reader) -> None:
    """Add a connector; a name is taken once."""
    if name in CONNECTORS:
        raise ValueError(f"connector {name!r} is taken")
    CONNECTORS[name] = reader


def read(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    return CONNECTORS[name](spark, path, **options)


def enabled(sources: DataFrame, wanted: DataFrame, prefix: str = "") -> DataFrame:
    """Sources whose key is listed (column key) and begins with a prefix."""
    return sources.join(wanted.select("key").distinct(), "key", "left_semi").where(F.col("key").startswith(prefix))
