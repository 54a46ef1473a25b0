"""A data source over landed board files: spark.read.format("board_pages"), a partition a file.

It only splits a file into its postings, as JSON text, and says which page of
which source they stood on and how many there were; fields are projected by
built-in functions afterwards. Files are opened through Arrow's file systems,
so any URI that Arrow knows can be read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postledger.sources import boards

SCHEMA = "source string, page int, page_rows int, posting string"
KINDS = {"board": (boards.BOARD, boards.board_postings), "paged": (boards.PAGED, boards.paged_postings), "extract": (boards.EXTRACT, boards.extract_postings)}


@dataclass
class Page(InputPartition):
    uri: str
    source: str
    page: int


def _files(path: str) -> list[Page]:
    """Files named <source>/<page>.json, or <source>.json for a whole document, below a folder."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    scheme = path.split("://")[0] if "://" in path else "file"
    found = []
    for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
        name = re.fullmatch(r"(?:(.+)/)?([^/]+)[.]json", f.path[len(root) :].lstrip("/"))
        if f.is_file and name:
            numbered = name[2].isdigit() and name[1]
            found.append(Page(f"{scheme}://{f.path}", name[1] if numbered else name[2], int(name[2]) if numbered else 0))
    return sorted(found, key=lambda p: (p.source, p.page))


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Page]:
        return _files(self.path)

    def read(self, partition: Page) -> Iterator[tuple]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.uri)
        with system.open_input_stream(path) as f:
            found = json.loads(f.read())
        rows = found["jobs"] if isinstance(found, dict) else found
        for row in rows:
            yield partition.source, partition.page, len(rows), json.dumps(row, ensure_ascii=False)
        if not rows:  # an empty page is a page too
            yield partition.source, partition.page, 0, None


class BoardPages(DataSource):
    """Options: path, the folder of the landed files."""

    @classmethod
    def name(cls) -> str:
        return "board_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        if "path" not in self.options:
            raise ValueError("board_pages needs a path")
        return PageReader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BoardPages)
    return spark.read.format("board_pages").load(path)


def postings(pages: DataFrame, kind: str, employer: str | None = None) -> DataFrame:
    """source and the common columns of the postings on pages of one kind."""
    schema, project = KINDS[kind]
    if kind == "board":  # the schema of a document; a posting is one of its jobs
        schema = schema.removeprefix("jobs array<struct<").removesuffix(">>")
    j = pages.where("posting IS NOT NULL").select("source", F.from_json("posting", schema).alias("j")).select("source", "j.*")
    return project(j, employer, "source")


def whole(pages: DataFrame) -> DataFrame:
    """source: those of which all pages were fetched."""
    counted = pages.groupBy(F.col("source").alias("source_id"), "page").agg(F.max("page_rows").alias("rows"))
    return boards.complete_pages(counted).where("complete").select(F.col("source_id").alias("source"))
