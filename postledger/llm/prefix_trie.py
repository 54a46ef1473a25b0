"""Prefix trie of conversations by truncation peeling.

A conversation is one binary path of TURN bytes for each turn: 16 bytes of the
SHA-256 of its role and text, then the UTF-8 length of the text. Texts never
travel: they become digests where they are read. Copies are counted first, so
the rest works on different paths.

Paths are dealt over partitions by range. Each partition peels its stretches of
about CHUNK turns: from the greatest depth upwards, paths that end at a depth
are merged with the nodes that survive from below, and every node loses its
last turn and is grouped again, which finds the nodes and sums what their
subtrees hold in one pass. Only prefixes of the first and the last path of a
stretch can have members elsewhere; these are left over, as far as they are
summed, and are peeled in the next round, the last time all together. So rounds
follow the logarithm of the rows and not the longest conversation, and a hot
beginning lies in as many stretches as it has paths.

Defined results: null roles and texts are empty; rows without a conversation
id belong to none; rows of one turn, repeated or not, are ordered by the
digest of role and text; other columns are ignored; without rows there are no
nodes, not even a root; a text of any length counts whole; a conversation is
held in one row, TURN bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.llm.common import cut

#: Bytes of one turn in a path.
TURN = 20
#: Every so many neighbours share a beginning.
FAMILY = 5
#: Turns of the paths that a task peels at a time; left-overs of so few turns are peeled in one task.
CHUNK = 200_000


def turn_mark(role: Column, text: Column) -> Column:
    """A turn as 2 * TURN hex digits: half of a digest of role and text, then the bytes of the text."""
    said, by = F.coalesce(text, F.lit("")), F.coalesce(role, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256)
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.lower(F.hex(F.octet_length(said).cast("long"))), 8, "0"))


def rebuilt_paths(turns: DataFrame, family: int = FAMILY) -> DataFrame:
    """conv_id, path: the first h turns of the family's first conversation, then the own turns after h; h = crc32(conv_id) % 9."""
    conv = F.col("conv_id").cast("long")
    base = conv - conv % family
    rows = turns.where("conv_id IS NOT NULL").select(
        base.alias("base"), conv.alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), turn_mark(F.col("role"), F.col("text")).alias("mark")).alias("at")
    )
    # dealt by family once: both the grouping and the join below keep to it
    own = (
        rows.repartition("base")
        .groupBy("base", "conv_id")
        .agg(F.sort_array(F.collect_list("at")).alias("turns"))
        .select("base", "conv_id", F.expr("array_join(transform(turns, t -> t.mark), '')").alias("own"))
    )
    lead = own.where("conv_id = base").select("base", F.col("own").alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int") * F.lit(2 * TURN)
    return (
        own.join(lead, "base", "left")
        .withColumn("h", h)
        .select("conv_id", F.expr("unhex(concat(substring(coalesce(lead, ''), 1, h), substring(own, h + 1)))").alias("path"))
    )


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and id: a row for each stretch of one key in a batch, with its first id and its ids joined."""
    for b in batches:
        keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        ends = [*starts[1:], len(keys)]
        yield pa.RecordBatch.from_pydict(
            {
                "key": pa.array([keys[i] for i in starts], pa.binary()),
                "first": pa.array([ids[i] for i in starts], pa.int64()),
                "ids": [",".join(map(str, ids[i:j])) for i, j in zip(starts, ends)],
            }
        )


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stretches sorted by key and first id: the SHA-256 of all ids of a key, one stretch at a time."""
    key, state = None, None
    for b in batches:
        done: list[tuple[bytes, str]] = []
        for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"key": pa.array([d[0] for d in done], pa.binary()), "sha": [d[1] for d in done]})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "sha": [state.hexdigest()]})


def ends_digest(paths: DataFrame) -> DataFrame:
    """key, sha: digest of the ids that end at a path, ascending and joined; key is the MD5 of the path.

    Ids of one path are dealt over partitions by range, joined to stretches
    there, and only the stretches of a path meet, as a stream.
    """
    ends = paths.select(F.unhex(F.md5("path")).alias("key"), "conv_id")
    runs = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_joined_runs, "key binary, first long, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed_runs, "key binary, sha string")


#: What is known of a node: smallest member, members, children, childless nodes below, bytes saved below.
STATE = "conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def peel(items: list[tuple[bytes, list[int]]], open_ends: tuple[bytes, ...]) -> tuple[list[tuple[bytes, list[int]]], list[tuple[bytes, list[int]]]]:
    """Finished nodes (path, state) of some paths, and what is left over: the nodes that are prefixes of an open end."""
    levels: dict[int, dict[bytes, list[int]]] = {}

    def merge(path: bytes, state: list[int]) -> None:
        at = levels.setdefault(len(path), {})
        old = at.get(path)
        if old is None:
            at[path] = state
        else:
            at[path] = [min(old[0], state[0]), *(x + y for x, y in zip(old[1:], state[1:]))]

    for path, state in items:
        merge(path, state)
    done, left = [], []
    for depth in range(max(levels, default=-1), -1, -TURN):
        for path, (conv, members, children, leaves, saved) in levels.pop(depth, {}).items():
            if any(end.startswith(path) for end in open_ends):
                left.append((path, [conv, members, children, leaves, saved]))
                continue
            node = [conv, members, children, leaves if children else 1, saved + (members - 1) * int.from_bytes(path[-4:], "big")]
            done.append((path, node))
            if path:
                merge(path[:-TURN], [conv, members, 1, node[3], node[4]])
    return done, left


def _peeled(last: bool, chunk: int):
    def rows(nodes: list[tuple[bytes, list[int]]], finished: bool) -> pa.RecordBatch:
        paths, state = [p for p, _ in nodes], list(zip(*(s for _, s in nodes)))
        key = lambda p: hashlib.md5(p, usedforsecurity=False).digest()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([finished] * len(paths), pa.bool_()),
                pa.array([None if finished else p for p in paths], pa.binary()),
                pa.array([key(p) for p in paths], pa.binary()),
                pa.array([key(p[:-TURN]) if p else None for p in paths], pa.binary()),
                pa.array([len(p) // TURN for p in paths], pa.int64()),
                *(pa.array(x, pa.int64()) for x in state),
            ],
            ["finished", "path", "key", "up", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[bytes, list[int]]] = []
        turns = 0
        for b in batches:
            for path, *state in zip(*(c.to_pylist() for c in b.columns)):
                items.append((path, state))
                turns += 1 + len(path) // TURN
                if turns >= chunk and not last:
                    yield from stretch(items)
                    items, turns = [], 0
        if items:
            yield from stretch(items)

    def stretch(items: list[tuple[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        done, left = peel(items, () if last else (items[0][0], items[-1][0]))
        for nodes, finished in ((done, True), (left, False)):
            for k in range(0, len(nodes), 10_000):
                yield rows(nodes[k : k + 10_000], finished)

    return run


def nodes_of(paths: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, up (the parent's key), depth and state of every node of a table of paths (conv_id, path)."""
    zero = F.lit(0).cast("long")
    copies = paths.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    items = cut(copies.withColumns({"n_children": zero, "n_leaves": zero, "saved_tokens": zero}))
    size = F.coalesce(F.sum(F.expr(f"1 + octet_length(path) div {TURN}")), F.lit(0))
    n, rounds = items.agg(size).first()[0], []
    schema = f"finished boolean, path binary, key binary, up binary, depth long, {STATE}"
    while True:
        last = n <= chunk
        dealt = items.repartition(1) if last else items.repartitionByRange("path").sortWithinPartitions("path")
        out = cut(dealt.mapInArrow(_peeled(last, chunk), schema))
        rounds.append(out.where("finished").drop("finished", "path"))
        if last:
            return reduce(DataFrame.unionByName, rounds)
        items = out.where("NOT finished").select("path", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        left = items.agg(size).first()[0]
        if left > n // 2:  # conversations longer than a stretch: larger stretches leave less
            chunk *= 2
        n = left


def prefix_trie(paths: DataFrame) -> DataFrame:
    """Nodes of conversations (conv_id, path), each with its parent's smallest member and the digest of the members that end there."""
    written = cut(paths.select("conv_id", "path"))
    nodes = nodes_of(written)
    above = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(ends_digest(written), "key", "left")
        .join(above, "up", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
