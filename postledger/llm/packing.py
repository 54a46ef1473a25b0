"""Best-fit packing of token sequences by bin completion.

Texts become token ids; only texts of more than `capacity` ids are cut, so a
packing is a question about lengths from 1 to capacity. The histogram of the
lengths (at most `capacity` rows, whatever the size of the corpus) goes to
the driver, where bin completion finds fillings: the largest length left is
placed, undominated fillings of the room beside it are enumerated, branches
are pruned by the waste still allowed, and the best-fit decreasing solution
is the first incumbent. Each filling holds for as many sequences as the
counts allow. Pieces then take their places by their rank among pieces of
equal length; ranks are counted within salted parts of each length, so a
length that a third of all pieces share is no hot key.

Defined results: a null text is empty (only the closing id); repeated rows
are packed as rows of their own; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postledger.llm.common import cut, small_batches

CAPACITY = 4096
CLOSING_ID = 1
#: Nodes of one filling's search, and of the whole search beyond the first descent.
FILL_NODES = 400
SEARCH_NODES = 2000
#: Pieces that are encoded as one text.
TOGETHER = 256
#: Words that a worker remembers, in each of two generations.
_REMEMBER = 600_000

_encoders: dict[str, "_Encoder"] = {}


def _lower(text: str) -> str:
    """The tokenizer reads lower case; in ASCII and Latin-1, where all rules of lower case agree, that can be done first, so that fewer pieces differ."""
    if "<|" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class _Encoder:
    """Ids of whole texts. A piece between spaces has the same ids wherever it stands, so pieces are remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        for mark in "★♥☆♡✓•●♪☀":  # a character that is one id by itself: it parts the pieces of a batch
            ids = self.tok.encode(mark, add_special_tokens=False).ids
            if len(ids) == 1:
                self.mark, self.mark_id = mark, ids[0]
                break
        else:
            raise ValueError("no character of this vocabulary is a single id")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _own(self, piece: str) -> bytes:
        return np.array(self.tok.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        odd = [p for p in pieces if self.mark in p or any(s in p for s in self.special)]
        rest = list(set(pieces).difference(odd))
        out = {p: self._own(p) for p in odd}
        parts = [rest[k : k + TOGETHER] for k in range(0, len(rest), TOGETHER)]
        joined = self.tok.encode_batch_fast([f" {self.mark} ".join(part) for part in parts], add_special_tokens=False)
        for part, found in zip(parts, joined, strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id).tolist()
            raw = ids.tobytes()
            out.update(zip(part, (raw[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_lower(t).replace("\n", " ").split(" ") for t in texts]
        young, old = self.young, self.old
        if len(young) > _REMEMBER:
            self.old, self.young = young, {}
            young, old = self.young, self.old
        need = set().union(*split).difference(young)
        fresh = {p: old[p] for p in need.intersection(old)}
        fresh.update(self.learn([p for p in need if p not in fresh]))
        here = fresh if len(fresh) > _REMEMBER else young
        if here is fresh:
            get = lambda p: fresh[p] if p in fresh else young[p]
        else:
            young.update((p, i) for p, i in fresh.items() if len(p) <= 48)
            long_ones = {p: i for p, i in fresh.items() if len(p) > 48}
            get = young.__getitem__ if not long_ones else lambda p: young[p] if p in young else long_ones[p]
        return [b"".join(map(get, s)) for s in split]


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = _encoder(path), np.array([closing], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode([t.decode("utf-8", "replace") if t else "" for t in b.column(1).to_pylist()]), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths of a bin, number of such bins)."""
    room: dict[int, list[list]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for r in sorted(k for k in room if k >= size):
            nxt = room.setdefault(r - size, []) if left else None
            while left and room[r]:
                bins, n = room[r].pop()
                take = min(n, left)
                left -= take
                nxt.append([(*bins, size), take])
                if take < n:
                    room[r].append([bins, n - take])
        each = capacity // size
        if left >= each:
            room.setdefault(capacity - each * size, []).append([(size,) * each, left // each])
        if left % each:
            room.setdefault(capacity - left % each * size, []).append([(size,) * (left % each), 1])
    return [(bins, n) for group in room.values() for bins, n in group]


def fillings(sizes: list[int], counts: dict[int, int], room: int, allowed: int, nodes: int, most: int = 3) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of `room` by least waste: (waste, lengths). sizes ascend; allowed: waste beyond which a branch ends."""
    found: list[tuple[int, tuple[int, ...]]] = []
    bound, budget = allowed, nodes

    def undominated(used: tuple[int, ...], waste: int) -> bool:
        for x in set(used):  # a longer piece would fit in its place
            k = bisect_right(sizes, x + waste) - 1
            if k >= 0 and sizes[k] > x and counts[sizes[k]] > used.count(sizes[k]):
                return False
        return True

    def search(left: int, top: int, used: tuple[int, ...]) -> None:
        nonlocal bound, budget
        budget -= 1
        k = bisect_right(sizes, min(left, top)) - 1
        placed = False
        while k >= 0 and budget > 0 and not (found and found[0][0] == 0):
            s = sizes[k]
            if counts[s] > used.count(s):
                placed = True
                search(left - s, s, (*used, s))
                if len(used) >= 6:
                    break
            k -= 1
        if not placed and left <= bound and undominated(used, left):
            found.append((left, used))
            found.sort(key=lambda f: (f[0], len(f[1])))
            del found[most:]
            if len(found) == most:
                bound = found[-1][0]

    search(room, room, ())
    return found


def bin_completion(counts: dict[int, int], capacity: int, fill_nodes: int = FILL_NODES, search_nodes: int = SEARCH_NODES) -> list[tuple[tuple[int, ...], int]]:
    """As few bins as the search finds: (lengths of a bin, number of such bins)."""
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    least = -(-total // capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    stack: list[tuple[dict[int, int], list[tuple[tuple[int, ...], int]], int, int]] = [(counts, [], 0, total)]
    while stack and best_n > least and search_nodes > 0:
        left, done, bins, rest = stack.pop()
        done = list(done)
        left = dict(left)
        while left:
            search_nodes -= 1
            if bins + -(-rest // capacity) >= best_n:
                break
            top = max(left)
            sizes = sorted(left)
            taken = dict(left)
            taken[top] -= 1
            allowed = (best_n - 1 - bins) * capacity - rest
            options = fillings(sizes, taken, capacity - top, allowed, fill_nodes)
            if not options:
                break
            for waste, used in options[:0:-1] if search_nodes > 0 else []:
                if len(stack) < 64:
                    stack.append(_applied(left, done, bins, rest, (top, *used), 1))
            (_, used) = options[0]
            shape = (top, *used)
            times = min(left[s] // shape.count(s) for s in set(shape))
            left, done, bins, rest = _applied(left, done, bins, rest, shape, times)
        else:
            if bins < best_n:
                best, best_n = done, bins
    return best


def _applied(left, done, bins, rest, shape, times):
    left = dict(left)
    for s in shape:
        left[s] -= times
    return {s: n for s, n in left.items() if n}, [*done, (shape, times)], bins + times, rest - sum(shape) * times


def _places(packing: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank, its sequence and the offset of each run of equal places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    seq = 0
    for shape, n in packing:
        at = 0
        for s in shape:
            runs.setdefault(s, []).append((used.get(s, 0), seq, at))
            used[s] = used.get(s, 0) + n
            at += s
        seq += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing: int = CLOSING_ID
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = cut(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
            _pieces(tokenizer, capacity, closing), "doc_id long, piece int, start long, length long, ids_crc32 long"
        )
    )
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().toLocalIterator()}  # capacity rows at most
    places = _places(bin_completion(histogram, capacity))
    salts = max(64, sum(histogram.values()) // 500_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("rank", F.row_number().over(inside) - 1)
        .join(base, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                mine = length == s
                lo, first, offset = places[s]
                k = np.searchsorted(lo, rank[mine], "right") - 1
                seq[mine], at[mine] = first[k] + rank[mine] - lo[k], offset[k]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seq), pa.array(at)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
