"""Removal of repeated byte strings by a suffix array of two-stage sorting.

A byte is removed if a `length`-byte string covering it also starts anywhere
else in the corpus (the same document included).

Every string of `length` bytes is filed under an anchor that depends on the
string alone: the place of the least hash among its runs of `length / 2`
bytes (the leftmost, if equal). Neighbouring starts share anchors, so a
document has about four regions per `length` bytes: an anchor with the starts
filed under it. Only hashes of anchors and regions are shuffled. A region
that occurs twice is repeated as a whole; an anchor with several different
regions needs a closer look, one copy of each region.

Those regions meet by anchor, and their starts are sorted in two stages:
suffixes smaller than their successors are sorted directly, eight bytes at a
time; the others are induced by a scan of the buckets in order, a suffix
entering its bucket when its successor is met. Adjacent suffixes with a
common prefix of `length` bytes or more are repeats. Documents then lose the
union of their repeated strings.

Regions and anchors are compared by 64-bit hashes, repeats within an anchor
by their bytes.

Defined results: a null text counts as empty; texts shorter than `length`
keep everything; repeated rows repeat every string of theirs; rows with a
null id are rows like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postledger.llm.common import bitset, cut, maybe, mix, small_batches

LENGTH = 200
#: Bytes of a text that are looked at together, and of regions that are sorted together.
SEGMENT, BATCH = 1 << 22, 1 << 22
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", _R), ("down", _R_INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    grid = pad.reshape(-1, w)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def regions(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """anchor, region (hashes), first start and number of starts of every region."""
    k = length // 2
    w = length - k + 1
    out = []
    for base in range(0, max(0, len(text) - length + 1), SEGMENT):
        b = np.frombuffer(text, np.uint8)[base : base + SEGMENT + length - 1]
        n = len(b)
        up, down = _power(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        h = mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])
        low = np.uint64(0xFFFFFF)
        place = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), w) & low
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, len(place)])
        at = place[first].astype(np.int64)
        body = (prefix[first + count - 1 + length] - prefix[first]) * down[first]
        region = mix(mix(body) ^ ((at - first).astype(np.uint64) << np.uint64(32)) ^ count.astype(np.uint64))
        out.append((h[at], region, first + base, count))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class _Suffixes:
    """Starts of regions in the order of their first `length` bytes."""

    def __init__(self, texts: list[bytes], starts: list[int], length: int):
        gap = b"\0" * length
        sizes = np.array([len(t) for t in texts], np.int64)
        self.offset = np.cumsum(np.r_[0, sizes[:-1] + length])
        self.t = np.frombuffer(gap.join([*texts, b""]) + gap, np.uint8)
        self.length = length
        self.starts = np.array(starts, np.int64)
        self.ends = self.offset + sizes

    def words(self, at: np.ndarray, k: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.t, 8)[at + 8 * k].copy().view(">u8")[:, 0].astype(np.uint64)

    def _tail(self, k: int) -> np.uint64:
        """Mask of the bytes of word k within the length."""
        inside = min(8, self.length - 8 * k)
        return np.uint64((0xFFFFFFFFFFFFFFFF << (8 * (8 - inside))) & 0xFFFFFFFFFFFFFFFF)

    def direct(self, at: np.ndarray) -> np.ndarray:
        """First stage: sort by bytes, a word at a time, while there are ties."""
        order = np.array(at)
        slots, group = np.arange(len(at)), np.zeros(len(at), np.int64)
        for k in range(-(-self.length // 8)):
            w = self.words(order[slots], k) & self._tail(k)
            by = np.lexsort((w, group))
            order[slots] = order[slots][by]
            w = w[by]
            new = np.r_[True, (group[1:] != group[:-1]) | (w[1:] != w[:-1])]
            tied = ~(new & np.r_[new[1:], True])
            group, slots = np.cumsum(new)[tied], slots[tied]
            if not len(slots):
                break
        return order

    def order(self) -> np.ndarray:
        t = self.t
        # the next place with another byte tells whether a suffix is larger than its successor
        change = np.flatnonzero(t[1:] != t[:-1]) + 1
        nxt = np.full(len(t), len(t) - 1)
        nxt[: change[-1]] = np.repeat(change, np.diff(np.r_[0, change]))
        end = np.zeros(len(t), np.int64)
        mine = np.zeros(len(t), bool)
        for o, n, e in zip(self.offset.tolist(), self.starts.tolist(), self.ends.tolist(), strict=True):
            mine[o : o + n] = True
            end[o:e] = e
        larger = (t[nxt] < t) & (nxt < end)
        # a larger suffix needs its successor; follow it until one is sorted directly
        edge = np.flatnonzero(mine & larger)
        while len(edge := edge + 1):
            edge = edge[(edge < end[edge]) & ~mine[edge]]
            mine[edge] = True
            edge = edge[larger[edge]]
        larger &= mine & np.r_[mine[1:], False]
        sorted_ = self.direct(np.flatnonzero(mine & ~larger))
        bounds = np.searchsorted(t[sorted_], np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        out = []

        def induce(at: np.ndarray, c: int) -> np.ndarray:
            """Put predecessors of a scanned run into their buckets; those of this bucket are scanned next."""
            before = at[at > 0] - 1
            before = before[larger[before]]
            b = t[before]
            for x in np.unique(b):
                if x != c:
                    waiting[x].append(before[b == x])
            return before[b == c]

        for c in range(256):
            run = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
            while len(run):
                out.append(run)
                run = induce(run, c)
            run = sorted_[bounds[c] : bounds[c + 1]]
            if len(run):
                out.append(run)
                induce(run, c)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(region, start within it) of every start whose `length` bytes start elsewhere too."""
        sa = self.order()
        owner = np.searchsorted(self.offset, sa, "right") - 1
        inside = sa - self.offset[owner] < self.starts[owner]
        sa, owner = sa[inside], owner[inside]
        same = np.arange(max(0, len(sa) - 1))
        for k in range(-(-self.length // 8)):
            if not len(same):
                break
            same = same[((self.words(sa[same], k) ^ self.words(sa[same + 1], k)) & self._tail(k)) == 0]
        hit = np.unique(np.r_[same, same + 1])
        return owner[hit], sa[hit] - self.offset[owner[hit]]


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = regions(t or b"", length)
                if len(found[0]):
                    for c, x in zip(cols, (found[0].view(np.int64), found[1].view(np.int64), np.full(len(found[0]), rid), found[2], found[3]), strict=True):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["anchor", "region", "rid", "s", "starts"])

    return run


def _cut_out(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, t, found in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows.extend((f["anchor"], rid, f["s"], f["starts"], t[f["s"] : f["s"] + f["starts"] - 1 + length]) for f in found)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["anchor", "rid", "s", "starts", "bytes"])

    return run


def _sort_regions(length: int):
    def one(rows: list[tuple]) -> pa.RecordBatch:
        suffixes = _Suffixes([r[4] for r in rows], [r[3] for r in rows], length)
        owner, at = suffixes.repeated()
        rid, s = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        by = np.lexsort((at, owner))
        owner, at = owner[by], at[by]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)][: len(at)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)][: len(first)] - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(rid[owner[first]]), pa.array(s[owner[first]] + at[first]), pa.array(s[owner[first]] + at[last] + length)], ["rid", "a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:  # sorted by anchor
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > BATCH and row[0] != rows[-1][0]:
                    yield one(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield one(rows)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for rid, t, spans in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            at, out, n = 0, [], 0
            first = last = -1
            for s in sorted((x["a"], x["b"]) for x in spans):
                if s[0] > last:
                    if last >= 0:
                        out.append(t[at:first])
                        at = last
                    n += 1
                    first, last = s
                else:
                    last = max(last, s[1])
            out.append(t[at:first])
            out.append(t[last:])
            kept = b"".join(out)
            rows.append((rid, len(t) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["rid", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rid, a, b: repeated strings of rows (rid, text as binary); spans of one text may overlap."""
    by_anchor = Window.partitionBy("anchor")
    by_region = Window.partitionBy("anchor", "region")
    matched = cut(
        rows.mapInArrow(_anchors(length), "anchor long, region long, rid long, s long, starts long")
        .withColumns({"lo": F.min("region").over(by_anchor), "hi": F.max("region").over(by_anchor)})
        .withColumns({"copies": F.count("*").over(by_region), "k": F.row_number().over(by_region.orderBy("rid", "s"))})
        .where("copies > 1 OR lo <> hi")
        .selectExpr("anchor", "rid", "s", "starts", "copies", "k = 1 AND lo <> hi AS look")
    )
    whole = matched.where("copies > 1").selectExpr("rid", "s AS a", f"s + starts - 1 + {length} AS b")
    wanted = cut(matched.where("look").groupBy("rid").agg(F.collect_list(F.struct("anchor", "s", "starts")).alias("found")))
    texts = maybe(rows, "rid", bitset(wanted, "rid")).dropDuplicates(["rid"])
    looked = (
        texts.join(wanted, "rid")
        .select("rid", "text", "found")
        .mapInArrow(_cut_out(length), "anchor long, rid long, s long, starts long, bytes binary")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_sort_regions(length), "rid long, a long, b long")
    )
    return whole.unionByName(looked)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary; null where nothing went) of every row."""
    small_batches(docs.sparkSession)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.xxhash64(F.col(id_col), raw).alias("rid"), raw.alias("text"))
    # repeated strings of one text lie in runs: keep one span a run of touching regions
    after = Window.partitionBy("rid").orderBy("a", "b")
    top = F.max("b").over(after.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        repeated_spans(rows, length)
        .withColumn("new", F.when(top.isNull() | (F.col("a") > top), 1).otherwise(0))
        .withColumn("run", F.sum("new").over(after))
        .groupBy("rid", "run")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
    )
    spans = cut(runs.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    texts = maybe(rows, "rid", bitset(spans, "rid")).dropDuplicates(["rid"])
    lost = texts.join(spans, "rid").select("rid", "text", "spans").mapInArrow(_kept, "rid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), raw).alias("rid"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("all")
    )
    zero = F.lit(0).cast("long")
    return whole.join(lost, "rid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "all").alias("kept_sha256"),
        "kept",
    )
