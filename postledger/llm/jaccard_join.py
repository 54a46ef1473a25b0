"""N-gram Jaccard join over whole texts, by parity sketches.

Every document becomes the set of its distinct n-word shingles (64-bit
hashes). Two documents link when 100 * |A & B| >= percent * |A | B|.

Method. Each shingle flips one bit of a wide, sparse sketch that is laid out
in blocks; a block's pattern is kept as the exclusive or of the codes of its
set bits. An element in only one of two sets changes one bit, so the
sketches differ in at most |A ^ B| blocks: their Hamming distance bounds the
symmetric difference from below. For linked sets of n <= m shingles that
difference is at most (n + m) / 7 at 75 percent, so by the pigeonhole
principle two linked documents agree in a block once each of them offers one
block more than that, taken in an order fixed for all documents. Blocks with
many shingles come first in that order (they are the selective ones), single
bits of shingles that a sample finds in many documents late, blocks without
bits last; the sample decides the order and so the cost, never the result. The number of blocks belongs to a size band: a document
offers blocks in its own band, and in the band below if a smaller partner may
lie there, so the smaller partner's band always decides.

Documents that offer the same block are candidates. Each is compared first
with the smallest member of most of its buckets, then, if that leaves it apart
from a bucket's smallest member, with a few drawn members; links are joined to
components, and only members that are still apart are compared with all
others of the bucket, behind bounds on size and
on parity sketches (512 bits within the join, about two bits a shingle after
it). Every pair that could link two components is therefore verified, and no
group of copies is expanded into all its pairs. Filters of fixed size keep
rows and texts that no candidate needs out of the shuffles.

Defined results: a null or blank text has no shingles and links with nothing
(component_id is its own id); a text with fewer than n words is one shingle;
repeated rows are rows of their own with equal results; a row with a null id
is no document that others link with, but gets the component of documents with
its very text, else a null one; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postledger.llm.common import bitset, components, cut, maybe, mix, small_batches

WORDS = 5
PERCENT = 75
#: Longs of the parity sketch that prunes candidate pairs within the join.
LONGS = 8
#: Members of its buckets that a class which is still apart is compared with before all of them.
DRAWS = 6
#: The sample that finds common shingles: this many documents, about, and of large tables one in SHARE, so that a
#: shingle counts as common from the same number of documents at every size; how many are kept at most.
SAMPLE, SHARE, COMMON = 4096, 12, 1 << 18
_ONE = np.uint64(1)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; words are runs of non-space ASCII, A-Z lowered."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    n = len(w) - k + 1
    a = np.full(n, k, np.uint64)
    for i in range(k):
        a = mix(a ^ h[i : i + n])
    return np.unique(a)


def class_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def difference_bound(n: int, m: int, percent: int = PERCENT) -> int:
    """Largest |A ^ B| of linked sets of n and m elements."""
    return (n + m) * (100 - percent) // (100 + percent)


def sampled(rows: int) -> int:
    """One document in so many is read for common shingles; a fixed number of documents would let buckets grow with the table."""
    return min(max(1, rows // SAMPLE), SHARE)


def largest_partner(n: int, percent: int = PERCENT) -> int:
    return n * 100 // percent


def parity_sketch(s: np.ndarray) -> bytes:
    """About two bits a shingle, a power of two and at least 64 * LONGS."""
    size = max(64 * LONGS, 2 << len(s).bit_length())
    bits = np.bincount((s >> np.uint64(30)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of `size` bytes of the same set."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def hamming(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    x, y = (fold(np.frombuffer(v, np.uint8), size) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def _blocks(band: int) -> int:
    return int(2 ** (band + 1) / (1.0 if band == 4 else 1.8)) + 1


def _offer(s: np.ndarray, band: int, need: int, late: np.ndarray) -> np.ndarray:
    """The first `need` blocks of s in the order that holds in this band, as 64-bit keys; late: which shingles are common."""
    salt = np.uint64(band + 1)
    code = mix(s ^ (salt << np.uint64(58)))  # of the bit that a shingle flips in its block
    if band < 4:  # few shingles: a block for each
        return code[np.lexsort((code, late))[:need]]
    blocks = _blocks(band)
    block = s % np.uint64(blocks)
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    count = np.diff(np.r_[first, len(s)])
    block = block[first]
    # the codes of a block's set bits, joined by exclusive or, stand for its pattern
    key = mix(np.bitwise_xor.reduceat(code[order], first) ^ (block << np.uint64(6)))
    rank = ((np.uint64(64) - np.minimum(count, 63).astype(np.uint64)) << np.uint64(57)) | (key >> np.uint64(7))
    rank[(count == 1) & late[order][first]] |= _ONE << np.uint64(63)
    if need < len(key):
        return key[np.argpartition(rank, need - 1)[:need]]
    empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block)[: need - len(key)]
    return np.r_[key, mix(mix((empty << np.uint64(6)) | salt))]


def block_keys(s: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """common: sorted hashes of common shingles, at least one."""
    n = len(s)
    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    band = n.bit_length() - 1
    keys = [_offer(s, band, difference_bound(n, largest_partner(n, percent), percent) + 1, late)]
    low = 1 << band
    if -(-n * percent // 100) < low:  # a partner may lie in the band below
        keys.append(_offer(s, band - 1, difference_bound(n, low - 1, percent) + 1, late))
    return np.concatenate(keys).astype(np.int64)


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, cls, whole, sk = [], [], [], np.zeros((b.num_rows, LONGS), np.int64)
            for i, t in enumerate(b.column(1).to_pylist()):
                s = shingle_set(t or b"", words)
                ns.append(len(s))
                cls.append(class_id(s) if len(s) else None)
                whole.append(parity_sketch(s) if len(s) else None)
                if len(s):
                    sk[i] = fold(np.frombuffer(whole[-1], np.uint8), 8 * LONGS).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ns, pa.int64()), pa.array(cls, pa.int64()), pa.array(whole, pa.binary()), *(pa.array(sk[:, k]) for k in range(LONGS))],
                ["doc_id", "n", "cls", "sketch", *(f"s{k}" for k in range(LONGS))],
            )

    return run


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t or b"", words).astype(np.int64))], ["h"])

    return run


def _keys(words: int, percent: int, shingles: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.sort(shingles) if len(shingles) else np.zeros(1, np.uint64)
        seen: set[int] = set()  # of this task: copies offer their blocks once
        for b in batches:
            keys, ids = [], []
            for t in b.column(0).to_pylist():
                s = shingle_set(t or b"", words)
                if not len(s) or (c := class_id(s)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                keys.append(block_keys(s, common, percent))
                ids.append(np.full(len(keys[-1]), c, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "cls"])

    return run


def _linked(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}  # a pivot stands in many pairs

        def get(c: int, t: bytes) -> np.ndarray | None:
            if c not in kept:
                s = shingle_set(t or b"", words)
                if not len(s) or class_id(s) != c:  # another row with the same id
                    return None
                if len(kept) > 64:
                    kept.clear()
                kept[c] = s
            return kept[c]

        for b in batches:
            out = []
            for ra, rb, ca, cb, ta, tb in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                x, y = get(ca, ta), get(cb, tb)
                if x is None or y is None:
                    continue
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    out.append((ra, rb))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _near(a: str, b: str, percent: int) -> str:
    """SQL bound that every linked pair meets."""
    n, m = f"{a}.n", f"{b}.n"
    bits = " + ".join(f"bit_count({a}.s{k} ^ {b}.s{k})" for k in range(LONGS))
    return (
        f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) AND "
        f"{bits} <= ({n} + {m}) * {100 - percent} div {100 + percent}"
    )


def _within(percent: int):
    """Keeps pairs whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (b.column(k).to_pylist() for k in range(4, 8))
            keep = [hamming(p, q) <= difference_bound(i, j, percent) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:4]], ["ca", "cb", "ra", "rb"])

    return run


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows, nameless = every.where("doc_id IS NOT NULL"), every.where("doc_id IS NULL")
    sketch = [f"s{k}" for k in range(LONGS)]
    kinds = "doc_id long, n long, cls long, sketch binary, " + ", ".join(f"{s} long" for s in sketch)
    feats = cut(rows.mapInArrow(_features(words), kinds))
    classes = cut(
        feats.where("cls IS NOT NULL")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), *(F.max(s).alias(s) for s in sketch))
    )
    slim = classes.select("cls", "rep", "n", *sketch)

    share = sampled(feats.count())
    common = (
        rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
        .select("text")
        .mapInArrow(_shingles(words), "h long")
        .groupBy("h")
        .count()
        .where("count >= 4")
        .orderBy(F.desc("count"), "h")
        .limit(COMMON)
        .toPandas()["h"]
        .to_numpy()
        .astype(np.uint64)
    )

    by_key = Window.partitionBy("key")
    live = cut(
        rows.select("text")
        .mapInArrow(_keys(words, percent, common), "key long, cls long")
        .withColumns({"lo": F.min("cls").over(by_key), "hi": F.max("cls").over(by_key)})
        .where("lo <> hi")
        .select("key", "cls", "lo")
    )
    pairs = cut(live.where("cls <> lo").groupBy("cls", "lo").count())

    def links(pairs: DataFrame) -> DataFrame:
        """Verified links (ids of representatives) of pairs ca, cb."""
        ends = ["ca", "cb", "a.rep AS ra", "b.rep AS rb"]
        near = (
            pairs.join(slim.alias("a"), F.expr("ca = a.cls"))
            .join(slim.alias("b"), F.expr("cb = b.cls"))
            .where(_near("a", "b", percent))
            .select("ca", "cb")
            .join(classes.alias("a"), F.expr("ca = a.cls"))
            .join(classes.alias("b"), F.expr("cb = b.cls"))
            .selectExpr(*ends, "a.n AS n", "b.n AS m", "a.sketch AS x", "b.sketch AS y")
        )
        near = cut(near.mapInArrow(_within(percent), "ca long, cb long, ra long, rb long"))
        bits = bitset(near.select(F.explode(F.array("ra", "rb")).alias("doc_id")), "doc_id")
        texts = maybe(rows, "doc_id", bits)
        ta, tb = texts.selectExpr("doc_id AS ra", "text AS ta"), texts.selectExpr("doc_id AS rb", "text AS tb")
        both = near.join(ta, "ra").join(tb, "rb").select("ra", "rb", "ca", "cb", "ta", "tb")
        return cut(both.mapInArrow(_linked(words, percent), "u long, v long"))

    def labelled(known: DataFrame) -> DataFrame:
        return cut(classes.join(known, classes.rep == known.node, "left").select("cls", F.coalesce("component", "rep").alias("label")))

    def apart(label: DataFrame) -> tuple[DataFrame, DataFrame]:
        """key, cls of members that are not in the component of their bucket's smallest member; all rows of those buckets."""
        away = cut(
            pairs.join(label, "cls")
            .join(label.selectExpr("cls AS lo", "label AS lo_label"), "lo")
            .where("label <> lo_label")
            .select("cls", "lo")
        )
        bits = bitset(away.select(F.xxhash64("cls", "lo").alias("pair")), "pair")
        with_pair = live.select("key", "cls", "lo", F.xxhash64("cls", "lo").alias("pair"))
        minor = cut(maybe(with_pair, "pair", bits).join(away, ["cls", "lo"], "left_semi").select("key", "cls"))
        return minor, maybe(live.select("key", "cls"), "key", bitset(minor, "key"))

    star = pairs.groupBy("cls").agg(F.max_by("lo", F.struct("count", "lo")).alias("lo")).select(F.col("lo").alias("ca"), F.col("cls").alias("cb"))
    found = links(star)
    known = components(found)

    # a few other members of their buckets for those that are still apart, one drawn in each bucket
    label = labelled(known)
    minor, buckets = apart(label)
    drawn = buckets.groupBy("key").agg(F.min_by("cls", F.xxhash64("cls", "key")).alias("other"))
    draw = (
        minor.join(drawn, "key")
        .join(label, "cls")
        .join(label.selectExpr("cls AS other", "label AS other_label"), "other")
        .where("label <> other_label")
        .select("cls", "other")
        .distinct()
        .withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.xxhash64("cls", "other"))))
        .where(f"r <= {DRAWS}")
        .select(F.least("cls", "other").alias("ca"), F.greatest("cls", "other").alias("cb"))
        .distinct()
    )
    draw = cut(draw)
    tested = star.unionByName(draw)
    if not draw.isEmpty():
        found = found.unionByName(links(draw))
        known = components(found)
        label = labelled(known)
        minor, buckets = apart(label)

    # and every pair of a bucket that could still join two components
    member = slim.join(label, "cls")
    rest = cut(
        minor.join(member, "cls").alias("a")
        .join(buckets.join(member, "cls").alias("b"), F.expr(f"a.key = b.key AND a.label <> b.label AND {_near('a', 'b', percent)}"))
        .select(F.least("a.cls", "b.cls").alias("ca"), F.greatest("a.cls", "b.cls").alias("cb"))
        .distinct()
        .join(tested, ["ca", "cb"], "left_anti")
    )
    if not rest.isEmpty():
        known = components(found.unionByName(links(rest)))
    in_class = classes.join(known, classes.rep == known.node).select("cls", "component")
    whole = classes.select("cls", "rep").join(in_class, "cls", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    told = feats.select("doc_id", "n", "cls").unionByName(nameless.mapInArrow(_features(words), kinds).select("doc_id", "n", "cls"))
    return told.join(whole, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
