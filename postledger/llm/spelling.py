"""Spelling variants by blocked Gram matrices.

Words lie in blocks by length and by how many of their letters each of CLASSES
classes holds. One inserted letter adds one to the length and to one class; one
replaced letter moves one count at most from a class to another: near words lie
in the same block or in one of a fixed list of adjacent ones. A block is dealt
into pieces of bounded size, pairs of pieces of adjacent blocks meet in a join,
and a numpy product of their letter counts gives all squared distances at once:
1 for an insertion, 2 for a replacement. What passes is verified letter by
letter, in full.

Defined results: null texts have no words; in rows without an id nothing is
deleted; rows with repeated ids are rows of their own; other columns are
ignored; ties of a form go to the word that is smallest in code-point order; a
word of any length counts; without words there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.llm.common import cut, small_batches

CLASSES = 6
#: Words of a piece, at most about; fewer where words are long.
PIECE = 512
#: Pairs of pieces whose letters are counted at a time.
FEW = 32
RUN = "[A-Za-zÀ-ÿ]+"
LETTERS = [*map(ord, ascii_lowercase), *range(0xC0, 0x100)]
#: A form occurs so many times as often as its variant.
TIMES = 5


def _lowered(run: Column) -> Column:
    """A-Z lower-cased, no other letter: lower() does just that where no other capital stands."""
    return F.when(run.rlike("[À-Þ]"), F.translate(run, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(run))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = 199, letters: int = 6, least: int = 5) -> DataFrame:
    """word, n: lower-cased runs, those whose hash with the id is a multiple of `spoil` with one letter deleted."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= letters).select("id", _lowered(F.col("run")).alias("w"))
    h = F.crc32(F.concat("id", F.lit(":"), "w").cast("binary"))
    spoilt = words.withColumn("h", h).withColumn("at", F.expr("cast(h % length(w) AS int)"))
    word = F.when(F.col("h") % spoil == 0, F.expr("concat(substring(w, 1, at), substring(w, at + 2))")).otherwise(F.col("w"))
    return (
        spoilt.select(word.alias("word"))
        .where(F.length("word") >= letters)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )


def _class_letters(k: int) -> str:
    return "".join(chr(c) for c in LETTERS if c % CLASSES == k)


def _adjacent() -> Column:
    """Steps from a block to itself, to those that a replacement reaches (one of both directions), and to those that an insertion reaches."""
    unit = np.eye(CLASSES, dtype=int)
    steps = [np.zeros(CLASSES, int), *(unit[i] - unit[j] for i in range(CLASSES) for j in range(i)), *unit]
    return F.array(*(F.array(*(F.lit(int(x)) for x in (s.sum(), *s))) for s in steps))


def pieces(words: DataFrame) -> DataFrame:
    """block, piece, words: at most about PIECE words (word, n) of a block each."""
    block = F.array(F.length("word"), *(F.length("word") - F.length(F.translate("word", _class_letters(k), "")) for k in range(CLASSES)))
    at = words.select(block.alias("block"), "word", "n")
    share = at.groupBy("block").agg(F.ceil(F.count("*") * (len(LETTERS) + F.first("block")[0]) / F.lit(PIECE * len(LETTERS))).alias("parts"))
    return (
        at.join(share, "block")
        .select("block", F.expr("pmod(xxhash64(word), parts)").alias("piece"), F.struct("word", "n").alias("one"))
        .groupBy("block", "piece")
        .agg(F.collect_list("one").alias("words"))
    )


def _codes(side: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Of one side of a batch: row offsets, letter counts, where letters of each word begin, words, letters."""
    ends = np.diff(side.offsets.to_numpy())
    flat = side.flatten()
    words = flat.field("word").to_pylist()
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    column = np.zeros(0x100, np.int64)
    column[LETTERS] = np.arange(len(LETTERS))
    at = np.repeat(np.arange(len(words)), sizes) * len(LETTERS) + column[letters]
    counts = np.bincount(at, minlength=len(words) * len(LETTERS)).reshape(len(words), len(LETTERS))
    exact = np.float32 if sizes.max(initial=0) < 2048 else np.float64  # squares of counts and their sums stay whole
    return np.r_[0, np.cumsum(ends)], counts.astype(exact), np.r_[0, np.cumsum(sizes)], words, letters


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row i of b is row i of a with one letter replaced, or with one inserted where rows of b are longer."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    before = np.logical_and.accumulate(a == b[:, :size], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= size


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(s, FEW) for whole in batches for s in range(0, whole.num_rows, FEW)):
        sides = [b.column(k) for k in (0, 1)]
        (ra, ca, la, wa, ta), (rb, cb, lb, wb, tb) = map(_codes, sides)
        na, nb = (s.flatten().field("n").to_numpy() for s in sides)
        qa, qb = (ca * ca).sum(axis=1), (cb * cb).sum(axis=1)
        twins = b.column(2).to_pylist()
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for k in range(b.num_rows):
            i0, i1, j0, j1 = ra[k], ra[k + 1], rb[k], rb[k + 1]
            size, size_b = la[i0 + 1] - la[i0], lb[j0 + 1] - lb[j0]
            far = qa[i0:i1, None] + qb[None, j0:j1] - 2 * (ca[i0:i1] @ cb[j0:j1].T)
            i, j = np.nonzero(far == (2 if size == size_b else 1))
            if twins[k]:
                i, j = i[i < j], j[i < j]
            x, y = ta[la[i0] : la[i1]].reshape(-1, size), tb[lb[j0] : lb[j1]].reshape(-1, size_b)
            step = max(1, 2_000_000 // int(size))
            for s in range(0, len(i), step):
                p, q = i[s : s + step], j[s : s + step]
                ok = one_edit(x[p], y[q])
                left.append(p[ok] + i0)
                right.append(q[ok] + j0)
        if left:
            p, q = np.concatenate(left), np.concatenate(right)
            if len(p):
                yield pa.RecordBatch.from_pydict({"a": pa.array(wa).take(pa.array(p)), "a_n": pa.array(na[p]), "b": pa.array(wb).take(pa.array(q)), "b_n": pa.array(nb[q])})


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every pair of words one edit apart, once."""
    small_batches(words.sparkSession)
    held = cut(pieces(words))
    asks = held.select(F.col("piece").alias("from"), F.col("words").alias("a"), F.posexplode(_adjacent()).alias("step", "off"), "block").select(
        "from", "a", "step", F.zip_with("block", "off", lambda x, y: x + y).alias("block")
    )
    met = asks.join(held, "block").where("step > 0 OR from <= piece")
    return met.select("a", F.col("words").alias("b"), F.expr("step = 0 AND from = piece").alias("twin")).mapInArrow(_near, "a string, a_n long, b string, b_n long")


def spelling_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of a written table of words."""
    pairs = cut(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    # the least of (-n, word) is the most frequent, and of those the first in code-point order
    known = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("b"))).alias("best"))
    chosen = F.col("best").isNotNull() & (-F.col("best.m") >= times * F.col("n"))
    formed = cut(
        words.join(known, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.b")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n")
        )
    )
    # a form is `times` times as frequent, so chains are short: each round doubles what is followed
    ends = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = cut(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ends.where("moved").isEmpty():
            break
        ends = ends.select("word", "root")
    return formed.join(ends.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of docs."""
    return spelling_forms(cut(word_counts(docs, id_col, text_col)))
