"""Quality classifier over hashed word and character n-gram vectors.

A document is the average of learned vectors: one for each of its words, one
for each run of 3 or 4 bytes within a marked word, one that every document
has. A softmax layer gives the class. Vectors and layer are trained together
by stochastic gradient descent in numpy, on at most `sample` labelled rows
(the lowest hashes of their ids); words and n-grams share hashed buckets, so
the model has a fixed size. After training, the layer is folded into the
vectors: a bucket is worth one number and a score is the sigmoid of an
average, so every whole text is scored in one pass without a shuffle.

Defined results: null texts count as empty, and empty texts are scored by the
feature that every document has; labels that are null or whose id is null are
not learned from, and of several labels of one id the smallest holds; rows
with repeated ids are scored as rows of their own; without any label every
score is 0.5; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from postledger.llm.common import mix, small_batches

BUCKETS = 1 << 17
#: Labelled rows that are learned from, at most.
SAMPLE = 3000
DIMENSIONS, EPOCHS, RATE = 8, 12, 1.0
THRESHOLD = 0.3
_SPACE = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


def features(text: bytes) -> np.ndarray:
    """Bucket of every feature of a text."""
    words = text.split()
    out = [np.zeros(1, np.int64)]
    if words:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        out.append((h % np.uint64(BUCKETS)).astype(np.int64))
        b = np.frombuffer(b" %b " % text.translate(_SPACE), np.uint8)
        space = b == 32
        for n in (3, 4):
            m = len(b) - n + 1
            if m > 0:
                inner = np.zeros(m, bool)
                for k in range(1, n - 1):
                    inner |= space[k : k + m]
                at = np.flatnonzero(~inner)
                g = np.full(len(at), n, np.uint64)
                for k in range(n):
                    g = (g << np.uint64(8)) | b[at + k]
                out.append((mix(g) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each text (as steps from the one before) and how often they occur, compressed: the driver gathers them."""
    for b in batches:
        sizes, packed = [], []
        for t in b.column(2).to_pylist():
            u, c = np.unique(features(t or b""), return_counts=True)
            sizes.append(len(u))
            packed.append(zlib.compress(np.diff(u, prepend=0).astype("<u4").tobytes() + c.astype("<u4").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["at", "label", "size", "packed"])


def train(labels: np.ndarray, ends: np.ndarray, buckets: np.ndarray, shares: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Worth of each bucket (logit of label 1); row i has the buckets and shares from ends[i] to ends[i + 1]."""
    rng = np.random.default_rng(11)
    vec = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    out = np.zeros((DIMENSIONS, 2))
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            ids, w = buckets[ends[i] : ends[i + 1]], shares[ends[i] : ends[i + 1]].astype(np.float64)
            lr = rate * (1 - done / steps)
            done += 1
            h = w @ vec[ids]
            z = h @ out
            g = np.exp(z - z.max())
            g /= g.sum()
            g[labels[i]] -= 1
            back = out @ g
            out -= lr * np.outer(h, g)
            vec[ids] -= lr * w[:, None] * back
    return vec @ (out[:, 1] - out[:, 0])


def held_out(doc_id, folds: int = 5):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    small_batches(docs.sparkSession)
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    # at most `sample` rows go to every task, and one text of an id (its smallest) to the driver
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = (
        rows.join(F.broadcast(known), "id")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.min("text").alias("text"))
        .select(F.xxhash64("id").alias("at"), "label", F.col("text").cast("binary").alias("text"))
        .mapInArrow(_vectors, "at long, label int, size long, packed binary")
        .toArrow()
    )
    order = np.argsort(found.column("at").to_numpy(), kind="stable")  # the order of rows does not matter
    kinds = found.column("label").to_numpy()[order]
    ends = np.cumsum(np.r_[0, found.column("size").to_numpy()[order]])
    buckets, shares = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)
    for k, i in enumerate(order.tolist()):
        n = ends[k + 1] - ends[k]
        raw = np.frombuffer(zlib.decompress(found.column("packed")[i].as_buffer()), "<u4")
        buckets[ends[k] : ends[k + 1]] = np.cumsum(raw[:n])
        shares[ends[k] : ends[k + 1]] = raw[n:] / raw[n:].sum()
    del found
    return train(kinds, ends, buckets, shares)


def scored(docs: DataFrame, worth: np.ndarray, name: str = "score", text_col: str = "text") -> DataFrame:
    """Rows of docs with all their columns, and their score as a new column."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{name} is a column of docs; give another name")
    small_batches(docs.sparkSession)
    small = worth.astype(np.float32)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0)
            texts = row.field(at).cast(pa.binary()).to_pylist()
            z = np.array([float(small[features(t or b"")].mean(dtype=np.float64)) for t in texts])
            yield pa.RecordBatch.from_arrays([row, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    made = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return made.select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("score").alias(name))


def score(docs: DataFrame, worth: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    return scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), worth).select("doc_id", "score")
