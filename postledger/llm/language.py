"""Language identification by hierarchical discrimination.

A text is the mean over its letter runs of 1 to 4 letters within marked words,
hashed to buckets. Linear support vector machines first decide between
language families, one against one; then those of the family found decide
between its languages, one against one. Machines are trained in numpy by dual
coordinate descent on a bounded sample: of the `kinds` languages with most rows
at most `each` texts (the lowest hashes of their ids), of all at most `most`,
every language's first texts before any language's second. Every sampled text is learned whole and,
so that short texts are met too, by one short stretch. Scoring is one pass
without a shuffle, in stretches of STRETCH letters, so that texts of any length
take bounded memory.

FAMILIES names what families are known; a language that it lacks is a family of
its own.

Defined results: a text that is null or has no letter is `und` with score 0,
and so is every text where nothing could be learned; rows with null lang or
null id are not learned from, of several rows of one id the smallest (lang,
text) is; rows with repeated ids are predicted as rows of their own; held_out
of a null id is null; ties of votes go to the larger sum of margins, then to
the language first by name; other columns are never read.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postledger.llm.common import mix, small_batches
from postledger.llm.quality import held_out

BUCKETS = 1 << 15
ORDERS = 4
STRETCH = 1 << 18
#: Languages learned (those with most rows), and texts learned from, of a language and of all, at most.
KINDS, EACH, MOST = 150, 400, 4000
#: Letters of the short stretch of a sampled text.
SHORT = 60
COST, PASSES = 10.0, 12
#: Of the logistic curve that makes a margin a score.
SLOPE = 4.0
UNKNOWN = "und"

#: Families by language code (ISO 639-1).
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "hellenic": "el",
}

_folded: np.ndarray | None = None


def folded_letters() -> np.ndarray:
    """By code point: its lower-case letter, 0 for what is no letter."""
    global _folded
    if _folded is None:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded = table
    return _folded


def letters(text: bytes) -> np.ndarray:
    """Lower-case letters of a UTF-8 text, words parted and framed by one 0; empty if there is none."""
    code = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = folded_letters()[code]
    seen = at != 0
    if not seen.any():
        return np.zeros(0, np.uint32)
    keep = seen.copy()
    keep[1:] |= seen[:-1]  # the first gap after a word stays
    out = at[keep]
    return np.concatenate([np.zeros(1, np.uint32), out] if not out[-1] else [np.zeros(1, np.uint32), out, np.zeros(1, np.uint32)])


def letter_counts(at: np.ndarray) -> np.ndarray:
    """How often each bucket occurs among the runs of letters, a stretch at a time."""
    total = np.zeros(BUCKETS, np.int64)
    for s in range(0, len(at), STRETCH):
        code = at[s : s + STRETCH + ORDERS - 1].astype(np.uint64)
        gap, inner = code == 0, np.zeros(len(code), bool)
        h, found = np.zeros(len(code), np.uint64), []
        for n in range(1, min(ORDERS, len(code)) + 1):
            m = len(code) - n + 1
            h = h[:m] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(1)
            if n > 2:  # a gap may begin or end a run, not stand within
                inner = inner[:m] | gap[n - 2 : n - 2 + m]
            whole = ~inner[:m] if n > 1 else ~gap
            whole[STRETCH:] = False  # runs that begin there belong to the next stretch
            found.append(h[whole])
        total += np.bincount((mix(np.concatenate(found)) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return total


def unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.float32(np.linalg.norm(x))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and counts of each text and of a short stretch of it, compressed: the driver gathers them."""
    for b in batches:
        kept, packed = [], []
        for row, t in enumerate(b.column(2).to_pylist()):
            at = letters(t or b"")
            if not len(at):
                continue
            begin = zlib.crc32(t) % max(1, len(at) - SHORT)
            for part in (at, at[begin : begin + SHORT]):
                c = letter_counts(part)
                u = np.flatnonzero(c)
                if len(u):
                    kept.append(row)
                    packed.append(zlib.compress(u.astype("<u2").tobytes() + c[u].astype("<u4").tobytes(), 1))
        if kept:
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(packed, pa.binary())], ["at", "lang", "packed"])


def machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = COST, passes: int = PASSES) -> np.ndarray:
    """Weights of a linear support vector machine without bias over unit rows, by dual coordinate descent."""
    rng = np.random.default_rng(5)
    w, alpha = np.zeros(BUCKETS), np.zeros(len(rows))
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            slope = signs[i] * (w[at] @ x) - 1
            new = min(max(alpha[i] - slope, 0.0), cost)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * signs[i] * x
                alpha[i] = new
    return w


@dataclass
class OneOnOne:
    """Machines between every two of some names."""

    names: list[str]
    weights: np.ndarray  # BUCKETS by pairs, positive for the first of a pair

    @classmethod
    def fit(cls, names: list[str], rows: list[tuple[np.ndarray, np.ndarray]], kinds: np.ndarray) -> OneOnOne:
        made = []
        for a, b in combinations(names, 2):
            at = np.flatnonzero((kinds == a) | (kinds == b))
            made.append(machine([rows[i] for i in at], np.where(kinds[at] == a, 1.0, -1.0)))
        return cls(names, np.stack(made, axis=1).astype(np.float32) if made else np.zeros((BUCKETS, 0), np.float32))

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        """The name with most votes and how sure its nearest rival leaves it, 0 to 1."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        votes, sums, least = (np.zeros(len(self.names)) for _ in range(3))
        least += np.inf
        for (a, b), m in zip(combinations(range(len(self.names)), 2), (x @ self.weights).tolist()):
            votes[a if m >= 0 else b] += 1
            for k, v in ((a, m), (b, -m)):
                sums[k] += v
                least[k] = min(least[k], v)
        k = max(range(len(self.names)), key=lambda i: (votes[i], sums[i], -i))
        return self.names[k], float(1 / (1 + np.exp(-SLOPE * least[k])))


@dataclass
class Languages:
    families: OneOnOne
    within: dict[str, OneOnOne]

    def predict(self, text: bytes) -> tuple[str, float]:
        at = letters(text)
        if not len(at) or not self.families.names:
            return UNKNOWN, 0.0
        x = unit(letter_counts(at))
        family, sure = self.families.decide(x)
        lang, surer = self.within[family].decide(x)
        return lang, sure * surer


def family_of(lang: str, families: dict[str, str]) -> str:
    return next((f for f, members in families.items() if lang in members.split()), lang)


def learned_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, kinds: int, each: int, most: int) -> DataFrame:
    """lang, text (binary) and at, a hash to order by: the bounded sample."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id"))
    )
    # thrice as many as needed by a share of the hashes, so that no language is sorted whole
    share = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(kinds)
    near = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("rows") < F.lit(3 * each << 30)
    few = known.join(F.broadcast(share), "lang").where(near).groupBy("id").agg(F.min(F.struct("lang", "text")).alias("d"))
    at = few.select(F.xxhash64("id").alias("at"), "id", "d.lang", "d.text")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at", "id"))
    return at.withColumn("nth", nth).where(F.col("nth") <= each).orderBy("nth", "at", "id").limit(most).select("at", "lang", F.col("text").cast("binary").alias("text"))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    families: dict[str, str] | None = None,
    kinds: int = KINDS,
    each: int = EACH,
    most: int = MOST,
) -> Languages:
    small_batches(docs.sparkSession)
    families = FAMILIES if families is None else families
    rows = learned_rows(docs, id_col, text_col, lang_col, kinds, each, most)
    found = rows.mapInArrow(_sampled, "at long, lang string, packed binary").toArrow()
    found = found.take(pa.array(np.lexsort((found.column("packed").to_pylist(), found.column("at").to_numpy()))) if found.num_rows else pa.array([], pa.int64()))
    vectors, langs = [], np.array(found.column("lang").to_pylist(), object)
    for packed in found.column("packed"):
        raw = zlib.decompress(packed.as_buffer())
        n = len(raw) // 6
        x = np.sqrt(np.frombuffer(raw, "<u4", n, 2 * n).astype(np.float64))
        vectors.append((np.frombuffer(raw, "<u2", n).astype(np.int64), x / np.linalg.norm(x)))
    home = np.array([family_of(x, families) for x in langs], object)
    within = {}
    for f in sorted(set(home)):
        at = np.flatnonzero(home == f)
        within[f] = OneOnOne.fit(sorted(set(langs[at])), [vectors[i] for i in at], langs[at])
    return Languages(OneOnOne.fit(sorted(within), vectors, home), within)


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t or b"") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
