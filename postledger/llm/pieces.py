"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The distinct marked words of a batch are sorted, which is a depth-first walk
of their trie: a word keeps the forward scores of the prefix it shares with
the word before it and only extends them; an automaton names the pieces that
end at the places behind that prefix. Ids of words are remembered by a
worker, in two generations of bounded size; texts are the ids of their words
one after another. A character without a piece parts its word, whose runs are
words to the walk. Decoding joins pieces, reads byte pieces as UTF-8 and
turns marks back into spaces, so it returns the text itself unless the text
holds the mark character or invalid UTF-8.

Defined results: null encodes to null and empty to no ids, and both decode to
themselves; repeated rows are rows of their own; encode and decode keep all
other columns, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.llm.common import small_batches
from postledger.llm.lexicon import Lexicon, lexicon, marked_words

_REMEMBER = 300_000
_coders: dict[str, "_Coder"] = {}


class _Coder:
    def __init__(self, lex: Lexicon):
        import ahocorasick

        self.lex = lex
        self.automaton = ahocorasick.Automaton()
        for p, (i, score) in lex.pieces.items():
            self.automaton.add_word(p, (len(p), score, i))
        self.automaton.make_automaton()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, words: list[str]) -> dict[str, bytes]:
        lex, out, before = self.lex, {}, ""
        pieces, low = self.automaton.iter, float("-inf")
        best, back, ids = [0.0], [0], [0]
        parted = {w: lex.runs(w) for w in words if not lex.plain(w)} if lex.closed else {}
        todo = {run for runs in parted.values() for run, known in runs if known}.union(w for w in words if w not in parted)
        for w in sorted(todo):
            if not lex.plain(w):
                out[w] = np.array(lex.exact(w), "<u4").tobytes()
                continue
            n, shared = len(w), 0
            for a, b in zip(w, before, strict=False):
                if a != b:
                    break
                shared += 1
            before = w
            del best[shared + 1 :], back[shared + 1 :], ids[shared + 1 :]
            best += [low] * (n - shared)
            back += [0] * (n - shared)
            ids += [0] * (n - shared)
            # longer pieces come first at an end and win ties
            for last, (size, score, i) in pieces(w, max(0, shared + 1 - lex.longest)):
                if last >= shared:
                    c = best[last + 1 - size] + score
                    if c > best[last + 1]:
                        best[last + 1], back[last + 1], ids[last + 1] = c, last + 1 - size, i
            found = []
            while n:
                found.append(ids[n])
                n = back[n]
            out[w] = np.array(found[::-1], "<u4").tobytes()
        for w, runs in parted.items():
            out[w] = b"".join(out[run] if known else np.array(lex.raw(run), "<u4").tobytes() for run, known in runs)
        return out

    def texts(self, texts: list[str | None]) -> list[bytes | None]:
        split = [marked_words(t) if t else [] for t in texts]
        if len(self.young) > _REMEMBER:
            self.old, self.young = self.young, {}
        need = set().union(*split).difference(self.young)
        fresh = {w: self.old[w] for w in need.intersection(self.old)}
        fresh.update(self.words([w for w in need if w not in fresh]))
        known = self.young
        known.update(fresh)
        out = [b"".join(map(known.__getitem__, s)) if t is not None else None for s, t in zip(split, texts, strict=True)]
        for w in fresh:
            if len(w) > 48:
                del known[w]
        return out


def _coder(path: str) -> _Coder:
    if path not in _coders:
        _coders[path] = _Coder(lexicon(path))
    return _coders[path]


def encode(model: str, text: Column) -> Column:
    """Array of ids of a text column."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<i4") if x is not None else None for x in _coder(model).texts(texts.tolist())])

    return run(text)


def decode(model: str, ids: Column) -> Column:
    """Text of a column of id arrays."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        lex = lexicon(model)
        return pd.Series([lex.decode(list(r)) if r is not None else None for r in rows])

    return run(ids)


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lex = _coder(path), lexicon(path)
        for b in batches:
            texts = [t.decode("utf-8", "replace") if t is not None else None for t in b.column(1).to_pylist()]
            raw = coder.texts(texts)
            back = [x is None or lex.decode(np.frombuffer(x, "<u4").tolist()) == t for x, t in zip(raw, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 if x is not None else 0 for x in raw], pa.int64()),
                    pa.array([zlib.crc32(x or b"") for x in raw], pa.int64()),
                    pa.array(back, pa.bool_()),
                ],
                ["doc_id", "n_ids", "ids_crc32", "decoded"],
            )

    return run


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded: whether decoding the ids gave the text again."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_digest(model), "doc_id long, n_ids long, ids_crc32 long, decoded boolean")
