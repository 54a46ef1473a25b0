"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates every vocabulary match in a marked word;
the dynamic programme keeps two numbers for each place: the best score and
how many pieces reach it. At one end the automaton gives longer matches
first, and a later candidate must be strictly better, which is the tokenizer's
rule for ties. Words repeat, so a worker remembers their counts, in two
generations of bounded size.

Defined results: a null or empty text has 0 tokens; repeated rows are rows of
their own; ids of any kind, null too, pass through; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postledger.llm.common import small_batches
from postledger.llm.lexicon import Lexicon, lexicon, marked_words

_REMEMBER = 400_000
_counters: dict[str, "_Counter"] = {}


class _Counter:
    def __init__(self, lex: Lexicon):
        import ahocorasick

        self.lex = lex
        self.automaton = ahocorasick.Automaton()
        for p, (_, score) in lex.pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, w: str) -> int:
        if not self.lex.plain(w):
            if not self.lex.closed:
                return len(self.lex.exact(w))
            return sum(self.word(run) if known else len(run.encode("utf-8", "replace")) for run, known in self.lex.runs(w))
        low = float("-inf")
        best, pieces = [0.0] + [low] * len(w), [0] * (len(w) + 1)
        for last, (size, score) in self.automaton.iter(w):
            end = last + 1
            c = best[end - size] + score
            if c > best[end]:
                best[end] = c
                pieces[end] = pieces[end - size] + 1
        return pieces[-1]

    def text(self, text: str) -> tuple[int, int]:
        words = marked_words(text)
        young, old, total = self.young, self.old, 0
        for w in words:
            n = young.get(w)
            if n is None:
                n = old.get(w)
                if n is None:
                    n = self.word(w)
                if len(w) <= 48:
                    young[w] = n
                    if len(young) > _REMEMBER:
                        self.old, self.young = old, young = young, {}
            total += n
        return len(words), total


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = _Counter(lexicon(path))
        counter = _counters[path]
        for b in batches:
            found = [counter.text(t.decode("utf-8", "replace") if t else "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], ["doc_id", "n_words", "n_tokens"]
            )

    return run


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words (marked words), n_tokens."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_count(model), "doc_id long, n_words long, n_tokens long")
