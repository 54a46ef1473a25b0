"""A unigram vocabulary read from a public SentencePiece model file.

Texts are marked as the model does: a leading mark, spaces become marks. No
piece holds a mark after another character (checked on loading), so the best
segmentation of a text is that of its marked words one after another.

At an end, candidates are tried from the earliest start and a later one must
be strictly better; a character without a piece costs ten more than the worst
piece and becomes its UTF-8 bytes. These are the rules of the unigram model
of the tokenizers library.
"""

from __future__ import annotations

import re
from itertools import groupby

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_loaded: dict[str, "Lexicon"] = {}


def marked_words(text: str) -> list[str]:
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


class Lexicon:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_id: dict[int, int] = {}
        self.text_of: list[str | None] = []
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in p.lstrip(MARK):
                    raise ValueError("a piece crosses the start of a word")
                self.pieces[p] = (i, model.get_score(i))
            self.text_of.append(p)
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.longest = max(map(len, self.pieces))
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        # whether a character without a piece of its own is in no piece, and so parts every segmentation
        self.closed = all(map(self.single.issuperset, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - 10

    def plain(self, word: str) -> bool:
        """Whether every character of a word has a piece of its own."""
        return self.single.issuperset(word)

    def runs(self, word: str) -> list[tuple[str, bool]]:
        """Runs of a word with and without characters that have pieces, and whether they have."""
        return [("".join(run), known) for known, run in groupby(word, self.single.__contains__)]

    def raw(self, run: str) -> list[int]:
        """Ids of the bytes of a run without pieces."""
        return [self.byte_id[b] for b in run.encode("utf-8", "replace")]

    def exact(self, word: str) -> list[int]:
        """Ids of one marked word; characters without a piece become bytes."""
        n = len(word)
        best, back = [0.0] + [float("-inf")] * n, [(0, None)] * (n + 1)
        for at in range(n):
            if word[at] not in self.single:
                c = best[at] + self.unknown
                if c > best[at + 1]:
                    best[at + 1], back[at + 1] = c, (at, None)
            for end in range(at + 1, min(n, at + self.longest) + 1):
                hit = self.pieces.get(word[at:end])
                if hit is not None and best[at] + hit[1] > best[end]:
                    best[end], back[end] = best[at] + hit[1], (at, hit[0])
        ids: list[int] = []
        while n:
            at, i = back[n]
            ids.extend([i] if i is not None else [self.byte_id[b] for b in reversed(word[at:n].encode("utf-8", "replace"))])
            n = at
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text_of[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[1:].replace(MARK, " ")


def lexicon(path: str) -> Lexicon:
    if path not in _loaded:
        _loaded[path] = Lexicon(path)
    return _loaded[path]
