"""Spelling variants against a plain version, and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from postledger.llm import spelling
from postledger.llm.spelling import near_pairs, one_edit, spelling_forms, spelling_groups

LOW = {c: c + 32 for c in range(65, 91)}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _forms(n):
    near = {w: [v for v in n if _near(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def _words(docs):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            if i is not None:
                h = zlib.crc32(f"{i}:{w}".encode())
                if h % 199 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_a_plain_version(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abeé×ßÿ") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    pool = list(stems)
    for s in stems:
        for _ in range(6):
            i = rng.randrange(len(s))
            pool += [s[:i] + s[i + 1 :], s[:i] + rng.choice("abÀé") + s[i + 1 :], s[:i] + rng.choice("zé") + s[i:]]
    docs = [(i, " ".join(rng.choice(["1", ", ", "\n"]).join([w.upper() if rng.random() < 0.1 and w.isascii() else w] * rng.choice([1, 1, 2, 9])) for w in rng.choices(pool, k=300))) for i in range(60)]
    docs += [(None, "straßen " * 5 + "straßem"), (61, None), (62, ""), (61, "straßen " * 30), (61, "STRAßEN ÀLAMODE àlamode")]
    words = _words(docs)
    assert len(words) > 200
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    got = _got(spelling_groups(df))
    assert got == _forms(words)
    assert any(r[1] and r[2] != r[1] for r in got) or any(r[1] for r in got)


def test_chains_ties_and_long_words(spark):
    long = "ab" * 900
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 3125, "aacbbb": 3125, "mmmmmm": 5, "mmmmmx": 40, "mmmmmé": 40, "mmmmm": 40, long: 100, long + "c": 6, long[:-1] + "z": 20}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = _got(spelling_forms(df))
    assert got == _forms(n)
    by = {r[0]: r for r in got}
    assert by["aaaaaa"][1:3] == ("aaaaab", "aaabbb") and by["mmmmmm"][1] == "mmmmm" and by[long + "c"][1] == long


def test_a_crowded_block_is_dealt_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    rng = random.Random(8)
    n = {"".join(rng.choice("agm") for _ in range(6)): rng.randint(5, 400) for _ in range(300)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in near_pairs(df).collect()]
    words = sorted(n)
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if _near(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert spelling.pieces(df).count() > 30


def test_no_words(spark):
    schema = "doc_id long, text string"
    for rows in ([], [(1, None), (2, ""), (3, "short words only here")]):
        assert _got(spelling_groups(spark.createDataFrame(rows, schema))) == []


def test_one_edit():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice("abc") for _ in range(len(a) + rng.randint(0, 1)))
        code = lambda s: np.array([list(map(ord, s))])
        assert bool(one_edit(code(a), code(b))[0]) == _near(a, b)
