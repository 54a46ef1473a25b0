"""Line dedup and each pipeline stage on its own input, against plain versions."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from postledger.llm import line_dedup, quality
from postledger.llm.common import cut
from postledger.llm.queries import tokenizer_path
from tests.llm.brute import jaccard_groups, lines_left

WORDS = [a + b + c for a in ("an", "ber", "cor", "du", "el", "fi") for b in ("ta", "re", "mo", "li") for c in ("s", "n", "ka", "")]


def _line(rng, n):
    return " ".join(rng.choice(WORDS, n))


def _near(rng, line, n):
    words = line.split(" ")
    for k in rng.choice(len(words), n, replace=False):
        words[k] = words[k][:-1] + "x"
    return " ".join(words)


def _line_docs():
    rng = np.random.default_rng(9)
    lines = [_line(rng, int(n)) for n in rng.integers(5, 40, 25)] + [_line(rng, 260), "ÄRGER über Öl und Straßen, naïve 😀 Leute"]
    docs = {0: None, 1: "", 2: "  \n\n ", 3: "too short\n" * 4}
    for i in range(4, 60):
        picked = [lines[k] for k in rng.integers(0, len(lines), 3)]
        out = [p if rng.random() < 0.4 else _near(rng, p, int(rng.integers(1, 4))) for p in picked]
        out.append(picked[0].upper().replace(" ", ", ") if i % 5 == 0 else _line(rng, 12))
        docs[i] = ("\r\n" if i % 7 == 0 else "\n").join(out)
    docs[60] = docs[10] = "one line of seven words, said twice\n" * 2
    docs[61] = "z" * 7000 + " " + lines[0]
    return docs


def test_lines_against_all_pairs(spark):
    docs = _line_docs()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs.items()], "doc_id long, text string, form string, sim string")
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in line_dedup.dedup_lines(df).collect()}
    want = lines_left(docs)
    gone, due = sum(n for _, n in got.values()), sum(n for _, n in want.values())
    assert due > 50 and due >= gone >= 0.95 * due
    assert sum(got[i] == want[i] for i in docs) >= 0.95 * len(docs)


def test_lines_of_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "the same five words here"), (1, "the same five words here"), (None, "the same five words here")], "doc_id long, text string")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(rows, key=str) == [(1, ""), (1, ""), (None, "the same five words here")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    texts: list[str | None] = [None, "", " \n"]
    texts += [" ".join(_line(rng, 60) for _ in range(2)) for _ in range(60)]
    texts += [texts[5], texts[6] + " tail", _near(rng, texts[7], 2), texts[8] + "\n" + _line(rng, 30)]
    texts += [_line(rng, 20) + "\npassword: hunter2hunter2 AKIA" + "Q7" * 9 + "\n" + _line(rng, 20), _line(rng, 9000)]
    junk = len(texts)
    texts += [" ".join(f"!!{w.upper()}$$" for w in _line(rng, 40).split()) for _ in range(60)]
    where = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "made", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(i < junk), 0) for i in range(3, len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, junk


def _texts(df):
    rows = df.collect()
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r["text"] for r in rows}


def test_stages(spark, tables):
    where, junk = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, where))
        steps[name] = (before, docs)
        assert name == "packing" or docs.columns == columns

    before, after = steps["quality"]
    scores = {r["doc_id"]: r["score"] for r in quality.score(before, quality.fit(before, spark.read.parquet(f"{where}/labels.parquet"))).collect()}
    left = _texts(after)
    assert set(left) == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    assert set(range(3, junk)) <= set(left) and not any(i >= junk for i in left)

    before, after = map(_texts, steps["line_dedup"])
    want = {i: t for i, (t, n) in lines_left(before).items() if not n or t.strip(" ")}
    assert after == want and after != before

    before, after = map(_texts, steps["jaccard_join"])
    assert after == {i: before[i] for i, low in jaccard_groups(before).items() if i == low}

    before, after = map(_texts, steps["secrets"])
    assert set(before) == set(after)
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {i for i, t in before.items() if "password: " in (t or "")} and len(changed) == 1
    (i,) = changed
    assert after[i] == re.sub(r"password: hunter2hunter2|AKIA\w+", "[SECRET]", before[i])

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = set()
    for i, t in after.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    rows = docs.collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
