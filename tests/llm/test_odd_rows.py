"""Null ids, repeated rows, differing lengths, clashing names and empty tables."""

import numpy as np
import pytest

from postledger.llm import jaccard_join, packing, pieces, quality, secret_scan, substrings, token_count
from postledger.llm.exact_topk import exact_topk
from postledger.llm.graph_ann import nearest
from postledger.llm.queries import tokenizer_path

KEY = "Ab1" * 13


def _scan(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = secret_scan.scan_secrets(df).select("doc_id", secret_scan.joined("found").alias("f"), secret_scan.joined_links("links").alias("l"))
    return {r["doc_id"]: (r["f"], r["l"]) for r in out.collect()}


def test_a_part_proves_no_other(spark):
    got = _scan(
        spark,
        f"login: bob see https://api.test/{KEY}",  # the path is the endpoint's own
        f"secret = '{KEY}' login: bob",  # the value is the assignment's own
        f"login: bob\n{KEY} then https://api.test/v1",
        f"login: bob\n\n{KEY}",  # another scope
        KEY,
    )
    assert got[0] == ("", "")
    assert got[1][0] == "assign:0:49,account:51:61" and got[1][1] == "assign:0:49<account:51:61"
    assert got[2] == ("account:0:10,key:11:50,endpoint:56:75", "key:11:50<account:0:10@endpoint:56:75")
    assert got[3] == ("", "") and got[4] == ("", "")


def test_nearest_identifier_is_linked(spark):
    text = "login: ann\ntoken = abcdef\nlogin: bob\n" + "x" * 30 + " client_id: zoe " + "0" * 24
    got = _scan(spark, text)[0][1]
    assert got == "assign:11:25<account:0:10,hex:83:107<account:68:82"


def test_rows_without_id_and_repeated_rows(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "some other words of no document at all"), (2, None)], "doc_id long, text string")
    key = lambda r: str(r)
    scan = [(r["doc_id"], r["n_hex"]) for r in secret_scan.scan_secrets(df).collect()]
    assert sorted(scan, key=key) == sorted([(1, 0), (1, 0), (None, 0), (None, 0), (2, 0)], key=key)
    join = [tuple(r) for r in jaccard_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(join, key=key) == sorted([(1, 3, 1), (1, 3, 1), (None, 3, 1), (None, 4, None), (2, 0, 2)], key=key)
    assert sorted((r["doc_id"] for r in substrings.drop_repeats(df).collect()), key=key) == sorted([1, 1, None, None, 2], key=key)
    path = tokenizer_path("piece_bpe_32k.model")
    assert token_count.count_tokens(df, path).count() == 5 and pieces.round_trip(df, path).count() == 5
    packed = packing.pack(df, tokenizer_path("word_bpe_49k.json")).collect()
    assert len(packed) == 5 and len({(r["sequence_id"], r["offset"]) for r in packed}) == 5


def test_redact_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "token = abcdef", 7, "x", 2)], "doc_id long, text string, found int, text_hash string, row int")
    assert secret_scan.redact(df).collect()[0].asDict() == {"doc_id": 1, "text": "[SECRET]", "found": 7, "text_hash": "x", "row": 2}


def test_vectors_of_different_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(3)] + [(200, [1.0] * 9), (300, []), (301, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by = dict(rows)
    for got, digits in ((exact_topk(df, every=20, k=2).collect(), 0), (nearest(df, every=20, k=2).collect(), 9)):
        asked = {}
        for r in got:
            assert len(by[r["query_id"]]) == len(by[r["vec_id"]])
            asked.setdefault(r["query_id"], []).append(r["vec_id"])
        assert {q: len(v) for q, v in asked.items()} == {0: 2, 20: 2, 100: 2}
        if digits:
            for q, found in asked.items():
                best = sorted((i for i in by if i != q and by[i] and len(by[i]) == len(by[q])), key=lambda i: -np.dot(by[q], by[i]))
                assert found == best[:2]


def test_several_shards_are_merged(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, every=50, k=10, shard_rows=200).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum(len(set(np.argsort(-np.where(np.arange(900) == q, -np.inf, x @ x[q]))[:10].tolist()) & set(v)) for q, v in got.items())
    assert len(got) == 18 and hits >= 0.9 * 180


def test_scores_keep_columns(spark):
    worth = quality.fit(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    df = spark.createDataFrame([(1, "a text", 0.5, "r"), (None, None, None, None)], "doc_id long, text string, score double, row string")
    with pytest.raises(ValueError):
        quality.scored(df, worth)
    out = quality.scored(df, worth, "score_")
    assert out.columns == [*df.columns, "score_"] and all(0 <= r["score_"] <= 1 for r in out.collect())
    assert quality.scored(df.limit(0), worth, "score_").count() == 0


def test_large_components_are_summed_exactly(spark):
    rng = np.random.default_rng(6)
    rows = [(0, [100003.7, 2.3]), (1, [100001.1, 9.71]), (2, [100001.1, 9.72]), (3, [100001.1, 9.72])]
    rows += [(i, [float(x) for x in np.round(rng.normal(0, 1e6, 2), 3)]) for i in range(4, 90)]
    rows += [(i, [1e6 + float(x) for x in rng.integers(0, 3, 2) / 1024]) for i in range(90, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    z = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for i in (0, 100):
        best = sorted((-sum(a * b for a, b in zip(z[i], z[j])), j) for j in z if j != i)[:10]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, exact_topk(df).collect())) == want
    assert exact_topk(df.where("vec_id < 2"), every=100).where("query_id = 0").collect()[0]["score"] == 10486263221281053


def test_products_beyond_a_long_are_cut_to_it(spark):
    rows = [(0, [1e300, 0.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [1e12, 0.0])]
    got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100).collect()
    most = 2**63 - 1
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, most), (3, most), (2, -most - 1)]
