"""Languages: held-out accuracy, counts of letter runs, odd rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from postledger.llm import language
from postledger.llm.common import mix
from postledger.llm.language import BUCKETS, ORDERS, OneOnOne, family_of, fit, letter_counts, letters, machine, predict
from postledger.llm.queries import op12_language_id

SF = "/root/testdata/sf0.01"
ROWS = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    got = op12_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").groupBy("held_out").agg(F.avg(F.expr("cast(lang = lang_pred AS int)")).alias("right"), F.count("*").alias("n")).collect()
    right = {r["held_out"]: (r["right"], r["n"]) for r in rows}
    assert right[True][0] >= 0.98 and right[True][1] > 100 and right[False][0] >= 0.98
    assert got.where("score < 0 OR score > 1 OR score IS NULL").isEmpty() and got.count() == 1000


def _plain(text):
    """Buckets of all runs of 1 to 4 letters within marked words."""
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    found = Counter()
    for w in words:
        marked = [0, *map(ord, w), 0]
        for n in range(1, ORDERS + 1):
            for i in range(len(marked) - n + 1):
                if n > 1 or marked[i]:
                    h = np.zeros(1, np.uint64)
                    for c in marked[i : i + n]:
                        h = h * np.uint64(0x100000001B3) + np.uint64(c) + np.uint64(1)
                    found[int(mix(h)[0] % np.uint64(BUCKETS))] += 1
    return found


def test_counts_equal_a_plain_loop(monkeypatch):
    text = "L'Été à 12 h: Straße, NAÏVE_x ½ 你好 ok\n" * 3
    want = _plain(text)
    for stretch in (1 << 18, 7, 1):  # a text is counted alike in one stretch or many
        monkeypatch.setattr(language, "STRETCH", stretch)
        got = letter_counts(letters(text.encode()))
        # a single gap parts two words, so no run holds both
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(want)


def test_texts_without_a_letter_are_undecided(spark):
    docs = spark.createDataFrame([(i, w * 5, x) for i, (w, x) in enumerate([("the house is ", "en"), ("das haus ist ", "de"), ("la maison est ", "fr")] * 20)], ROWS)
    odd = spark.createDataFrame([(1, None, None), (1, "", None), (None, " 12 !½_\n", "en"), (3, "haus ist das", None), (3, "haus ist das", None)], ROWS)
    model = fit(docs)
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in predict(odd.withColumn("score", F.lit(1)), model).collect()), key=str)
    assert [g[:2] for g in got] == [(1, "und"), (1, "und"), (3, "de"), (3, "de"), (None, "und")]
    assert all((g[2] == 0) == (g[1] == "und") for g in got)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], ROWS)
    assert predict(empty, fit(empty)).count() == 0
    docs = spark.createDataFrame([(1, "some text", None), (None, "some text", "en"), (2, None, "en"), (4, "123", "de")], ROWS)
    assert {(r["lang_pred"], r["score"]) for r in predict(docs, fit(docs)).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "some text", "en") for i in range(9)], ROWS)
    assert {(r["lang_pred"], r["score"]) for r in predict(one, fit(one)).collect()} == {("en", 1.0)}


def test_ids_and_labels_are_no_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).select("doc_id", "text", "lang").cache()
    model = fit(docs)
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs, model).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs.withColumn("lang", F.lit("xx")), model).collect()}
    assert a == b


def test_the_sample_is_bounded_and_every_language_is_in_it(spark):
    rows = [(i, f"text {i}", "en") for i in range(900)] + [(1000 + i, f"mot {i}", "fr") for i in range(20)] + [(2000 + i, f"wort {i}", "de") for i in range(3)]
    docs = spark.createDataFrame(rows, ROWS)
    got = language.learned_rows(docs, "doc_id", "text", "lang", kinds=2, each=10, most=15).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 8, "fr": 7} or {r["lang"]: r["count"] for r in got} == {"en": 7, "fr": 8}


def test_families_first(spark):
    assert family_of("de", language.FAMILIES) == family_of("en", language.FAMILIES) == "germanic"
    assert family_of("es", language.FAMILIES) == "romance" and family_of("tlh", language.FAMILIES) == "tlh"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs, each=60)
    assert model.families.names == ["germanic", "romance"] and model.within["germanic"].names == ["de", "en"] and model.within["romance"].names == ["es", "fr"]


def test_machine_separates():
    rng = np.random.default_rng(1)
    at = np.arange(40)
    rows, signs = [], np.where(np.arange(200) % 2, 1.0, -1.0)
    for s in signs:
        x = rng.normal(size=40)
        x[0] = s * (1 + abs(x[0]))
        rows.append((at, x / np.linalg.norm(x)))
    w = machine(rows, signs)
    assert np.mean([np.sign(w[a] @ x) == s for (a, x), s in zip(rows, signs)]) > 0.98


def test_ties_go_to_the_first_name():
    blank = OneOnOne(["a", "b", "c"], np.zeros((BUCKETS, 3), np.float32))
    assert blank.decide(np.ones(BUCKETS, np.float32)) == ("a", 0.5)
