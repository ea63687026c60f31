import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.llm import language_id
from waymesh.llm.common import read

DOC = "doc_id long, text string, lang string, source string"


def corpus(n=400):
    rng = random.Random(1)
    parts = {"aa": ["the", "ing", "th", "er", "and "], "bb": ["der", "sch", "ung", "ü", "ein "], "cc": ["qué", "ción", "los", "ñ", "del "]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        rows.append((i, "".join(rng.choice(parts[lang]) for _ in range(rng.randint(20, 400))), lang, "s"))
    return rows


def test_held_out_texts_are_told_apart(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in language_id.identify(df, language_id.fit(df)).collect()}
    lang = {r[0]: r[2] for r in rows}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_accuracy_on_the_test_table(spark, sf_dir):
    df = read(spark, sf_dir, "documents")
    found = language_id.identify(df, language_id.fit(df)).filter("held_out").join(df.select("doc_id", "lang"), "doc_id").filter("lang is not null")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    rows = corpus(200)
    df = spark.createDataFrame(rows, DOC)
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "other") for i, t, lang, _ in rows]
    other = spark.createDataFrame(changed, DOC)
    a = sorted(map(tuple, language_id.identify(df, language_id.fit(df)).collect()))
    b = sorted(map(tuple, language_id.identify(other, language_id.fit(other)).collect()))
    assert a == b


def test_folded_tables_give_the_plain_convolution():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (5, language_id.WINDOW), dtype=np.uint8)
    net = language_id.train(windows, ["a", "b", "a", "b", "a"], epochs=1)
    best = []
    for w, c in net.conv.items():
        e = net.embed[windows]
        value = sum(e[:, o : language_id.WINDOW - w + 1 + o] @ c[o] for o in range(w))
        best.append(value[:, : language_id.WINDOW - 3].max(axis=1))
    hidden = np.maximum(np.concatenate(best, axis=1) + net.bias, 0)
    want = language_id.softmax(hidden @ net.dense + net.out)
    assert np.allclose(net.probabilities(windows, net.tables()), want, atol=1e-4)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_windows_cover_the_text(n):
    data = bytes(i % 251 for i in range(n))
    windows = language_id.cut_windows(data)
    assert set(data) <= set(windows.ravel().tolist()) and len(windows) == max(1, -(-n // 256))


def test_odd_rows(spark):
    rows = corpus(60) + [(900, None, "aa", None), (901, "", "aa", None), (902, "123 !!", "aa", None), (None, "the and ing", None, None), (5, "the and ing", None, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], DOC + ", score double")
    net = language_id.fit(df)
    got = language_id.identify(df, net).collect()
    assert len(got) == len(rows)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {("und", 0.0)}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    kept = {r.doc_id for r in language_id.keep_identified(df, net).collect()}
    assert not {900, 901, 902} & kept and {r[0] for r in corpus(60)} <= kept
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.fit(unlabelled) is None
    assert {r.lang_pred for r in language_id.identify(unlabelled, None).collect()} == {"und"}
    assert language_id.identify(df.limit(0), net).collect() == []


def test_rare_languages_are_learned(spark):
    """300 languages, and one of 3 rows beside common ones."""
    rows = [(i, f"text {'abcdefghij'[i % 10] * 30}", f"l{i % 300:03d}", "s") for i in range(3000)]
    df = spark.createDataFrame(rows, DOC)
    counts = {r["lang"]: r["n"] for r in language_id.training_sample(df, max_docs=600).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert len(counts) == 300 and max(counts.values()) <= 2
    few = [(i, "abc def", "big", "s") for i in range(4000)] + [(10_000 + i, "xyz", "rare", "s") for i in range(3)]
    learned = sum(zlib.crc32(str(10_000 + i).encode()) % 4 != 2 for i in range(3))
    counts = {r["lang"]: r["n"] for r in language_id.training_sample(spark.createDataFrame(few, DOC), max_docs=100).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert counts == {"big": 50, "rare": learned}
    only = language_id.training_sample(spark.createDataFrame(few, DOC), max_docs=100, max_languages=1)
    assert {r["lang"] for r in only.collect()} == {"big"}


def test_other_column_names(spark):
    rows = corpus(60)
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, body string, lang string, source string, text int")
    net = language_id.fit(df, "id", "body")
    assert language_id.keep_identified(df, net, text_col="body").count() == 60
    assert language_id.identify(df, net, "id", "body").filter("lang_pred <> 'und'").count() == 60
