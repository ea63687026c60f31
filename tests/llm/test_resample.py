"""Weights, scores and ranks against a plain version and SQL, runs of several words, and the drawn rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from waymesh.llm import queries, resample

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, runs):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]


def brute(docs, items, runs=(1, 1), buckets=10_000, least=20, percent=10, seed=2024):
    """(doc_id, n_features, weight, score, rank) of each document."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, runs))
    t = Counter(bucket(f) for _, x in items for f in features(x, runs))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for doc_id, text in docs:
        found = features(text, runs)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in rows]


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n, vocabulary: rng.choice([" ", ", ", "-\n"]).join(rng.choice(vocabulary) for _ in range(n))
    one, two = ["The", "cat", "Sat", "x1", "é", "über", "a"], ["math", "proof", "LEMMA", "a", "the"]
    docs = [(i, say(rng.randint(0, 60), rng.choice([one, two, one + two]))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "!!"), (None, say(40, two)), (None, say(40, two)), (7, docs[7][1]), (403, "proof " * 30_000), (404, "x" * 50_000), (405, say(19, two)), (406, say(20, two))]
    return docs, [(i, say(rng.randint(0, 30), two)) for i in range(30)] + [(50, None), (51, "")]


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())))


@pytest.mark.parametrize(("seed", "settings"), [(1, {}), (2, {"runs": (1, 2), "buckets": 97}), (3, {"runs": (2, 3), "percent": 50, "least_words": 1, "seed": 5}), (4, {"percent": 100}), (5, {"percent": 0})])
def test_matches_brute_force(spark, monkeypatch, seed, settings):
    docs, items = corpus(seed)
    if seed == 2:
        monkeypatch.setattr(resample, "PIECE", 30)
        monkeypatch.setattr(resample._Buckets, "MOST", 5)
    df = spark.createDataFrame([(*d, "x", 5) for d in docs], DOC + ", rank string, weight int").repartition(5)
    plain = {"least": settings.get("least_words", 20)} | {k: v for k, v in settings.items() if k != "least_words"}
    assert rows(resample.importance(df, spark.createDataFrame(items, ITEM), **settings)) == sorted(map(str, brute(docs, items, **plain)))


def test_sql(spark, tmp_path):
    docs, items = corpus(8)
    c = duckdb.connect()
    for name, found, schema in (("documents", docs, DOC), ("benchmark", items, ITEM)):
        spark.createDataFrame(found, schema).coalesce(1).write.parquet(str(tmp_path / name))
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    assert sorted(map(str, c.sql(resample.SQL).fetchall())) == sorted(map(str, brute(docs, items)))


def test_query(spark, sf_dir):
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = queries.QUERIES["op12_importance_resampling"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows(got) == sorted(map(str, c.sql(resample.SQL).fetchall()))


def test_sample_is_what_is_drawn(spark):
    docs, items = corpus(6)
    df = spark.createDataFrame([(*d, i, "kept") for i, d in enumerate(docs)], DOC + ", score int, rank string").repartition(3)
    got = resample.resample(df, spark.createDataFrame(items, ITEM), percent=30)
    assert got.columns == df.columns and got.schema == df.schema
    drawn = {r[0] for r in brute(docs, items, percent=30) if r[4] is not None}
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, t in docs if i in drawn and len(words(t)) >= 20)


def test_towards_the_target(spark):
    """Of two equal halves the draw takes the one that the target is like."""
    rng = random.Random(1)
    word = lambda half: f"{half}{rng.randint(0, 40)}"
    df = spark.createDataFrame([(i, " ".join(word("good" if i % 2 else "bad") for _ in range(60))) for i in range(2000)], DOC)
    target = spark.createDataFrame([(0, " ".join(word("good") for _ in range(5000)))], ITEM)
    got = [r.doc_id % 2 for r in resample.resample(df, target, percent=30).collect()]
    assert len(got) == 600 and sum(got) > 560


def test_vectors_and_empty_tables(spark):
    docs, items = corpus(9)
    df = spark.createDataFrame(docs, DOC).repartition(40)
    want = Counter(zlib.crc32(f.encode()) % 500 for _, t in docs for f in features(t, (1, 1)))
    assert resample.bucket_counts(df, buckets=500).tolist() == [want[b] for b in range(500)]
    none = spark.createDataFrame([], DOC)
    assert resample.importance(none, spark.createDataFrame(items, ITEM)).collect() == [] and resample.resample(none, none).collect() == []
    assert rows(resample.importance(df, spark.createDataFrame([], ITEM))) == sorted(map(str, brute(docs, [])))
    assert np.array_equal(resample.gains(np.zeros(4, np.int64), np.zeros(4, np.int64)), np.zeros(4))
    with pytest.raises(ValueError):
        resample.importance(df, df, runs=(0, 1))
