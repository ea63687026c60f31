import random
import time

import pytest
from pyspark.sql import functions as F

from waymesh.llm import line_dedup

DOC = "doc_id long, text string"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    places = sorted(((i is None, i or 0), n, line) for i, t in {(i, t or "") for i, t in rows} for n, line in enumerate(t.split("\n")) if len(line) >= line_dedup.LEAST_CHARS)
    out = {}
    for k, (i, n, line) in enumerate(places):
        if any(within_one(line, other) for *_, other in places[:k]):
            out.setdefault(None if i[0] else i[1], set()).add(n)
    return out


def corpus():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    base = [word(rng.randint(18, 45)) for _ in range(30)]

    def line():
        x = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randint(0, len(x) - 1)
            x = rng.choice([x[:i] + x[i + 1 :], x[:i] + "Q" + x[i + 1 :], x[:i] + "Z" + x[i:]])
        return x

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, base[0]), (103, "x" * 30 + "\n" + "x" * 31), (104, "y" * 40_000)]


@pytest.mark.parametrize("few", [500_000, 0])  # 0: the keys meet their rows by a shuffle
def test_dropped_lines_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW_KEYS", few)
    rows = corpus()
    want = brute(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame([(*r, "x") for r in rows], DOC + ", line string").repartition(3)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert set(r.dropped) == want.get(r.doc_id, set()), r.doc_id
        lines = (texts[r.doc_id] or "").split("\n")
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in set(r.dropped))
        assert (r.n_lines, r.n_dropped) == (len(lines), len(r.dropped))


def test_parts_meet_for_all_lengths(spark):
    rng = random.Random(2)
    pairs = []
    for n in range(20, 90):
        a = "".join(rng.choice("abcdefgh") for _ in range(n))
        for i in range(n):
            pairs += [(a, a[:i] + a[i + 1 :]), (a, a[:i] + "Z" + a[i + 1 :])]
    df = spark.createDataFrame(pairs, "a string, b string")
    miss = df.select(line_dedup._parts(df.a)["k"].alias("x"), line_dedup._parts(df.b)["k"].alias("y")).filter("not arrays_overlap(x, y)")
    assert miss.count() == 0


@pytest.mark.parametrize("few", [500_000, 0])
def test_repeated_rows_empty_table_and_plan(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW_KEYS", few)
    line = "the same line of more than twenty"
    df = spark.createDataFrame([(2, line), (2, line), (1, line + "!")], DOC)
    got = sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(1, 0), (2, 1), (2, 1)]
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).collect() == []


@pytest.mark.parametrize("few", [500_000, 0])
def test_short_lines_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW_KEYS", few)
    rng = random.Random(3)
    short = ["".join(rng.choice("ab é") for _ in range(n)) for n in range(1, 20) for _ in range(3)]
    short += [x + "Q" for x in short] + ["All rights reserved", "Share on Facebook", "版" * 19, "{", "}", "\r"]
    rows = [(i, "\n".join(rng.choice(["", *short]) for _ in range(rng.randint(1, 6)))) for i in range(80)] + [(None, "}"), (90, "}\n\n}\n\n")]
    near = line_dedup.NEAR_CHARS
    places = sorted(((i is None, i or 0), n, line) for i, t in rows for n, line in enumerate(t.split("\n")) if line)
    want = {(None if i[0] else i[1], n) for k, (i, n, line) in enumerate(places) if any(line == o or min(len(line), len(o)) >= near and within_one(line, o) for *_, o in places[:k])}
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOC).repartition(3)).collect()
    assert {(r.doc_id, n) for r in got for n in r.dropped} == want
    assert (None, 0) in want and (90, 2) in want and (90, 1) not in want


def test_variants_hash_like_whole_lines(spark):
    """The hash of each variant is that of the line that it is, for lengths about the block sizes."""
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdé\U0001f600") for _ in range(n)) for n in (16, 63, 64, 65, 66, 128, 129, 130, 192, 193, 1000, 16_384, 16_385, 16_386, 20_000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("p", line_dedup._code_points(F.col("line"))).withColumn("n", F.length("line"))
    got = df.select(F.xxhash64("line").alias("line"), F.explode_outer(line_dedup.let(F.col("p"), lambda p: line_dedup._deletions(p, F.col("n"), F.lit(1), F.col("n")))).alias("v"))
    wanted = [(x, i) for x in lines for i in (range(1, len(x) + 1) if len(x) < 300 else sorted({1, 2, 63, 64, 65, 127, 128, 129, len(x) // 2, len(x) - 1, len(x)}))]
    whole = spark.createDataFrame([(x, i, x[: i - 1] + x[i:]) for x, i in wanted], "w string, i int, r string")
    whole = whole.withColumn("p", line_dedup._code_points(F.col("r"))).select(F.xxhash64("w").alias("w"), "i", line_dedup._whole(F.col("p"), F.length("r")).alias("h2"))
    both = got.join(whole, (F.col("line") == F.col("w")) & (F.col("v.pos") == F.col("i")))
    assert both.count() == len(wanted) and both.filter("v.h <> h2").isEmpty()


def test_very_long_lines_and_many_lines(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    other = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    many = "\n".join(["the same line again and again"] * 60_000 + ["the last line, which is its own"])
    rows = [(1, long), (2, long[:40_000] + "Q" + long[40_001:]), (3, long[:70_000] + long[70_001:]), (4, other), (5, other[:7] + "Z" + other[7:]), (6, many)]
    began = time.perf_counter()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert time.perf_counter() - began < 120
    assert {i: x[1] for i, x in got.items()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1, 6: 59_999}
    assert got[6][2] == "the same line again and again\nthe last line, which is its own"


def test_within_one_edit_of_long_lines(spark):
    rng = random.Random(6)
    rows = []
    for n in (257, 300, 1000):
        a = "".join(rng.choice("abé\U0001f600") for _ in range(n))
        for i in (0, 1, n // 2, n - 2, n - 1):
            edits = [a[:i] + a[i + 1 :], a[:i] + "Q" + a[i + 1 :], a[:i] + "Z" + a[i:], a[:i] + "QQ" + a[i + 2 :], a[:i] + a[i + 2 :], "Z" + a[:i] + "Z" + a[i + 1 :]]
            rows += [(a, b, within_one(a, b)) for b in edits] + [(b, a, within_one(a, b)) for b in edits]
        rows += [(a, a, True), (a, a + "x", True), (a, a + "xy", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.filter(line_dedup._within_one(F.col("a"), F.col("b")) != F.col("want")).isEmpty()
