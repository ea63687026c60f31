import random
from collections import defaultdict

from pyspark.sql import functions as F

from waymesh.llm import packing

DOC = "doc_id long, text string"


def plain_best_fit(lengths, capacities):
    """Best fit by looking at every open bin and every later piece."""
    bins = []
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] - sum(b[1]) >= n]
        if fits:
            least = min(b[0] - sum(b[1]) for b in fits)
            pick = [b for b in fits if b[0] - sum(b[1]) == least]
            pick[-1][1].append(n)
        else:
            score = lambda c: packing.cost(c) / (n + min(c - n, sum(x for x in lengths[i + 1 :] if x <= c - n)))  # noqa: E731, B023
            bins.append((min((c for c in capacities if c >= n), key=score), [n]))
    return bins


def test_best_fit_opens_and_fills_like_the_plain_way():
    rng = random.Random(1)
    for _ in range(60):
        caps = sorted(rng.sample(range(8, 200), 3))
        lengths = sorted((rng.randint(1, caps[-1]) for _ in range(rng.randint(1, 60))), reverse=True)
        bins, offsets, opened = packing.best_fit(lengths, caps)
        held = defaultdict(list)
        for b, n in zip(bins, lengths):
            held[b].append(n)
        plain = plain_best_fit(lengths, caps)
        # Bins with equal room may swap what comes next; what is opened and what room is left can't differ.
        assert sorted(c for c, _ in plain) == sorted(opened)
        assert sorted(c - sum(x) for c, x in plain) == sorted(opened[b] - sum(x) for b, x in held.items())


def test_pack_takes_the_cheapest_limit_and_shrinks_bins():
    rng = random.Random(2)
    lengths = sorted((min(2000, int(rng.paretovariate(1) * 20)) for _ in range(400)), reverse=True)
    caps = (128, 512, 2048)
    bins, offsets, sizes = packing.pack(lengths, caps)
    used = defaultdict(int)
    for b, n in zip(bins, lengths):
        used[b] += n
    assert all(sizes[b] == min(c for c in caps if c >= u) for b, u in used.items())
    assert sum(map(packing.cost, sizes)) <= sum(packing.cost(min(c for c in caps if c >= n)) for n in lengths)


def check_whole(rows, sizes, capacities):
    """Every token of every document in exactly one place; no overlap; bins as small as they can be."""
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.start + r.length))
        by_bin[r.bin_id].append(r)
    assert {d: sum(b - a for a, b in x) for d, x in by_doc.items()} == sizes
    for held in by_bin.values():
        held.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in held:
            assert r.bin_offset == at
            at += r.length
        assert {r.bin_used for r in held} == {at}
        assert {r.bin_capacity for r in held} == {min(c for c in capacities if c >= at)}


def test_documents(spark):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randint(0, 300)) for i in range(300)] + [(300, None), (301, ""), (302, "x" * 5000), (None, "abc")]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", length string")
    got = packing.pack_documents(df, capacities=(256, 1024), group=50).collect()
    check_whole(got, {i: len((t or "").encode()) + 1 for i, t in rows}, (256, 1024))
    again = packing.pack_documents(df.repartition(3), capacities=(256, 1024), group=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab")], DOC)
    assert [r.length for r in packing.pack_documents(df).collect()] == [3, 3]
    assert packing.pack_documents(spark.createDataFrame([], DOC)).collect() == []


def test_many_equal_rows_are_spread_over_groups(spark):
    df = spark.range(60_000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")
    got = packing.pack_documents(df)
    sizes = [r["n"] for r in got.selectExpr("shiftright(bin_id, 32) as g").groupBy("g").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 60_000 and len(sizes) == 8 and max(sizes) < 3 * packing.GROUP
    assert got.groupBy("bin_id").agg(F.sum("length").alias("n"), F.first("bin_used").alias("u")).filter("n <> u").isEmpty()
