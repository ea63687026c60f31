"""Network facts on small hand-made edges, and chains against a plain walk."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymesh.functions.scalars import level
from waymesh.operators import graph

EDGE = "fid long, highway string, name string, bridge string, tunnel string, layer string, oneway boolean, vertices array<struct<x:double,y:double>>"


def make(spark, lines, **columns):
    rows = []
    for i, line in enumerate(lines):
        get = lambda k, d=None, i=i: columns.get(k, [d] * len(lines))[i]
        rows.append((i, get("highway", "residential"), get("name"), get("bridge"), get("tunnel"), get("layer"), get("oneway"), [{"x": float(x), "y": float(y)} for x, y in line]))
    df = graph.edge_nodes(spark.createDataFrame(rows, EDGE))
    df = df.withColumn("lvl", level(F.col("bridge"), F.col("tunnel"), F.col("layer")))
    return df if "oneway" in columns else df.drop("oneway")


A, B, C, D = (18.0, 59.0), (18.001, 59.0), (18.002, 59.0), (18.001, 59.001)


def test_twins_are_directed(spark):
    df = make(spark, [[A, B], [A, (18.0005, 59.0001), B], [B, C], [C, B]])
    got = [r.twoway for r in graph.mark_twoway(df).orderBy("fid").collect()]
    assert got == [False, False, True, True]


def test_loops_need_a_second_loop(spark):
    loop = [A, D, A]
    assert [r.twoway for r in graph.mark_twoway(make(spark, [loop])).collect()] == [False]
    assert [r.twoway for r in graph.mark_twoway(make(spark, [loop, loop])).collect()] == [True, True]


def test_explicit_oneway_wins(spark):
    lines = [[A, B], [B, C]]
    arrows = lambda df: [r["__rs_oneway"] for r in graph.mark_twoway(df).orderBy("fid").collect()]
    assert arrows(make(spark, lines, oneway=[True, False])) == [True, False]
    assert arrows(make(spark, lines)) == [True, True]


def test_levels(spark):
    df = make(spark, [[A, B]] * 4, bridge=["yes", "yes", None, None], tunnel=[None, None, "yes", None], layer=["1", "3", "-2", "1"])
    assert [r.lvl for r in df.orderBy("fid").collect()] == [1, 3, -2, 0]


def plain_walk(edges, oneway):
    """Greedy chains from the lowest edge on, through nodes of two edge ends."""
    at = {}
    for i, (a, z) in edges.items():
        at.setdefault(a, []).append(i)
        at.setdefault(z, []).append(i)
    used, out = set(), {}
    for start in sorted(edges):
        if start in used:
            continue
        used.add(start)
        chain = [(start, True)]
        for prepend in (False, True):
            node = edges[start][0 if prepend else 1]
            while True:
                free = [j for j in at[node] if j not in used]
                if len(at[node]) != 2 or len(free) != 1:
                    break
                j = free[0]
                a, z = edges[j]
                if (z if prepend else a) == node:
                    forward, nxt = True, a if prepend else z
                elif not oneway:
                    forward, nxt = False, z if prepend else a
                else:
                    break
                used.add(j)
                chain.insert(0 if prepend else len(chain), (j, forward))
                node = nxt
        for pos, (j, forward) in enumerate(chain):
            out[j] = (start, pos, forward)
    return out


@pytest.mark.parametrize("oneway", [False, True])
def test_chains_match_a_plain_walk(spark, oneway):
    rng = random.Random(7)
    rows, want = [], {}
    for g in range(60):
        n = rng.randint(1, 9)
        edges = {}
        for k in range(rng.randint(1, 10)):
            a = rng.randint(0, n)
            z = a + 1 if rng.random() < 0.5 else rng.randint(0, n)
            edges[g * 100 + k] = (a, z)
        want |= plain_walk(edges, oneway)
        rows += [(i, g if g else None, a, z) for i, (a, z) in edges.items()]
    df = spark.createDataFrame(rows, "fid long, grp int, a int, z int")
    got = {r.fid: (r.chain, r.pos, r.forward) for r in graph.chains(df, ["grp"], F.lit(oneway)).collect()}
    assert got == want


def test_slots_cover_the_chain(spark):
    step = 0.001
    lines = [[(18 + i * step, 59.0), (18 + (i + 1) * step, 59.0)] for i in range(9)]
    df = graph.mark_twoway(make(spark, lines, name=["Street"] * 9, highway=["primary"] * 5 + ["service"] * 4))
    slots = graph.annotation_slots(df, 100.0).orderBy("slot").collect()
    metre = 111320.0 * math.cos(math.radians(59))
    total = 9 * step * metre
    whole, rest = divmod(total, 100.0)
    assert len(slots) == int(whole) + (rest > 30)
    assert {(s.name, s["class"], s.oneway) for s in slots} == {("Street", "primary", 1)}
    length = sum(abs(s.vertices[-1].x - s.vertices[0].x) for s in slots) * metre
    assert length == pytest.approx(min(total, 100.0 * len(slots)), abs=1)
    assert {r.slot % 2 for r in graph.name_slots(graph.annotation_slots(df, 100.0)).collect()} == {0}


def test_two_way_streets_are_sliced_once(spark):
    df = graph.mark_twoway(make(spark, [[A, B], [B, A]], name=["S", "S"]))
    assert {r.chain for r in graph.annotation_slots(df, 50.0).collect()} == {1} or {r.chain for r in graph.annotation_slots(df, 50.0).collect()} == {0}


def decks(spark, lines, **columns):
    return graph.bridge_decks(graph.mark_twoway(make(spark, lines, **columns))).collect()


def test_deck_slopes_only_at_ground_ends(spark):
    rows = [r for r in decks(spark, [[A, B], [B, C], [B, D]], bridge=["yes"] * 3) if r.kind == "deck"]
    assert {r.fid for r in rows} == {0, 1, 2}
    for fid in (0, 1, 2):
        bases = [r.base for r in rows if r.fid == fid]
        assert min(bases) < 0.5 and max(bases) == 5.0  # a ground end at one side, the fork at full height


def test_two_way_bridge_has_a_ribbon_for_each_edge(spark):
    rows = decks(spark, [[A, B], [B, A]], bridge=["yes", "yes"])
    assert {r.fid for r in rows if r.kind == "deck"} == {0, 1}
    assert all(r.vertices[0] == r.vertices[-1] for r in rows)


def test_no_bridges_no_decks(spark):
    assert decks(spark, [[A, B]]) == []
