"""Facts about the network: reverse twins, node degrees, chains of edges, annotation slots and bridge decks.

An edge has an id (fid), end nodes a and z (any comparable key: micro-degree pairs by edge_nodes, or plain ids) and, for
the geometric operators, vertices. Chains are found by sets: each edge in each direction is a half-edge with at most one
successor, and pointer doubling ranks all half-edges at once, in as many rounds as the logarithm of the longest chain.
No group is ever handed to one task, so a huge group (all unnamed roads, say) costs no more than others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.functions import geometry as G
from waymesh.functions.scalars import flag_for_web
from waymesh.functions.widths import GROUP, OTHER, width_at
from waymesh.operators.profile import running_total
from waymesh.session import cut, partitions_for
from waymesh.sources.settings import DEFAULT


def edge_nodes(df: DataFrame, lines: str = "vertices") -> DataFrame:
    """Adds a and z, the ends of each line rounded to six decimals. Lines of fewer than two points have none."""
    v = F.col(lines)
    node = lambda p: F.struct(G.node_key(p["x"]).alias("x"), G.node_key(p["y"]).alias("y"))
    real = F.size(v) >= 2
    return df.withColumns({"a": F.when(real, node(F.get(v, F.lit(0)))), "z": F.when(real, node(F.element_at(v, -1)))})


def mark_twoway(df: DataFrame, oneway_col: str = "oneway") -> DataFrame:
    """Adds twoway (an edge runs the other way; a loop needs a second loop) and __rs_oneway (the oneway column where it
    is set, else no twin). One aggregate by (a, z), whose rows are then looked up under (z, a)."""
    twin = df.filter("a is not null and z is not null").groupBy(F.col("z").alias("__a"), F.col("a").alias("__z")).agg(F.count("*").alias("__n"))
    out = df.join(twin, (F.col("a") == F.col("__a")) & (F.col("z") == F.col("__z")), "left")
    n = F.coalesce("__n", F.lit(0))
    out = out.withColumn("twoway", F.coalesce(F.when(F.col("a") == F.col("z"), n >= 2).otherwise(n >= 1), F.lit(False))).drop("__a", "__z", "__n")
    if oneway_col in df.columns:
        given = F.when(F.col(oneway_col).isNotNull(), flag_for_web(F.col(oneway_col), df.schema[oneway_col].dataType))
        return out.withColumn("__rs_oneway", F.coalesce(given, ~F.col("twoway")))
    return out.withColumn("__rs_oneway", ~F.col("twoway"))


def node_degree(df: DataFrame) -> DataFrame:
    """(node, degree): edge ends at each node; a loop counts twice."""
    return df.select(F.explode(F.array("a", "z")).alias("node")).filter("node is not null").groupBy("node").agg(F.count("*").alias("degree"))


def twins(df: DataFrame) -> DataFrame:
    """(fid, twin): of edges between the same two nodes, in any direction, the first other one."""
    key = F.struct(F.least("a", "z"), F.greatest("a", "z"))
    edges = df.filter("a is not null and z is not null").select("fid", key.alias("pair"))
    two = edges.groupBy(F.col("pair").alias("p")).agg(F.min("fid").alias("lo"), F.count("*").alias("n")).filter("n > 1")
    second = edges.join(two, F.col("pair") == F.col("p")).filter("fid <> lo").groupBy(F.col("pair").alias("p2")).agg(F.min("fid").alias("next"))
    both = edges.join(two, F.col("pair") == F.col("p")).join(second, F.col("pair") == F.col("p2"))
    return both.select("fid", F.when(F.col("fid") == F.col("lo"), F.col("next")).otherwise(F.col("lo")).alias("twin"))


def representatives(df: DataFrame) -> DataFrame:
    """One edge of each two-way pair."""
    return df.filter("a is not null and z is not null").filter(~(F.col("twoway") & (F.struct("z", "a") < F.struct("a", "z"))))


def continuations(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group..., node, lo, hi): nodes where exactly two different edges of a group meet."""
    ends = df.select(*group, "fid", F.explode(F.array("a", "z")).alias("node"))
    met = ends.groupBy(*group, "node").agg(F.count("*").alias("n"), F.min("fid").alias("lo"), F.max("fid").alias("hi"))
    return met.filter("n = 2 and lo <> hi").drop("n")


def _successors(df: DataFrame, group: Sequence[str], oneway: Column) -> DataFrame:
    """(h, nxt): half-edges. h is twice the fid, plus one against the edge's direction."""
    edges = df.select(*group, "fid", "a", "z", oneway.alias("__oneway_only"))
    forward = edges.select(*group, (2 * F.col("fid")).alias("h"), "fid", F.col("z").alias("head"), "__oneway_only")
    backward = edges.filter(~F.col("__oneway_only")).select(*group, (2 * F.col("fid") + 1).alias("h"), "fid", F.col("a").alias("head"), "__oneway_only")
    half = forward.unionByName(backward)
    node = continuations(df, group).withColumnsRenamed({g: f"__{g}" for g in group})
    on = F.col("head") == F.col("node")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    met = half.join(node, on, "left").withColumn("other", F.col("lo") + F.col("hi") - F.col("fid"))
    start = edges.select(F.col("fid").alias("f2"), F.col("a").alias("a2"))
    # Half-edges that end here look up numbers that no edge has, so that they don't all meet in one task under null.
    found = met.join(start, F.coalesce("other", -1 - F.col("h")) == F.col("f2"), "left")
    nxt = F.when(F.col("a2") == F.col("head"), 2 * F.col("other")).when(~F.col("__oneway_only"), 2 * F.col("other") + 1)
    return found.select("h", nxt.alias("nxt"))


def _ranked(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links: (h, nxt). Half-edges on paths as (h, last, d), d steps before the path's last; those on cycles as (h, nxt, low),
    low the cycle's least."""
    state = cut(links.select("h", "nxt", F.coalesce("nxt", "h").alias("last"), F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("long").alias("d"), F.least("h", "nxt").alias("low")))
    # Only open half-edges look up their next; those that are done wait to be looked up. Were they on the looking side, all of
    # them would meet in one task under null.
    before = None
    while True:
        open_rows = state.filter("nxt is not null")
        now = tuple(open_rows.agg(F.count("*"), F.sum(F.xxhash64("h", "low").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == before:
            break
        before = now
        t = state.select(F.col("h").alias("h2"), F.col("nxt").alias("nxt2"), F.col("last").alias("last2"), F.col("d").alias("d2"), F.col("low").alias("low2"))
        joined = open_rows.join(t, F.col("nxt") == F.col("h2"), "left")
        jump = F.col("h2").isNotNull()
        stepped = joined.select(
            "h",
            F.when(jump, F.col("nxt2")).alias("nxt"),
            F.when(jump, F.col("last2")).otherwise(F.col("last")).alias("last"),
            (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"),
            F.least("low", "low2").alias("low"),
        )
        state = cut(state.filter("nxt is null").unionByName(stepped))
    return state.filter("nxt is null").select("h", "last", "d"), state.filter("nxt is not null").select("h", "low")


def chains(df: DataFrame, group: Sequence[str] = (), oneway: Column | None = None) -> DataFrame:
    """(fid, chain, pos, forward): edges in maximal runs through nodes where just two edges of the group meet.

    chain is the least fid of the run, whose edge runs forward; pos counts from the run's head. Where oneway holds, a run
    follows the edges' directions only. A closed ring starts with its least edge. fid must be unique and not negative.
    """
    with partitions_for(df.sparkSession, df.count()):
        links = cut(_successors(df, group, F.lit(False) if oneway is None else oneway))
        paths, rings = _ranked(links)
        if not rings.isEmpty():
            # Ring by ring the link into its least half-edge goes; then it is a path like any other.
            ring = links.join(rings.withColumnRenamed("h", "hr"), F.col("h") == F.col("hr")).select("h", F.when(F.col("nxt") != F.col("low"), F.col("nxt")).alias("nxt"))
            paths = paths.unionByName(_ranked(ring)[0])
        heads = paths.groupBy(F.col("last").alias("l")).agg(F.min("h").alias("least"), F.max("d").alias("n"))
        both = paths.join(heads, F.col("last") == F.col("l")).filter("least % 2 = 0")
        return cut(both.select(F.floor(F.col("h") / 2).alias("fid"), F.floor(F.col("least") / 2).alias("chain"), (F.col("n") - F.col("d")).alias("pos"), (F.col("h") % 2 == 0).alias("forward")))


def group_mode(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group..., mode): the most frequent value of each group; of equals the one that comes first by fid."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min("fid").alias("first"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"))


def chain_lines(df: DataFrame, of: DataFrame, lines: str = "vertices", extra: Sequence[str] = ()) -> DataFrame:
    """(chain, vertices, parts): the line of each chain and its edges in order. A row holds one chain, so this is for chains
    that are short by nature, such as bridges: over some ten million vertices (2 GB) a row can't be built and the job fails.
    annotation_slots shows how long chains are worked on without being gathered."""
    edges = df.select(F.col("fid").alias("f"), lines, *extra).join(of, F.col("f") == F.col("fid"))
    v = F.when(F.col("forward"), F.col(lines)).otherwise(F.reverse(lines))
    part = F.struct("pos", "fid", "forward", v.alias("v"), *extra)
    whole = edges.groupBy("chain").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    pieces = F.transform("parts", lambda p: F.when(p["pos"] == 0, p["v"]).otherwise(F.slice(p["v"], 2, F.size(p["v"]) - 1)))
    return whole.select("chain", F.flatten(pieces).alias("vertices"), "parts")


def slot_count(total: Column, slot_m: float) -> Column:
    """Slots of a chain: whole ones, and one for a rest of more than 0.3."""
    whole = F.floor(total / slot_m)
    return F.greatest(F.lit(1), (whole + F.when(total - whole * slot_m > slot_m * 0.3, 1).otherwise(0)).cast("int"))


_SLOTS = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("part", T.ArrayType(T.DoubleType()))]))


def _slots_of_edge(slot_m: float) -> Callable[[Column, Column, Column], Column]:
    """What an edge adds to each slot. lines: x0, y0, ... in metres; start: where the edge begins on its chain. All edges of a batch
    at once."""

    @F.arrow_udf(_SLOTS)
    def run(lines: pa.Array, start: pa.Array, slots: pa.Array) -> pa.Array:
        points = lines.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        at, n = start.to_numpy(zero_copy_only=False), slots.to_numpy(zero_copy_only=False).astype(np.int64)
        along = G.distances_of_lines(points, sizes)
        length = np.where(sizes > 0, along[np.maximum(np.cumsum(sizes) - 1, 0)], 0.0) if len(along) else np.zeros(len(sizes))
        first = (at / slot_m).astype(np.int64)
        line, nth = G._each(np.where(sizes > 0, np.maximum(np.minimum(((at + length) / slot_m).astype(np.int64), n - 1) - first + 1, 0), 0))
        slot = first[line] + nth
        a, b = np.maximum(0.0, slot * slot_m - at[line]), np.minimum(length[line], (slot + 1) * slot_m - at[line])
        own = b > a
        line, slot = line[own], slot[own]
        parts, n_points = G.parts_of_lines(points, sizes, along, line, a[own], b[own])
        part = pa.ListArray.from_arrays(G._offsets(2 * n_points), pa.array(parts.ravel()))
        return pa.ListArray.from_arrays(G._offsets(np.bincount(line, minlength=len(sizes))), pa.StructArray.from_arrays([pa.array(slot.astype(np.int32)), part], ["slot", "part"]))

    return run


def annotation_slots(df: DataFrame, slot_m: float = DEFAULT.slot_m, class_col: str = "highway") -> DataFrame:
    """(chain, slot, name, class, oneway, vertices): chains of one name, level and direction cut in slots of slot_m metres.
    Names go to even slots, arrows to odd ones. df needs fid, vertices, a, z, twoway, __rs_oneway, lvl and name.

    A running total along each chain says where an edge begins on it; each edge is cut by itself, and only what lies in
    one slot meets in one row. No chain is gathered whole, however long it is."""
    name = F.nullif(F.col("name"), F.lit("")) if "name" in df.columns else F.lit(None).cast("string")
    reps = cut(representatives(df).select("fid", "vertices", "a", "z", name.alias("name"), F.coalesce("lvl", F.lit(0)).alias("lvl"), F.col("__rs_oneway").alias("oneway"), F.col(class_col).alias("class")))
    group = ["name", "lvl", "oneway"]
    of = chains(reps, group, F.col("oneway"))
    v = F.when(F.col("forward"), F.col("vertices")).otherwise(F.reverse("vertices"))
    edges = cut(reps.withColumnRenamed("fid", "f").join(of, F.col("f") == F.col("fid")).select("chain", "pos", v.alias("v"), *group))
    first = F.get("v", F.lit(0))
    heads = cut(edges.filter("pos = 0").select(F.col("chain").alias("c"), first["x"].alias("lon0"), first["y"].alias("lat0")))
    local = edges.join(heads, F.col("chain") == F.col("c")).select("chain", "pos", "lon0", "lat0", G.flat(G.local_metres(F.col("v"), F.col("lon0"), F.col("lat0"))).alias("m"))
    local = local.withColumn("len", G.length(G.unflat(F.col("m"))))
    placed = cut(running_total(local, "chain", "pos", "len", into="end"))
    totals = cut(placed.groupBy(F.col("chain").alias("c")).agg(slot_count(F.max("end"), slot_m).alias("n")))
    own = placed.join(totals, F.col("chain") == F.col("c")).withColumn("s", F.explode(_slots_of_edge(float(slot_m))("m", F.col("end") - F.col("len"), F.col("n"))))
    parts = own.groupBy("chain", F.col("s.slot").alias("slot")).agg(F.first("lon0").alias("lon0"), F.first("lat0").alias("lat0"), F.array_sort(F.collect_list(F.struct("pos", "s.part"))).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["part"]).otherwise(F.slice(p["part"], 3, F.size(p["part"]) - 2))))
    slots = parts.withColumn("m", G.unflat(joined)).filter(G.length(F.col("m")) >= slot_m * 0.2).drop("parts")
    mode = group_mode(reps, group, "class").withColumnsRenamed({g: f"__{g}" for g in group})
    about = edges.filter("pos = 0").select(F.col("chain").alias("c"), *group)
    about = cut(about.join(mode, F.col("name").eqNullSafe(F.col("__name")) & (F.col("lvl") == F.col("__lvl")) & (F.col("oneway") == F.col("__oneway"))).select("c", "name", "mode", "oneway"))
    return slots.join(about, F.col("chain") == F.col("c")).select("chain", "slot", "name", F.col("mode").alias("class"), F.col("oneway").cast("int").alias("oneway"), G.from_local(F.col("m"), F.col("lon0"), F.col("lat0")).alias("vertices"))


def name_slots(slots: DataFrame) -> DataFrame:
    return slots.filter((F.col("slot") % 2 == 0) & F.col("name").isNotNull())


def arrow_slots(slots: DataFrame) -> DataFrame:
    return slots.filter((F.col("slot") % 2 == 1) & (F.col("oneway") == 1))


# -- bridge decks ---------------------------------------------------------------------------------------------------

_DECK = f"chain long, fid long, kind string, base double, height double, vertices {G.LINE}"


def deck_profile(length: float, ends: Sequence[float], head: bool, tail: bool, ramp: float, step: float) -> list[tuple[float, float, float]]:
    """(from, to, height share) of each slice of a deck: a smooth rise from a ground end, level in between, with cuts where
    edges meet on the level part."""
    rise = min(ramp, length) if head else 0.0
    fall = min(ramp, length - rise) if tail else 0.0
    cuts = {0.0, length, rise, length - fall}
    cuts |= {d for d in np.arange(step, rise, step).tolist()} | {length - d for d in np.arange(step, fall, step).tolist()}
    cuts |= {e for e in ends if rise < e < length - fall}
    out = []
    at = sorted(cuts)
    for a, b in zip(at, at[1:]):
        if b - a > 1e-9:
            mid = (a + b) / 2
            t = min(mid / ramp if head else 1.0, (length - mid) / ramp if tail else 1.0, 1.0)
            out.append((a, b, t * t * (3 - 2 * t)))
    return out


DECK_CHAINS = 256  # whose outlines are made at once


def _decks(settings: Mapping[str, float]):
    ramp, step = max(settings["ramp_m"], 1.0), max(settings["step_m"], 0.25)
    width = lambda kind: width_at(GROUP.get(str(kind or ""), OTHER), settings["match_zoom"])

    def decks_of(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        degrees, sizes = G._from_arrow(batch.column("vertices"))
        first = np.cumsum(sizes) - sizes
        lon0, lat0 = degrees[first].T
        kx = G.DEGREE_M * np.cos(np.radians(lat0))
        points = (degrees - np.repeat(degrees[first], sizes, axis=0)) * np.stack([np.repeat(kx, sizes), np.full(len(degrees), G.DEGREE_M)], axis=1)
        along = G.distances_of_lines(points, sizes)
        pixel = G.PIXEL_M * np.cos(np.radians(lat0)) / 2 ** settings["match_zoom"]
        n_edges, edges = pc.list_value_length(batch.column("parts")).to_numpy(), batch.column("parts").flatten()
        member = lambda name: pc.struct_field(edges, name)
        first_edge = np.cumsum(n_edges) - n_edges
        chain_of, _ = G._each(n_edges)
        # The vertex where an edge ends on its chain's line.
        steps = np.cumsum(member("n").to_numpy() - 1)
        ends = along[first[chain_of] + steps - np.concatenate(([0], steps))[first_edge][chain_of]]

        slices, owner = [], []
        for c, (head, tail) in enumerate(zip(batch.column("head").to_pylist(), batch.column("tail").to_pylist())):
            own = ends[first_edge[c] : first_edge[c] + n_edges[c]]
            found = deck_profile(float(along[first[c] + sizes[c] - 1]), own[:-1].tolist(), head, tail, ramp, step)
            slices += found
            at = np.array([(a + b) / 2 for a, b, _ in found])
            owner.append(first_edge[c] + np.minimum(np.searchsorted(own + 1e-6, at), len(own) - 1))
        start, end, share = np.array(slices, float).reshape(-1, 3).T
        edge = np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64)
        chain = chain_of[edge]
        lines, n_points = G.parts_of_lines(points, sizes, along, chain, start, end)

        kinds = pc.fill_null(member("class"), "").dictionary_encode()
        widths = np.array([width(k) for k in kinds.dictionary.to_pylist()], float)[kinds.indices.to_numpy()]
        half = np.maximum(widths[edge] * pixel[chain] / 2, 2.0) * settings["width_scale"]
        rim = settings["casing_px"] * pixel[chain]
        base = settings["base_m"] * share
        fid, forward = member("fid").to_numpy(zero_copy_only=False)[edge], member("forward").to_numpy(zero_copy_only=False).astype(bool)[edge]
        has_twin = pc.fill_null(pc.and_(member("twoway"), member("twin").is_valid()), False).to_numpy(zero_copy_only=False)[edge]
        twin = pc.fill_null(member("twin"), 0).to_numpy(zero_copy_only=False).astype(np.int64)[edge]
        every = np.arange(len(edge))
        single, double = every[~has_twin], every[has_twin]
        # (which slices, the owner, how far to the left, half the width) of each kind of ribbon.
        ribbons = [(single, fid, 0 * half, half, "deck"), (double, np.where(forward, fid, twin), -half / 2, half / 2, "deck"), (double, np.where(forward, twin, fid), half / 2, half / 2, "deck")]
        if settings["casing_px"]:
            ribbons += [(every, fid, side * (half + rim / 2), rim / 2, "casing") for side in (1.0, -1.0)]
        out = []
        n_first = np.cumsum(n_points) - n_points
        for of, whose, shift, wide, kind in ribbons:
            line, nth = G._each(n_points[of])
            shifted, n = G.offset_lines(lines[n_first[of][line] + nth], n_points[of], shift[of])
            ring, n = G.buffer_lines(shifted, n, wide[of])
            kept = G.are_simple(ring, n) & (n > 0)
            ring = ring[np.repeat(kept, n)]
            of, n = of[kept], n[kept]
            c = np.repeat(chain[of], n)
            ring = np.stack([ring[:, 0] / kx[c] + lon0[c], ring[:, 1] / G.DEGREE_M + lat0[c]], axis=1).round(6)
            low, high = (base[of], base[of] + settings["thickness_m"]) if kind == "deck" else (np.maximum(base[of] - 0.5, 0.0), base[of] + settings["thickness_m"] * 0.35)
            rounded = lambda v: pa.array([round(x, 2) for x in v.tolist()], pa.float64())
            columns = [batch.column("chain").take(pa.array(chain[of])), pa.array(whose[of].astype(np.int64)), pa.array([kind] * len(of), pa.string()), rounded(low), rounded(high), G._to_arrow(ring, n)]
            out.append(pa.record_batch(columns, ["chain", "fid", "kind", "base", "height", "vertices"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, DECK_CHAINS):
                yield from decks_of(batch.slice(a, DECK_CHAINS))

    return run


def bridge_decks(df: DataFrame, settings: Mapping[str, float] = DEFAULT.decks, class_col: str = "highway") -> DataFrame:
    """(chain, fid, kind, base, height, vertices): bridges as outlines with heights. Each deck slice belongs to one directed
    edge; a two-way bridge has a half-width ribbon for each direction. Ends where no other bridge goes on slope to the ground.

    Chains are set-based, as for slots; the numpy step gets one row for each chain of bridges, see chain_lines. A slice whose
    outline crosses itself, which no bridge has that is wider than its bends are tight, is left out."""
    bridges = df.filter("lvl >= 1 and a is not null and z is not null")
    pair = twins(bridges).withColumnRenamed("fid", "f")
    reps = representatives(bridges).join(pair, F.col("fid") == F.col("f"), "left").drop("f")
    reps = cut(reps.select("fid", "vertices", "a", "z", F.col("twoway"), "twin", F.col(class_col).alias("class")))
    of = chains(reps)
    lines = chain_lines(reps, of, extra=("class", "twoway", "twin"))
    degree = node_degree(reps)
    ends = of.join(reps.select(F.col("fid").alias("f"), "a", "z"), F.col("fid") == F.col("f"))
    node = lambda first: F.when(F.col("forward") == first, F.col("a")).otherwise(F.col("z"))
    tips = ends.groupBy("chain").agg(F.min_by(node(True), "pos").alias("n1"), F.max_by(node(False), "pos").alias("n2"))
    one = degree.filter("degree = 1").select(F.col("node").alias("g"))
    tips = tips.join(one, F.col("n1") == F.col("g"), "left").withColumn("head", F.col("g").isNotNull()).drop("g")
    tips = tips.join(one, F.col("n2") == F.col("g"), "left").withColumn("tail", F.col("g").isNotNull()).select(F.col("chain").alias("c"), "head", "tail")
    edges = F.transform("parts", lambda p: F.struct(p["fid"].cast("long").alias("fid"), p["forward"].alias("forward"), F.size(p["v"]).cast("long").alias("n"), p["class"].alias("class"), p["twoway"].alias("twoway"), p["twin"].cast("long").alias("twin")))
    rows = lines.join(tips, F.col("chain") == F.col("c")).select(F.col("chain").cast("long").alias("chain"), "vertices", edges.alias("parts"), "head", "tail")
    return rows.mapInArrow(_decks(dict(settings)), _DECK)
