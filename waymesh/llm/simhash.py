"""SimHash near-duplicates, found by an anchor-point covering.

A fingerprint has 64 bits, in blocks A, B (23 bits each) and C (18 bits, padded to 23 by zeros). The anchors of a
block are the 4,096 words of the binary Golay code, which is perfect: each 23-bit value is within covering radius 3
of exactly one anchor, its home, and within 4 (radius plus 1) of about five, which it visits. So values that differ in one
bit meet at each other's homes, and values that differ in two meet at the home of the value between them.

A fingerprint is copied, for each pair of blocks, to (home in the one, every visited anchor in the other), both ways round.
If two fingerprints differ in at most 4 bits, they meet at such a key:
  - a block agrees: its home is shared, and one of the other two blocks differs in at most 2 bits, so a visited anchor is;
  - no block agrees: of three blocks with a difference each, two differ in exactly one bit; the home of the one fingerprint
    in the first block is visited by the other there, and the other way round in the second block.
That is about 32 keys for a fingerprint, whatever the corpus's size, out of 3 * 2**24. Equal fingerprints are one class from
the start. Within a key fingerprints are compared with each other, and only enough links are emitted to span what is linked.
A key with more than CELL rows isn't compared in one task: its rows are dealt into blocks, and each pair of blocks is a
task of its own.

near_components links by one fingerprint of word shingles. drop_near_copies looks for similarity of 0.8 or more on
five-word shingles, where such a fingerprint differs in ten bits: there, VIEWS fingerprints of the set of words find who is
compared, and a sketch of SKETCH bits of the five-word shingles, which goes with each copy, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymesh.llm.common import cut, documents, id_type
from waymesh.llm.components import components

SHINGLE = 4
NEAR_SHINGLE = 5
SEED = 42
THRESHOLD = 4
CELL = 20_000
SMALL = 32
VIEWS = 4
SKETCH = 128
#: Bits in which sketches of near copies may differ. At a similarity of 0.8 they differ in 19 on average, with a deviation of
#: 4; at 0.6 in 30, at 0.3 in 45, at 0 in 64. So nearly all pairs of 0.8 or more are linked, some between 0.6 and 0.8, and
#: hardly any below.
SKETCH_THRESHOLD = 26
BLOCKS = ((0, 23), (23, 23), (46, 18))
_GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1: the binary Golay code's generator polynomial


# -- fingerprints ---------------------------------------------------------------------------------------------------


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `size` words, or of all words where there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-size])]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprints(texts: list[str], size: int = SHINGLE) -> np.ndarray:
    """A bit is 1 if it is set in over half the shingle hashes, repeats included; zero for no words."""
    return majority([shingle_hashes(t, size) for t in texts])


def majority(each: list[list[int]]) -> np.ndarray:
    """Of each list of 64-bit hashes the bits that are set in over half of them; zero for none."""
    counts = np.array([len(h) for h in each], np.int64)
    full = np.flatnonzero(counts)
    out = np.zeros(len(each), np.uint64)
    if not len(full):
        return out
    hashes = np.fromiter((x for h in each for x in h), np.uint64, int(counts.sum()))
    first = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    # Eight byte-wide counters in a word, for runs of at most 255 hashes.
    runs = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(first, counts[full])])
    run_of = np.searchsorted(runs, first)
    ones = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & ones, runs).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums, run_of, axis=0, dtype=np.int64)
        for byte in range(8):
            out[full] |= (2 * total[:, byte] > counts[full]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def sketches(texts: list[str], size: int = NEAR_SHINGLE) -> np.ndarray:
    """n x (VIEWS + SKETCH / 64): fingerprints of the set of words, one for each 64 bits of its hashes, then the sketch of
    the set of shingles of `size` words."""
    digest, low = xxhash.xxh3_128_intdigest, (1 << 64) - 1
    features: list[list[list[int]]] = [[] for _ in range(VIEWS + SKETCH // 64)]
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        shingles = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
        hashes = [[digest(w, seed) for w in set(words)] for seed in range(VIEWS // 2)] + [[digest(x, SEED) for x in shingles]]
        for i, h in enumerate(hashes):
            features[2 * i].append([x & low for x in h])
            features[2 * i + 1].append([x >> 64 for x in h])
    return np.stack([majority(f) for f in features], axis=1)


def _fingerprinter(size: int, id_arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            parts = [fingerprints(texts.slice(i, 200).to_pylist(), size) for i in range(0, len(texts), 200)]
            found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.record_batch([batch.column("doc_id").cast(id_arrow), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def _sketcher(size: int, id_arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            parts = [sketches(texts.slice(i, 100).to_pylist(), size) for i in range(0, len(texts), 100)]
            found = np.concatenate(parts) if parts else np.zeros((0, len(_DATA)), np.uint64)
            yield pa.record_batch([batch.column("doc_id").cast(id_arrow), *(pa.array(c.view(np.int64)) for c in np.ascontiguousarray(found.T))], ["doc_id", *_DATA])

    return run


_DATA = [*(f"f{i}" for i in range(VIEWS)), *(f"s{i}" for i in range(SKETCH // 64))]


# -- the covering code ----------------------------------------------------------------------------------------------


def _remainder(value: int) -> int:
    for bit in range(22, 10, -1):
        if value >> bit & 1:
            value ^= _GENERATOR << (bit - 11)
    return value


class Golay:
    """Syndromes of 23-bit values; a codeword's upper 12 bits name it."""

    def __init__(self) -> None:
        self.high = np.array([_remainder(h << 11) for h in range(1 << 12)], np.int64)
        patterns: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                pattern = sum(1 << b for b in bits)
                patterns[int(self.syndrome(np.array([pattern]))[0])].append(pattern)
        self.leader = np.array([p[0] for p in patterns], np.int64)  # the one of weight 3 or less
        most = max(map(len, patterns))
        self.count = np.array([len(p) for p in patterns])
        self.near = np.array([p + [0] * (most - len(p)) for p in patterns], np.int64)

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        return self.high[values >> 11] ^ (values & 0x7FF)

    def home(self, values: np.ndarray) -> np.ndarray:
        return (values ^ self.leader[self.syndrome(values)]) >> 11

    def visits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the value, anchor) for each anchor within 4 bits of a value."""
        s = self.syndrome(values)
        anchors = (values[:, None] ^ self.near[s]) >> 11
        real = np.arange(self.near.shape[1])[None, :] < self.count[s][:, None]
        return np.nonzero(real)[0], anchors[real]


def keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for each key that a fingerprint is copied to; a key may come twice."""
    blocks = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in BLOCKS]
    homes = [code.home(b) for b in blocks]
    visits = [code.visits(b) for b in blocks]
    index, key = [], []
    for table, (i, j) in enumerate(combinations(range(len(blocks)), 2)):
        who, anchor = visits[j]
        index.append(who)
        key.append(table << 24 | homes[i][who] << 12 | anchor)
        who, anchor = visits[i]
        index.append(who)
        key.append(table << 24 | anchor << 12 | homes[j][who])
    return np.concatenate(index), np.concatenate(key)


def _copier(views: int, sketch: int):
    """node, f0 .., s0 .. once for each view and key: key, node, fp (of the view), s0 .."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            carried = np.stack([get("node"), *(get(f"s{i}") for i in range(sketch))])
            for view in range(views):
                fps = get(f"f{view}")
                for at in range(0, len(fps), 8000):
                    index, key = keys(fps[at : at + 8000].view(np.uint64), code)
                    pair = np.unique(key << 13 | index)
                    index = at + (pair & 0x1FFF)
                    yield pa.record_batch([pa.array(view << 26 | pair >> 13), pa.array(carried[0][index]), pa.array(fps[index]), *(pa.array(c[index]) for c in carried[1:])], ["key", "node", "fp", *(f"s{i}" for i in range(sketch))])

    return run


# -- comparison within a key ----------------------------------------------------------------------------------------
# Rows of a key are an array of int64 with the columns node, fingerprint and the words of the sketch, if there is one.


def close(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Which rows of a are linked with those of b (as many, or one)."""
    differ = (a ^ b)[..., 1:].view(np.uint64)
    near = np.bitwise_count(differ[..., 0]) <= threshold
    return near & (np.bitwise_count(differ[..., 1:]).sum(axis=-1) <= SKETCH_THRESHOLD) if differ.shape[-1] > 1 else near


def small_links(key: np.ndarray, rows: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Spanning links within each key, for keys of at most SMALL rows; rows are sorted by key."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.get(i, i) != i:
            root[i] = root.get(root[i], root[i])
            i = root[i]
        return i

    out = []
    for step in range(1, min(SMALL, len(key))):
        same = np.flatnonzero(key[:-step] == key[step:])
        if not len(same):
            break
        for i in same[close(rows[same], rows[same + step], threshold)].tolist():
            a, b = find(i), find(i + step)
            if a != b:
                root[b] = a
                out.append((int(rows[i, 0]), int(rows[i + step, 0])))
    return out


def large_links(rows: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """The same for the rows of one key; plain fingerprints may be given. Every row outside the largest component is
    compared with all rows; a row inside it needs no comparison of its own, as a link to the outside is found from there."""
    rows = np.unique(rows if rows.ndim == 2 else np.stack([rows, rows], axis=1), axis=0)
    fps = np.ascontiguousarray(rows[:, 1]).view(np.uint64)
    bits = (fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    middle = np.bitwise_or.reduce((2 * bits.sum(0) > len(fps)).astype(np.uint64) << np.arange(64, dtype=np.uint64))
    label, done = np.arange(len(fps)), np.zeros(len(fps), bool)
    i = largest = int(np.bitwise_count(fps ^ middle).argmin())
    while True:
        done[i] = True
        met = np.unique(label[close(rows, rows[i], threshold)])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
        open_rows = np.flatnonzero(~done)
        if len(met) > 1:
            largest = int(np.bincount(label).argmax())
        rest = open_rows[label[open_rows] != largest]
        if not len(rest):
            break
        i = int(rest[0])
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return list(zip(rows[label[linked], 0].tolist(), rows[linked, 0].tolist()))


def _edges_of(key: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    if not len(key):
        return []
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    out = []
    for a, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        out += large_links(rows[a : a + n])
    few = np.repeat((size > 1) & (size <= SMALL), size)
    return out + small_links(key[few], rows[few])


def _comparer(limit: int | None, names: list[str]):
    """Rows come sorted by key. Out: links (key null, node and fp the linked nodes), and all rows of keys with more than
    limit rows as they are."""

    def emit(links: list, over: list) -> Iterator[pa.RecordBatch]:
        if links:
            ends = [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)]
            yield pa.record_batch([pa.nulls(len(links), pa.int64()), *ends, *(pa.nulls(len(links), pa.int64()) for _ in names[2:])], ["key", *names])
        for key, rows in over:
            yield pa.record_batch([pa.array(np.full(len(rows), key)), *(pa.array(c) for c in np.ascontiguousarray(rows.T))], ["key", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, spilling = np.zeros(0, np.int64), np.zeros((0, len(names)), np.int64), None
        for batch in batches:
            key = np.concatenate([held_key, batch.column("key").to_numpy(zero_copy_only=False)])
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)])
            over = []
            if spilling is not None:
                n = int(np.searchsorted(key, spilling, "right"))
                over.append((spilling, rows[:n]))
                key, rows = key[n:], rows[n:]
                spilling = spilling if not len(key) else None
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if limit is not None and len(key):
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                size = np.diff(np.concatenate((first, [len(key)])))
                drop = np.zeros(len(key), bool)
                for a, n in zip(first[size > limit].tolist(), size[size > limit].tolist()):
                    over.append((int(key[a]), rows[a : a + n]))
                    drop[a : a + n] = True
                    if a == last:
                        spilling = int(key[a])
                links = _edges_of(key[:last][~drop[:last]], rows[:last][~drop[:last]])
                held_key, held = key[last:][~drop[last:]], rows[last:][~drop[last:]]
            else:
                links = _edges_of(key[:last], rows[:last])
                held_key, held = key[last:], rows[last:]
            yield from emit(links, over)
        yield from emit(_edges_of(held_key, held), [])

    return run


def near_edges(classes: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (u, v) that span the same components as all linked pairs. classes: distinct fp (long), which are then their own
    nodes; or node with f0, f1, ... and the sketch in s0, s1, ..."""
    if "node" not in classes.columns:
        classes = classes.select(F.col("fp").alias("node"), F.col("fp").alias("f0"))
    views, sketch = (sum(c[0] == kind and c[1:].isdigit() for c in classes.columns) for kind in "fs")
    names = ["node", "fp", *(f"s{i}" for i in range(sketch))]
    schema = ", ".join(f"{c} long" for c in ("key", *names))
    copies = classes.mapInArrow(_copier(views, sketch), schema)
    dealt = copies.repartition("key").sortWithinPartitions("key")
    found = cut(dealt.mapInArrow(_comparer(cell, names), schema))
    over = found.filter("key is not null")
    counts = over.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks"))
    split = over.join(counts, F.col("key") == F.col("k")).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = pairs.select(F.xxhash64("key", F.least("b", "other"), F.greatest("b", "other")).alias("key"), *names)
    second = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_comparer(None, names), schema)
    both = found.filter("key is null").unionByName(second)
    return both.select(F.col("node").alias("u"), F.col("fp").alias("v"))


def _named(rows: DataFrame, node: str, classes: DataFrame) -> DataFrame:
    """rows with component_id, the smallest doc_id of the node's component. classes: distinct nodes with least_id and what
    near_edges needs."""
    roots = components(near_edges(classes.drop("least_id")))
    placed = cut(classes.join(roots, F.col(node) == F.col("u"), "left").select(node, "least_id", F.coalesce("v", node).alias("root")))
    named = cut(placed.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("component_id")))  # apart from the join, which may split a large component
    of_class = placed.join(named, F.col("root") == F.col("r")).select(F.col(node).alias("f"), "component_id")
    return rows.join(of_class, F.col(node) == F.col("f"))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id (the smallest doc_id reachable over links).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Null ids are never a component's
    name unless all its ids are null. Repeated rows each get their row; an empty table gives an empty result. Columns
    beyond id and text are ignored.
    """
    docs = documents(df, id_col, text_col)
    kind = id_type(df, id_col)
    rows = cut(docs.mapInArrow(_fingerprinter(size, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, fp long"))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    return _named(rows, "fp", classes).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = NEAR_SHINGLE) -> DataFrame:
    """One row per input row: doc_id, component_id, by the sketch of five-word shingles (see drop_near_copies)."""
    docs = documents(df, id_col, text_col)
    kind = id_type(df, id_col)
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _DATA)
    rows = cut(docs.mapInArrow(_sketcher(size, to_arrow_type(kind)), schema).withColumn("node", F.xxhash64(*_DATA)))
    classes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), *[F.min(c).alias(c) for c in _DATA]))
    return _named(rows.select("doc_id", "node"), "node", classes).select("doc_id", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component of near copies, that with the smallest id. Rows without an id are all kept.

    Near copies have a similarity of 0.8 or more on five-word shingles, as their sketches estimate it: they differ in at most
    SKETCH_THRESHOLD of SKETCH bits. Two documents are compared if one of VIEWS fingerprints of their sets of words
    differs in at most 4 bits. Null, empty and blank texts are copies of each other; repeated rows of one id are kept or
    dropped together; an empty table gives an empty result; all columns stay.
    """
    found = near_copies(df, id_col, text_col)
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias("__id")).distinct()
    return df.join(gone, df[id_col] == gone["__id"], "left_anti")
