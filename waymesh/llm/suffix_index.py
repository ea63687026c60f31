"""Removal of long repeated byte strings, by a logarithmic family of suffix arrays.

A string of LENGTH bytes that starts at two places has the same least KGRAM-byte gram at the same offset in both. So
the corpus is cut where the least gram (in a fixed hash order, the leftmost if tied) of the sliding window changes:
each piece holds the windows that share one anchor, and equal windows lie in pieces with equal anchor hashes. Pieces
are small rows (hash of the anchor, hash of the piece, where it is), about one for 85 bytes:

1. Anchors that occur once are dropped by a partial aggregation and a join that adaptive execution may split.
2. Equal pieces are counted, which settles all their windows; one of each is kept.
3. Different pieces under one anchor go to the index: their text is fetched from the documents, dealt by the anchor,
   and each task keeps a family of suffix arrays whose sizes double. A new batch gets its suffix array, is
   merge-scanned against the levels there are for matches of LENGTH bytes, and levels of equal size merge.
   An anchor with more than HOT different pieces is hot: its pieces are cut again, by longer grams, and 2. and 3. are
   repeated with what comes out. Windows that share a piece move together, so rows stay few. What is still hot after
   RECUTS rounds is dealt window by window, by a hash of the content, and those that share one are compared by the
   SHA-256 of their bytes.
4. Repeated windows return to the documents by a join on the piece; a document's text and its ranges meet by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymesh.llm.bytehash import Hasher
from waymesh.llm.common import cut, documents, id_type, same_doc, with_text_hash

LENGTH = 200
KGRAM = 32
HOT = 512
RECUTS = 3  # rounds of longer grams; each halves what they are short of LENGTH
CHUNK = 1 << 19
BATCH = 1 << 15  # windows in the smallest level of an index
FAMILY = 1 << 16  # windows beyond which an index is closed at the next change of the anchor
_GRAM = Hasher(201)
_PIECE = Hasher(202)
_POS = np.uint64((1 << 20) - 1)


def pieces(texts: list[bytes], length: int = LENGTH, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """Of all texts: (text's index, start, number of windows, anchor hash, piece hash), one row for each piece."""
    out = []
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for i, data in enumerate(texts):
        for at in range(0, max(len(data) - length + 1, 0), CHUNK):
            part = data[at : at + CHUNK + length - 1]
            if size + len(part) > 1 << 20:
                out.append(_pieces(group, length, k))
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        out.append(_pieces(group, length, k))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*out))


def _pieces(group: list[tuple[int, int, bytes]], length: int, k: int) -> tuple[np.ndarray, ...]:
    buffer = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    sizes = np.array([len(p) for _, _, p in group])
    ends = np.cumsum(sizes)
    grams = _GRAM.grams(_GRAM.prefix(buffer), k)
    order = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    width, least, span = length - k + 1, order, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    anchor = (least & _POS).astype(np.int64)
    room = np.ones(len(anchor), bool)
    for e in ends[:-1].tolist():
        room[e - length + 1 : e] = False
    at = np.flatnonzero(room)
    new = np.concatenate(([True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    start, count = at[first], np.diff(np.concatenate((first, [len(at)])))
    prefix = _PIECE.prefix(buffer)
    piece = _PIECE.spans(prefix, start, start + count - 1 + length)
    where = np.searchsorted(ends, start, "right")
    index = np.array([i for i, _, _ in group])[where]
    offset = np.array([a for _, a, _ in group])[where] - (ends - sizes)[where]
    return index, start + offset, count, grams[anchor[start]].view(np.int64), piece.view(np.int64)


def _cutter(length: int, k: int, id_arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                index, start, count, anchor, piece = pieces(texts, length, k)
                pick = pa.array(index)
                yield pa.record_batch(
                    [pa.array(anchor), pa.array(piece), part.column("doc_id").take(pick).cast(id_arrow), part.column("th").take(pick), pa.array(start), pa.array(count.astype(np.int32))],
                    ["anchor", "piece", "doc_id", "th", "start", "n"],
                )

    return run


# -- the index ------------------------------------------------------------------------------------------------------


@dataclass
class Level:
    """A suffix array over text, of the suffixes that start a window, in the order of their first `length` bytes."""

    text: np.ndarray
    order: np.ndarray  # starts of windows
    owner: np.ndarray  # of each window, the place of its flag
    length: int

    def keys(self, a: int, b: int) -> np.ndarray:
        windows = np.ndarray((len(self.text) - self.length + 1,), f"S{self.length}", self.text, 0, (1,))
        return windows[self.order[a:b]]


def locate(new: Level, old: Level, block: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Merge-scan: for each suffix of new its place in old, and whether an equal window stands there."""
    place, equal = np.zeros(len(new.order), np.int64), np.zeros(len(new.order), bool)
    bounds = [(a, min(a + block, len(old.order))) for a in range(0, len(old.order), block)]
    for a in range(0, len(new.order), block):
        mine = new.keys(a, a + block)
        done = 0
        for lo, hi in bounds:
            if done == len(mine):
                break
            theirs = old.keys(lo, hi)
            upto = len(mine) if hi == len(old.order) else int(np.searchsorted(mine, theirs[-1], "right"))
            if upto > done:
                found = np.searchsorted(theirs, mine[done:upto])
                place[a + done : a + upto] = lo + found
                equal[a + done : a + upto] = (found < len(theirs)) & (theirs[np.minimum(found, len(theirs) - 1)] == mine[done:upto])
                done = upto
    return place, equal


def merge(a: Level, b: Level, place: np.ndarray) -> Level:
    """place: of a's suffixes in b."""
    at = place + np.arange(len(a.order))
    total = len(a.order) + len(b.order)
    of_a = np.zeros(total, bool)
    of_a[at] = True
    order, owner = np.empty(total, np.int64), np.empty(total, np.int64)
    order[of_a], order[~of_a] = a.order + len(b.text), b.order
    owner[of_a], owner[~of_a] = a.owner, b.owner
    return Level(np.concatenate([b.text, a.text]), order, owner, a.length)


@dataclass
class IndexFamily:
    """Suffix arrays of geometrically growing size over all pieces seen so far; repeated windows are flagged."""

    length: int = LENGTH
    levels: list[Level] = field(default_factory=list)
    flags: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, bool))
    seen: int = 0

    def add(self, texts: list[bytes]) -> None:
        """A batch of pieces. Their windows get the next flags, in order."""
        sizes = np.array([len(t) - self.length + 1 for t in texts], np.int64)
        total = int(sizes.sum())
        if not total:
            return
        while self.seen + total > len(self.flags):
            self.flags = np.concatenate([self.flags, np.zeros(len(self.flags), bool)])
        text = np.frombuffer(b"".join(texts), np.uint8)
        first = np.cumsum([0, *(len(t) for t in texts[:-1])])
        starts = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total)
        level = Level(text, starts, self.seen + np.arange(total), self.length)
        keys = level.keys(0, total)
        rank = np.argsort(keys, kind="stable")
        level.order, level.owner, keys = level.order[rank], level.owner[rank], keys[rank]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        self.flags[level.owner[same]] = self.flags[level.owner[same + 1]] = True
        self.seen += total
        places = []
        for old in self.levels:
            place, equal = locate(level, old)
            self.flags[level.owner[equal]] = True
            self.flags[old.owner[place[equal]]] = True
            places.append(place)
        while self.levels and len(self.levels[-1].order) < 2 * len(level.order):
            old = self.levels.pop()
            level = merge(level, old, places.pop() if places else locate(level, old)[0])
            places = []
        self.levels.append(level)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def _indexer(length: int, most: int = FAMILY):
    """Rows come sorted by anchor. Out: for each piece the ranges of windows that occur in another piece.

    Pieces of different anchors have no window in common, so a family that has grown beyond `most` windows is closed
    at the next change of the anchor, and memory stays bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows, waiting, size, anchor_before = IndexFamily(length), [], [], 0, None

        def close() -> Iterator[pa.RecordBatch]:
            if waiting:
                family.add(waiting)
            out, at = [], 0
            for anchor, piece, n in rows:
                lo, hi = _runs(family.flags[at : at + n])
                out += [(anchor, piece, a, b) for a, b in zip(lo.tolist(), hi.tolist())]
                at += n
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "piece", "lo", "hi"])

        for batch in batches:
            for anchor, piece, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "data"))):
                if family.seen > most and anchor != anchor_before:
                    yield from close()
                    family, rows, waiting, size = IndexFamily(length), [], [], 0
                anchor_before = anchor
                rows.append((anchor, piece, len(data) - length + 1))
                waiting.append(data)
                size += len(data) - length + 1
                if size >= BATCH:
                    family.add(waiting)
                    waiting, size = [], 0
        yield from close()

    return run


def _window_hashes(length: int):
    """Each window of a piece by a hash of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, piece, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "data"))):
                h = _PIECE.grams(_PIECE.prefix(np.frombuffer(data, np.uint8)), length).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(h), anchor)), pa.array(np.full(len(h), piece)), pa.array(np.arange(len(h))), pa.array(h)], ["anchor", "piece", "lo", "h"])

    return run


def _window_digests(length: int):
    """Some windows of a piece by the SHA-256 of their bytes. los: where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, piece, data, los in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "data", "los"))):
                digests = [hashlib.sha256(data[lo : lo + length]).digest() for lo in los]
                yield pa.record_batch([pa.array(np.full(len(los), anchor)), pa.array(np.full(len(los), piece)), pa.array(los, pa.int64()), pa.array(digests, pa.binary())], ["anchor", "piece", "lo", "digest"])

    return run


def _window_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows side by side as one range. los: where the windows of a piece start."""
    for batch in batches:
        out = []
        for anchor, piece, los in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "los"))):
            at = np.sort(np.array(los, np.int64))
            edge = np.flatnonzero(np.diff(at) > 1)
            out += [(anchor, piece, lo, hi + 1) for lo, hi in zip(at[np.concatenate(([0], edge + 1))].tolist(), at[np.concatenate((edge, [len(at) - 1]))].tolist())]
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "piece", "lo", "hi"])


def _recutter(length: int, k: int):
    """Pieces cut again where the least gram of k bytes changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                texts = part.column("data").to_pylist()
                index, start, count, anchor, piece = pieces(texts, length, k)
                pick = pa.array(index)
                data = [texts[i][s : s + n - 1 + length] for i, s, n in zip(index.tolist(), start.tolist(), count.tolist())]
                yield pa.record_batch(
                    [part.column("anchor").take(pick), part.column("piece").take(pick), pa.array(start), pa.array(count), pa.array(anchor), pa.array(piece), pa.array(data, pa.binary())],
                    ["of_anchor", "of_piece", "start", "n", "anchor", "piece", "data"],
                )

    return run


# -- the whole ------------------------------------------------------------------------------------------------------


_RANGES = "anchor long, piece long, lo long, hi long"


def _fetcher():
    """The bytes of the pieces that a document stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                anchor, piece, hot, data = [], [], [], []
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    for w in wanted:
                        anchor.append(w["anchor"])
                        piece.append(w["piece"])
                        hot.append(w["hot"])
                        data.append(raw[w["start"] : w["start"] + w["size"]])
                yield pa.record_batch([pa.array(anchor, pa.int64()), pa.array(piece, pa.int64()), pa.array(hot, pa.bool_()), pa.array(data, pa.binary())], ["anchor", "piece", "hot", "data"])

    return run


def _different(each: DataFrame, hot: int) -> DataFrame:
    """The pieces that share their anchor with different ones. hot: whether with more than that many."""
    several = cut(each.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("c")).filter("c > 1"))
    return each.join(several, F.col("anchor") == F.col("a")).withColumn("hot", F.col("c") > hot)


def _index_ranges(texts: DataFrame, length: int, k: int, hot: int, recuts: int = RECUTS) -> DataFrame:
    """texts: anchor, piece, hot, data, of different pieces. (anchor, piece, lo, hi): their windows that occur in another piece."""
    cold = texts.filter(~F.col("hot")).select("anchor", "piece", "data").repartition("anchor").sortWithinPartitions("anchor", "piece")
    ranges = cold.mapInArrow(_indexer(length), _RANGES)
    hot_texts = texts.filter("hot").select("anchor", "piece", "data")
    if hot_texts.isEmpty():
        return ranges
    if not recuts:
        return ranges.unionByName(_window_ranges(hot_texts, length))
    k = (k + length) // 2
    rows = cut(hot_texts.mapInArrow(_recutter(length, k), "of_anchor long, of_piece long, start long, n long, anchor long, piece long, data binary"))
    each = cut(rows.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.min("data").alias("data")))
    whole = each.filter("copies > 1").select("anchor", "piece", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))
    texts = cut(_different(each, hot).select("anchor", "piece", "hot", "data"))
    found = whole.unionByName(_index_ranges(texts, length, k, hot, recuts - 1)).select(F.col("anchor").alias("a"), F.col("piece").alias("p"), "lo", "hi")
    again = rows.join(found, (F.col("anchor") == F.col("a")) & (F.col("piece") == F.col("p")))
    return ranges.unionByName(again.select(F.col("of_anchor").alias("anchor"), F.col("of_piece").alias("piece"), (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")))


def _window_ranges(texts: DataFrame, length: int) -> DataFrame:
    """The same, by the windows' content. texts: anchor, piece, data."""
    windows = texts.mapInArrow(_window_hashes(length), "anchor long, piece long, lo long, h long")
    met = cut(windows.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("c")).filter("c > 1").select("g"))
    places = windows.join(met, F.col("h") == F.col("g"), "left_semi").groupBy(F.col("anchor").alias("a"), F.col("piece").alias("p")).agg(F.collect_list("lo").alias("los"))  # at most one for each offset in a piece
    digests = cut(texts.join(places, (F.col("anchor") == F.col("a")) & (F.col("piece") == F.col("p"))).select("anchor", "piece", "data", "los").mapInArrow(_window_digests(length), "anchor long, piece long, lo long, digest binary"))
    twice = cut(digests.groupBy(F.col("digest").alias("g")).agg(F.count("*").alias("c")).filter("c > 1").select("g"))
    found = digests.join(twice, F.col("digest") == F.col("g"), "left_semi").groupBy("anchor", "piece").agg(F.collect_list("lo").alias("los"))
    return found.mapInArrow(_window_runs, _RANGES)


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", length: int = LENGTH, k: int = KGRAM, hot: int = HOT) -> DataFrame:
    """docs: doc_id, text, th. (doc_id, th, ranges): where strings of `length` bytes start that also start elsewhere,
    as byte ranges to remove; documents without any are missing."""
    kind = id_type(docs)
    schema = f"anchor long, piece long, doc_id {kind.simpleString()}, th long, start long, n int"
    rows = docs.select("doc_id", "text", "th").mapInArrow(_cutter(length, k, to_arrow_type(kind)), schema)
    # What an aggregate finds is kept apart from the join that uses it, so that a hot anchor can be split there.
    often = cut(rows.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("c")).filter("c > 1").select("a"))
    rows = cut(rows.join(often, F.col("anchor") == F.col("a"), "left_semi"))

    each = cut(rows.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "start", "n")).alias("at")))
    whole = each.filter("copies > 1").select("anchor", "piece", F.lit(0).cast("long").alias("lo"), F.col("at.n").cast("long").alias("hi"))
    wanted = _different(each, hot).select(
        F.col("at.doc_id").alias("doc_id"),
        F.col("at.th").alias("th"),
        F.struct("anchor", "piece", "hot", F.col("at.start").alias("start"), (F.col("at.n") - 1 + length).alias("size")).alias("w"),
    )
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list("w").alias("wanted"))
    texts = cut(docs.join(wanted, same_doc(docs, wanted)).select("text", "wanted").mapInArrow(_fetcher(), "anchor long, piece long, hot boolean, data binary"))
    found = whole.unionByName(_index_ranges(texts, length, k, hot)).select(F.col("anchor").alias("a"), F.col("piece").alias("p"), "lo", "hi")
    spans = rows.join(found, (F.col("anchor") == F.col("a")) & (F.col("piece") == F.col("p"))).select("doc_id", "th", F.struct((F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") - 1 + length).alias("b")).alias("r"))
    return spans.groupBy("doc_id", "th").agg(F.collect_list("r").alias("ranges"))


def _union(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remover(id_arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                out = []
                for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    gone = _union(ranges or [])
                    kept, done = [], 0
                    for lo, hi in gone:
                        kept.append(raw[done:lo])
                        done = hi
                    rest = b"".join([*kept, raw[done:]])
                    out.append((len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest))
                n_bytes, n_removed, n_spans, digest, rest = zip(*out) if out else ([],) * 5
                yield pa.record_batch(
                    [part.column("doc_id").cast(id_arrow), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(rest, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
                )

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = KGRAM, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes.

    Each byte goes that a string of `length` bytes covers which also starts anywhere else, the same document included.
    Null text counts as empty; texts under `length` bytes stay as they are. Repeated rows are copies of each other, so
    they go as far as they are long enough. Null ids are allowed; an empty table gives an empty result. Columns beyond id
    and text are ignored.
    """
    docs = with_text_hash(documents(df, id_col, text_col))
    kind = id_type(df, id_col)
    spans = repeated_ranges(docs, id_col, length, k, hot).withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    both = docs.join(spans, docs.doc_id.eqNullSafe(spans["__id"]) & (docs.th == spans["__th"]), "left").select("doc_id", "text", "ranges")
    schema = f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
    return both.mapInArrow(_remover(to_arrow_type(kind)), schema)
