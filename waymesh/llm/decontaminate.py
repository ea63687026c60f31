"""Benchmark decontamination by a broadcast hash set of test n-grams.

Tasks cut the benchmark into parts of at most PART_WORDS words and hash all windows of a part at once. The driver then
takes the parts of one block at a time, of about BLOCK_WORDS words, and makes of them sorted arrays: 28 bytes for each
window and the words themselves, so about 40 bytes a word and 40 MB a block, whatever the benchmark's size. They go
to the executors as a broadcast variable. Documents are scanned in place, without a shuffle: the hashes of all token
windows of a batch come from prefix sums, those found in the set are verified word by word. One block needs one pass; a
larger benchmark takes a pass for each block, one after the other, and the hits of a document are then merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymesh.llm.bytehash import Hasher
from waymesh.llm.common import column, cut, documents, id_type

WINDOW = 13
BLOCK_WORDS = 1_000_000  # of the benchmark in one broadcast
PART_WORDS = 50_000
BATCH_BYTES = 1 << 20

#: Lower case for A-Z; every byte of [\x00-\x2F\x3A-\x60\x7B-\x7F] that is then left becomes a space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BYTES = Hasher(101)
_WORDS = Hasher(102)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ") if text else []


def tokens(text: str) -> list[bytes]:
    return [w for w in words(text) if w]


def _hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """texts, translated: of all words the start and end in the buffer, the number of the first word of each text and of
    the end, prefix sums over the words' hashes, the buffer."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    is_word = np.concatenate(([False], buffer != 32, [False]))
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    limits = np.cumsum([len(p) + 1 for p in texts])
    first = np.searchsorted(starts, np.concatenate(([0], limits)))
    return starts, ends, first, _WORDS.prefix(_BYTES.spans(_BYTES.prefix(buffer), starts, ends)), buffer.tobytes()


def _part_maker(window: int):
    """Of each item its parts: words joined by single spaces, the hashes of its windows and their length. Parts of one item
    overlap, so that each of its windows is in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                found = tokens(text)
                size = min(window, len(found))
                rows = []
                for at in range(0, len(found) - size + 1 if size else 0, PART_WORDS):
                    part = b" ".join(found[at : at + PART_WORDS + size - 1])
                    hashes = _WORDS.grams(_hash_words([part])[3], size)
                    rows.append((str(item), part, size, hashes.view(np.int64)))
                if rows:
                    ids, parts, sizes, hashes = zip(*rows)
                    yield pa.record_batch(
                        [pa.array(ids), pa.array(parts, pa.binary()), pa.array(sizes, pa.int32()), pa.array([len(h) for h in hashes], pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["item", "words", "size", "n", "hashes"]
                    )

    return run


class Windows:
    """The windows of one block of the benchmark: arrays only. parts: item, words, size, hashes."""

    def __init__(self, parts: pa.Table):
        self.items: list[str] = parts.column("item").to_pylist()
        raw = parts.column("words").to_pylist()
        self.buffer = b" ".join(raw)
        before = np.concatenate(([0], np.cumsum([len(w) + 1 for w in raw]))).astype(np.int64)
        sizes, hashes = parts.column("size").to_numpy(), parts.column("hashes").combine_chunks()
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}  # of each size: hashes, rising, and the start, end and item of each window
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            keys, starts, ends, of = [], [], [], []
            for i in own.tolist():
                space = np.flatnonzero(np.frombuffer(raw[i], np.uint8) == 32)
                begin, end = np.concatenate(([0], space + 1)), np.concatenate((space, [len(raw[i])]))
                n = len(begin) - size + 1
                keys.append(hashes[i].values.to_numpy().view(np.uint64))
                starts.append(begin[:n] + before[i])
                ends.append(end[size - 1 :] + before[i])
                of.append(np.full(n, i, np.int32))
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            self.by_size[size] = tuple(x[order] for x in (key, np.concatenate(starts), np.concatenate(ends), np.concatenate(of)))

    def owners(self, size: int, at: int, window: bytes) -> set[str]:
        """The items with this window; at: where its hash stands first."""
        keys, starts, ends, of = self.by_size[size]
        found, key = set(), keys[at]
        while at < len(keys) and keys[at] == key:
            if self.buffer[starts[at] : ends[at]] == window:
                found.add(self.items[of[at]])
            at += 1
        return found


def scan(texts: list[str], windows: Windows) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Of each text: its number of words, the word ranges (start, end) that windows cover, the items they are from."""
    starts, ends, first, prefix, raw = _hash_words([t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts])
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    known: dict[tuple[int, bytes], set[str]] = {}  # a window that comes again in this batch is looked up once
    for size, (keys, *_) in windows.by_size.items():
        if len(starts) < size:
            continue
        grams = _WORDS.grams(prefix, size)
        at = np.searchsorted(keys, grams)
        hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == grams)
        for i in hit.tolist():
            doc = int(np.searchsorted(first, i, "right")) - 1
            if i + size > first[doc + 1]:
                continue  # it runs over the end of the text
            window = b" ".join(raw[a:b] for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist()))
            ids = known.get((size, window))
            if ids is None:
                ids = known[size, window] = windows.owners(size, int(at[i]), window)
            if ids:
                spans[doc].append((i - int(first[doc]), i - int(first[doc]) + size))
                items[doc] |= ids
    return [(int(first[k + 1] - first[k]), spans[k], items[k]) for k in range(len(texts))]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _batches(texts: list, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _scanner(windows: Broadcast, id_arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = windows.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = []
            for a, b in _batches(texts):
                found += scan(texts[a:b], block)
            merged = [merge_spans(s) for _, s, _ in found]
            yield pa.record_batch(
                [
                    batch.column("doc_id").cast(id_arrow),
                    batch.column("row"),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"a": a, "b": b} for a, b in s] for s in merged], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())),
                ],
                ["doc_id", "row", "n_words", "spans", "items"],
            )

    return run


class _Blocks:
    """The benchmark in blocks of about BLOCK_WORDS words; only one of them is on the driver at a time."""

    def __init__(self, benchmark: DataFrame, window: int):
        items = benchmark.select(column(benchmark, "item_id", "string").alias("item_id"), F.coalesce(column(benchmark, "text", "string"), F.lit("")).alias("text"))
        self.parts = cut(items.mapInArrow(_part_maker(window), "item string, words binary, size int, n long, hashes array<long>"))
        self.n = max(1, -(-(self.parts.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))

    def __len__(self) -> int:
        return self.n

    def load(self, b: int) -> Broadcast:
        block = self.parts.filter(F.pmod(F.xxhash64("item", "words"), F.lit(self.n)) == b)
        return self.parts.sparkSession.sparkContext.broadcast(Windows(block.select("item", "words", "size", "hashes").toArrow()))


def _item_blocks(benchmark: DataFrame, window: int = WINDOW) -> _Blocks:
    return _Blocks(benchmark, window)


_FOUND = "row long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def _hits_of_all_blocks(rows: DataFrame, blocks: _Blocks) -> DataFrame:
    """(doc_id, row, n_words, spans, items) of the documents that are hit, of all blocks together. rows: doc_id, row, text;
    rows that agree on doc_id and row have one text. Block by block, each result written before the next is read."""
    kind = id_type(rows)
    every = None
    for b in range(len(blocks)):
        block = blocks.load(b)
        # Copies of a text have the same hits in a block, so one of them is enough.
        hit = cut(rows.mapInArrow(_scanner(block, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {_FOUND}").filter(F.size("spans") > 0).distinct())
        block.destroy()
        every = hit if every is None else every.unionByName(hit)
    raw = every.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return cut(raw.mapInArrow(_union_spans(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {_FOUND}"))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans: the ranges [a, b) of hit words. A document is contaminated if words are hit and they are a twentieth of
    its words or more. Null and empty texts have no words and are clean. Null item ids count as the item "None".
    Repeated rows each get their own row. With no benchmark items nothing is hit; an empty table gives an empty result.
    Columns beyond id and text are ignored.
    """
    docs = documents(df, id_col, text_col)
    kind = id_type(df, id_col)
    blocks = _item_blocks(benchmark, window)
    if len(blocks) == 1:
        rows = docs.withColumn("row", F.lit(0).cast("long"))
        found = rows.mapInArrow(_scanner(blocks.load(0), to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {_FOUND}")
    else:
        rows = docs.withColumn("row", F.xxhash64("text"))
        hits = _hits_of_all_blocks(rows, blocks).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "spans", "items")
        counted = rows.mapInArrow(_counter(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, row long, n_words long")
        both = counted.join(hits, counted.doc_id.eqNullSafe(hits["__id"]) & (counted.row == hits["__row"]), "left")
        found = both.withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<a:long,b:long>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    out = found.withColumn("n_hit", n_hit)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def _counter(id_arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for a, b in _batches(texts) for n in np.diff(_hash_words([t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts[a:b]])[2]).tolist()]
            yield pa.record_batch([batch.column("doc_id").cast(id_arrow), batch.column("row"), pa.array(counts, pa.int64())], ["doc_id", "row", "n_words"])

    return run


def _union_spans(id_arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            merged = [merge_spans([(s["a"], s["b"]) for s in r]) for r in raw]
            spans = pa.array([[{"a": a, "b": b} for a, b in s] for s in merged], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            yield pa.record_batch([batch.column("doc_id").cast(id_arrow), batch.column("row"), batch.column("n_words"), spans, batch.column("items")], ["doc_id", "row", "n_words", "spans", "items"])

    return run


def clean_text(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the hit words of spans and what stands between them."""
    if not text or not spans:
        return text or ""
    data = text.encode("utf-8", "surrogatepass")
    mask = np.concatenate(([False], np.frombuffer(data.translate(_LOWER), np.uint8) != 32, [False]))
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    out, done = [], 0
    for a, b in spans:
        out.append(data[done : edges[2 * a]])
        done = int(edges[2 * b - 1])
    out.append(data[done:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminated(df: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """df without its contaminated documents (mode "documents"), or with the hit spans cut out of their text ("spans").

    Works in one pass over df, with no shuffle, when the benchmark is one block. With several, the hits of all blocks are
    united by text before a document is judged, and spans are cut out of the text as it was given. Clean documents and null
    texts are left as they are, with all their columns; repeated rows are judged alike; an empty table gives an empty result.
    """
    blocks = _item_blocks(benchmark, window)
    if len(blocks) == 1:
        return df.mapInArrow(_cleaner(blocks.load(0), mode, text_col), df.schema)
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    key = F.sha2(text, 256)
    hits = _hits_of_all_blocks(df.select(key.alias("doc_id"), F.lit(0).cast("long").alias("row"), text.alias("text")), blocks)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    bad = hits.filter(20 * n_hit >= F.col("n_words")).select(F.col("doc_id").alias("__bad"), F.col("spans").alias("__spans"))
    keyed = df.withColumn("__key", key)
    if mode == "documents":
        return keyed.join(bad, keyed["__key"] == bad["__bad"], "left_anti").select(*[keyed[c] for c in df.columns])
    return keyed.join(bad, keyed["__key"] == bad["__bad"], "left").select(*[keyed[c] for c in df.columns], "__spans").mapInArrow(_cutter(df.columns, text_col), df.schema)


def _with_text(batch: pa.RecordBatch, text_col: str, texts: list) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, batch.column(text_col).type))


def _cutter(columns: list[str], text_col: str):
    """Cuts the words of __spans out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_col).to_pylist(), batch.column("__spans").to_pylist()
            yield _with_text(batch, text_col, [clean_text(t, [(x["a"], x["b"]) for x in s]) if s else t for t, s in zip(texts, spans)]).select(columns)

    return run


def _cleaner(windows: Broadcast, mode: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = windows.value
        for batch in batches:
            given = batch.column(text_col).to_pylist()
            texts = [t or "" for t in given]
            found = []
            for a, b in _batches(texts):
                found += [(n, merge_spans(s)) for n, s, _ in scan(texts[a:b], block)]
            bad = [contaminated(sum(b - a for a, b in s), n) for n, s in found]
            if mode == "documents":
                yield batch.filter(pa.array([not x for x in bad], pa.bool_()))
            else:
                yield _with_text(batch, text_col, [clean_text(t, s) if x else t for t, (_, s), x in zip(given, found, bad)])

    return run


def items_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
