"""Texts as files of token ids, coded by the range coder of token_coder.

Rows are range-partitioned by id and sorted, so that the files, taken by partition and number, hold the documents in
ascending order. A task tokenises and codes its rows as they come. It closes a file at about FILE_IDS ids, always at the
end of a document, which bounds its memory. Each attempt writes files of its own name, and a manifest lists those of the
attempts that succeeded; so a lost executor leaves at most files that nobody reads. What precedes a file in the whole
corpus is a running sum over the manifest, one row for each file.

A file: magic, blocks of ids, an index (an Arrow stream of doc_id and n_tokens), and a trailer with the index's size and
checksum.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymesh.llm import token_coder
from waymesh.llm.common import cut, documents, fresh_path, id_type, remove_folder
from waymesh.llm.warc import _file

MAGIC = b"WMIDS\x02"
TRAILER = struct.Struct("<QI")  # bytes of the index, its CRC-32
FILE_IDS = token_coder.LANES * token_coder.BLOCK
END_ID = 2
PIECE = 1 << 22  # bytes of text that are tokenised at once
READ_BYTES = 4 << 20


# Pieces of words for which the tokenizer below cuts and lower-cases as these patterns and Python do, and normal forms
# change nothing: ASCII but for what its contractions and special tokens hold ('<>), and the Latin letters of ISO 8859-1.
_SIMPLE = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff0-9!-&(-/:;=?@\[-`{-~]").fullmatch
_PIECES = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:;=?@\[-`{-~]+| ").findall
_IS_SIMPLE = np.array([c < 256 and bool(chr(c) == " " or _SIMPLE(chr(c))) for c in range(257)])
_SPACE = re.compile(r"[ \t\n\r]")
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}

Flat = tuple[np.ndarray, np.ndarray, np.ndarray]  # of some strings: where their ids start, how many they are, all ids


class _Memory:
    """The ids of strings for as long as there is room; then those that did not come again are forgotten."""

    def __init__(self, encode: Callable[[list[str]], Flat], most: int, most_ids: int):
        self.encode = encode
        self.numbers, self.n_ids = {}, 0
        self.starts, self.sizes = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.ids, self.again = np.zeros(most_ids, np.uint32), np.zeros(most, bool)

    def _learn(self, new: list[str]) -> bool:
        """Whether there was room."""
        a, b = len(self.numbers), len(self.numbers) + len(new)
        if b > len(self.starts):
            return False
        starts, sizes, ids = self.encode(new)
        if self.n_ids + len(ids) > len(self.ids):
            return False
        self.starts[a:b], self.sizes[a:b] = starts + self.n_ids, sizes
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        self.numbers.update(zip(new, range(a, b)))
        return True

    def _forget(self) -> None:
        keep = np.flatnonzero(self.again)
        total = int(self.sizes[keep].sum())
        if 2 * len(keep) > len(self.starts) or 2 * total > len(self.ids):
            keep, total = keep[:0], 0
        strings = list(self.numbers)
        self.numbers = {strings[i]: n for n, i in enumerate(keep.tolist())}
        ends, self.ids[:total] = _gathered((self.starts, self.sizes, self.ids), keep)
        self.sizes[: len(keep)] = self.sizes[keep]
        self.starts[: len(keep)] = ends - self.sizes[: len(keep)]
        self.n_ids = total
        self.again[:] = False

    def of(self, strings: list[str]) -> Flat:
        """strings: all different."""
        for _ in range(3):
            at = np.fromiter(map(self.numbers.get, strings, repeat(-1)), np.int64, len(strings))
            missing = np.flatnonzero(at < 0)
            self.again[at[at >= 0]] = True
            at[missing] = len(self.numbers) + np.arange(len(missing))
            if not len(missing) or self._learn([strings[i] for i in missing.tolist()]):
                return self.starts[at], self.sizes[at], self.ids
            self._forget()
        return self.encode(strings)  # these alone are too many


def _gathered(flat: Flat, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings by their numbers: where the ids of each end, and all ids."""
    starts, sizes, ids = flat
    each = sizes[codes]
    ends = np.cumsum(each)
    return ends, ids[np.repeat(starts[codes] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class Tokens:
    """Ids of texts. words_apart: the tokenizer drops white space and no token reaches over it, so what stands between is
    tokenised once for as long as it is remembered. So are the pieces of such words, where it is known how the tokenizer
    cuts them."""

    MOST_WORDS, MOST_IDS = 1 << 19, 1 << 22

    def __init__(self, file: str, words_apart: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.words_apart = words_apart
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        suffix = self._suffix()
        self.words = _Memory(self._by_pieces if suffix else self._whole, self.MOST_WORDS, self.MOST_IDS)
        if suffix:
            self.model = Tokenizer(self.tokenizer.model)
            bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
            self.last = np.zeros(self.vocabulary, bool)  # ids that end a piece
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.pieces = _Memory(self._simple, self.MOST_WORDS, self.MOST_IDS)

    def _suffix(self) -> str | None:
        """What tokens end with at the end of a piece, if the tokenizer cuts words as the patterns above do."""
        made = json.loads(self.tokenizer.to_str())
        model, cuts = made["model"], made["pre_tokenizer"] or {}
        bytewise = {"add_prefix_space": False, "use_regex": False}
        two = cuts.get("pretokenizers", [])
        known = (
            made["normalizer"] == _NORMALIZER
            and len(two) == 2
            and two[0] == _SPLIT
            and two[1]["type"] == "ByteLevel"
            and all(two[1][k] == v for k, v in bytewise.items())
            and not (made["truncation"] or made["padding"] or made["post_processor"])
            and model["type"] == "BPE"
            and not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"])
            and not any(all(map(_SIMPLE, t["content"])) or t["normalized"] for t in made["added_tokens"])
        )
        return model["end_of_word_suffix"] if known else None

    def _whole(self, texts: list[str]) -> Flat:
        """Each by itself, by the tokenizer."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(f) for f in found], np.int64)
        return np.cumsum(sizes) - sizes, sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def _simple(self, pieces: list[str]) -> Flat:
        """Pieces that the tokenizer would neither change nor cut: straight to its model, many in a row."""
        rows = [" ".join(pieces[a : a + 512]) for a in range(0, len(pieces), 512)]
        found = [e.ids for e in self.model.encode_batch_fast(rows, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            return self._whole(pieces)
        starts = np.zeros(len(ends), np.int64)
        starts[1:] = ends[:-1]
        return starts, ends - starts, ids

    def _by_pieces(self, words: list[str]) -> Flat:
        joined, simple, others = " ".join(words), np.ones(len(words), bool), []
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        odd = ~_IS_SIMPLE.take(points, mode="clip")
        if odd.any():
            simple[np.cumsum(points == ord(" "))[odd]] = False
            others, joined = list(compress(words, ~simple)), " ".join(compress(words, simple))
        starts, sizes, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(0, np.uint32)
        if len(others) < len(words):
            parts = pa.array([" ", *_PIECES(joined.lower())]).dictionary_encode()  # so that a space is number 0
            codes = parts.indices.to_numpy()[1:]
            begin, count, known = self.pieces.of(_strings(parts.dictionary)[1:])
            piece_ends, ids = _gathered((np.append(0, begin), np.append(0, count), known), codes)
            ends = np.append(piece_ends[codes == 0], len(ids))
            starts[simple] = np.append(0, ends[:-1])
            sizes[simple] = ends - starts[simple]
        if others:
            begin, sizes[~simple], more = self._whole(others)
            starts[~simple] = begin + len(ids)
            ids = np.concatenate([ids, more])
        return starts, sizes, ids

    def batches(self, texts: pa.Array | list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Of texts in turn: how many ids each has, and the ids of all of them. A text longer than PIECE comes in several
        parts, each alone; a part that isn't its text's last one has its size negative."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.words_apart:
            for a in range(0, len(texts), 256):
                for e in self.tokenizer.encode_batch_fast(texts.slice(a, 256).to_pylist(), add_special_tokens=False):
                    yield [len(e.ids)], np.array(e.ids, np.uint32)
            return
        ends, a = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while a < len(texts):
            b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right"))
            if b > a:
                yield self._ids(texts.slice(a, b - a))
                a = b
                continue
            text, at = texts[a].as_py(), 0
            while len(text) - at > PIECE and (end := _SPACE.search(text, at + PIECE)):
                (size,), ids = self._ids(pa.array([text[at : end.start()]]))
                yield [~size], ids
                at = end.start()
            yield self._ids(pa.array([text[at:]]))
            a += 1

    def _ids(self, texts: pa.Array) -> tuple[list[int], np.ndarray]:
        """How many ids each text has, and all ids."""
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        ends, ids = _gathered(self.words.of(_strings(each.dictionary)), each.indices.to_numpy())
        return np.diff(np.append(0, ends)[words.offsets.to_numpy()]).tolist(), ids


@lru_cache(maxsize=1)
def _tokens(file: str, words_apart: bool) -> Tokens:
    """Kept from task to task, with the words it remembers."""
    return Tokens(file, words_apart)


class _Writer:
    """One file. Its ids are coded and written FILE_IDS at a time."""

    def __init__(self, stream, digits: int):
        self.stream, self.digits = stream, digits
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.doc_ids: list = []
        self.sizes: list[int] = []
        self.n_bytes = 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.n_bytes += len(data)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= FILE_IDS:
            every = np.concatenate(self.held)
            while len(every) >= FILE_IDS:
                self._write(token_coder.encode(every[:FILE_IDS], self.digits))
                every = every[FILE_IDS:]
            self.held, self.n_held = [every], len(every)

    def close(self, kind: pa.DataType) -> None:
        if self.n_held:
            self._write(token_coder.encode(np.concatenate(self.held), self.digits))
        table = pa.table({"doc_id": pa.array(self.doc_ids, kind), "n_tokens": pa.array(self.sizes, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        index = sink.getvalue().to_pybytes()
        self._write(index + TRAILER.pack(len(index), zlib.crc32(index)))
        self.stream.close()


_MANIFEST = "name string, part int, number int, n_docs long, n_ids long, n_bytes long"


def _file_writer(folder: str, tokenizer: str, words_apart: bool, end_id: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file(folder)
        store.create_dir(base, recursive=True)
        task, part = uuid.uuid4().hex, TaskContext.get().partitionId()
        tokens = _tokens(tokenizer, words_apart)
        digits = token_coder.digits_for(max(tokens.vocabulary, end_id + 1))
        file, number = None, -1
        name = lambda: f"{task}-{number:05d}.ids"
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            file.close(kind)
            values = [[name()], [part], [number], [len(file.sizes)], [file.n_ids], [file.n_bytes]]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], ["name", "part", "number", "n_docs", "n_ids", "n_bytes"])

        within = 0  # ids of a text so far, of which more parts come
        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for sizes, ids in tokens.batches(batch.column("text")):
                at = 0
                for size in sizes:
                    whole, size = size >= 0, max(size, ~size)
                    if file is not None and not within and file.n_ids + size + 1 > FILE_IDS:
                        yield close()
                        file = None
                    if file is None:
                        number += 1
                        file = _Writer(store.open_output_stream(posixpath.join(base, name()), compression=None), digits)
                    file.add(ids[at : at + size])
                    at, within = at + size, within + size
                    if whole:
                        file.add(end)
                        file.doc_ids.append(next(doc_ids))
                        file.sizes.append(within + 1)
                        within = 0
        if file is not None:
            yield close()

    return run


def write_ids(df: DataFrame, folder: str, tokenizer: str, words_apart: bool = False, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts of df, each with end_id after it, to files in folder (a URI all executors can write to),
    in ascending order of id_col. The manifest: name, part, number, n_docs, n_ids, n_bytes.

    tokenizer: the path of a definition that the tokenizers library reads, the same on every machine. Null and empty texts
    are end_id alone. Rows with a null id come first; rows with one id stand in the order of a hash of their text, and are
    documents of their own. An empty table gives no file. Columns beyond id and text are ignored.
    """
    docs = documents(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return cut(ordered.mapInArrow(_file_writer(folder, tokenizer, words_apart, end_id, to_arrow_type(id_type(df, id_col))), _MANIFEST))


def read_file(store, path: str) -> tuple[pa.Table, Iterator[np.ndarray]]:
    """A file's index (doc_id, n_tokens), and its ids in parts."""
    with store.open_input_file(path) as f:
        size = f.size()
        f.seek(max(0, size - TRAILER.size))
        tail = f.read()
        if len(tail) < TRAILER.size:
            raise ValueError(f"{path}: not a file of ids")
        n_index, crc = TRAILER.unpack(tail)
        end = size - TRAILER.size - n_index
        if end < len(MAGIC):
            raise ValueError(f"{path}: not a file of ids")
        f.seek(end)
        index = f.read(n_index)
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{path}: not a file of ids, or its index is damaged")

    def parts() -> Iterator[bytes]:
        with store.open_input_file(path) as f:
            at = len(MAGIC)
            f.seek(at)
            while at < end:
                part = f.read(min(READ_BYTES, end - at))
                if not part:
                    raise ValueError(f"{path}: cut short")
                at += len(part)
                yield part

    return pa.ipc.open_stream(index).read_all(), token_coder.decode(parts())


def _each_document(sizes: Iterable[int], parts: Iterator[np.ndarray], with_ids: bool) -> Iterator[tuple[int, np.ndarray | None]]:
    """Of each document the CRC-32 of its ids, and the ids if asked for."""
    held = np.zeros(0, np.uint32)
    for size in sizes:
        crc, found, left = 0, [], size
        while left:
            if not len(held):
                held = next(parts, None)
                if held is None:
                    raise ValueError("ids are missing at the end of a file")
            some, held = held[:left], held[left:]
            crc = zlib.crc32(np.ascontiguousarray(some, "<u4"), crc)
            left -= len(some)
            if with_ids:
                found.append(some)
        yield crc, np.concatenate(found) if with_ids else None
    if len(held) or next(parts, None) is not None:
        raise ValueError("ids are left over at the end of a file")


def _file_reader(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                index, parts = read_file(store, posixpath.join(base, name))
                sizes = index.column("n_tokens").to_numpy()
                starts = start + np.cumsum(sizes) - sizes
                found = _each_document(sizes.tolist(), parts, with_ids)
                for a in range(0, index.num_rows, step := 256 if with_ids else 65536):
                    rows = index.slice(a, step).combine_chunks()
                    crcs, ids = zip(*(next(found) for _ in range(rows.num_rows)))
                    columns = [rows.column("doc_id").combine_chunks(), pa.array(starts[a : a + step]), rows.column("n_tokens").combine_chunks(), pa.array(crcs, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.record_batch(columns, names)
                for _ in found:
                    pass  # checks that no ids are left over

    return run


def read_ids(manifest: DataFrame, folder: str, id_kind: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and
    ids, from the files of a manifest. id_kind: the SQL type of doc_id. A file that is cut or damaged is an error."""
    earlier = F.sum("n_ids").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    files = cut(manifest.select("name", F.coalesce(earlier, F.lit(0)).alias("start")))
    schema = f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return files.repartition(max(1, files.count())).mapInArrow(_file_reader(folder, with_ids), schema)


def round_trip(spark: SparkSession, df: DataFrame, tokenizer: str, words_apart: bool = False, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of df to files in the shared folder, reads them back and removes them: doc_id, start, n_tokens,
    ids_crc32."""
    folder = fresh_path(spark, "ids")
    manifest = write_ids(df, folder, tokenizer, words_apart, end_id, id_col, text_col)
    rows = cut(read_ids(manifest, folder, id_type(df, id_col).simpleString(), with_ids=False))
    remove_folder(spark, folder)
    return rows
