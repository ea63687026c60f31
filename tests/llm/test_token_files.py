"""Coder and files: exact round trips, damage, and the query against tokenising every text by itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from waymesh.llm import queries, token_coder, token_files
from waymesh.llm.warc import _file

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string"
TEXTS = [
    "Σίσυφος ΣΑΣ. Σ", "ä ̈x é", "<|endoftext|> x<|startoftext|>y", "\x1c\x1da\x0bb\x0c c\x85d e\xa0f　g", "it's I'LL don't 'S", "\U0001f600 a",
    "     ", "\n\t\r", "İstanbul I", "ﬀ ǆ Ω", "\x00 a\x00b", "", "word, word. Word", "x" * 3000, "many words " * 2000, "#", "a\n\nb",
]


def brute(rows, file, end=2):
    """(doc_id, start, n_tokens, crc) with every text tokenised whole; rows in order."""
    tokenizer, start, out = Tokenizer.from_file(file), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def ids_like(seed, n, top):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.3, n), top - 1)
    ids[n // 3 : n // 2] = np.resize(ids[: min(n, 37)], n // 2 - n // 3)  # repeats, which orders 1 and 2 foresee
    return ids.astype(np.int64)


@pytest.mark.parametrize(("n", "top", "block"), [(1, 2, 4096), (5, 50_000, 4096), (3000, 49_408, 4096), (5000, 16, 700), (9001, 300, 4096), (2500, 1 << 20, 1000), (4097, 1 << 32, 4096)])
def test_round_trip(monkeypatch, n, top, block):
    monkeypatch.setattr(token_coder, "LEAST_BLOCK", 100)
    digits = token_coder.digits_for(top)
    ids = ids_like(n, n, top)
    ids[0] = top - 1
    data = token_coder.encode(ids, digits, block)
    assert np.array_equal(np.concatenate(list(token_coder.decode(data))), ids)
    assert np.array_equal(np.concatenate(list(token_coder.decode(iter([data[i : i + 77] for i in range(0, len(data), 77)])))), ids)


def test_few_lanes_and_random_ids(monkeypatch):
    monkeypatch.setattr(token_coder, "LANES", 3)
    ids = np.random.default_rng(7).integers(0, 1 << 16, 20_000)
    data = token_coder.encode(ids, 4, 1500)
    assert np.array_equal(np.concatenate(list(token_coder.decode(data))), ids)
    assert len(data) < 2.3 * len(ids)  # nothing to foresee: hardly more than the ids themselves


def test_predictions_pay():
    rng = random.Random(3)
    ids = np.array([x for _ in range(2000) for x in rng.choice([(5, 900, 77, 40_000), (6, 901, 20_000), (8, 8, 31)])])
    assert len(token_coder.encode(ids, 4)) < 0.35 * 2 * len(ids)
    assert token_coder.encode(ids[:0], 4) == b"" and list(token_coder.decode(b"")) == []


def test_blocks_stand_alone_and_are_checked():
    ids = ids_like(1, 6000, 5000)
    data = token_coder.encode(ids, 4, 1000)
    n_words = int.from_bytes(data[4:8], "little")
    second = data[token_coder._HEAD.size + 2 * n_words :]
    assert np.array_equal(np.concatenate(list(token_coder.decode(second))), ids[1000:])
    for at in (2, 9, 40, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_coder.decode(bytes(bad)))
    with pytest.raises(ValueError):
        list(token_coder.decode(data[:-1]))
    with pytest.raises(ValueError):
        token_coder.encode(np.array([1 << 16]), 4)


@pytest.mark.parametrize(("piece", "most"), [(1 << 20, 1 << 19), (50, 1 << 19), (50, 200), (10, 2)])
def test_words_alone_give_the_ids_of_whole_texts(monkeypatch, piece, most):
    monkeypatch.setattr(token_files, "PIECE", piece)
    monkeypatch.setattr(token_files.Tokens, "MOST_WORDS", most)
    tokenizer, got, text = Tokenizer.from_file(WORDS), [], []
    for sizes, ids in token_files.Tokens(WORDS, True).batches(TEXTS):
        at = 0
        for size in sizes:
            n = max(size, ~size)
            text += ids[at : at + n].tolist()
            at += n
            if size >= 0:
                got.append(text)
                text = []
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_pieces_of_words_are_tokenised_once(monkeypatch):
    """Case, punctuation and digits of a word cost no further call of the library; what its rules may change does."""
    simple = ["Straße", "STRASSE,", "straße...", "(strasse)", "a1b22", "_x_=y|z", "Ärger-ÿ", "Œuvre", "it's", "x<|endoftext|>", "ñ", "n\u0303", "J\u030c", "²", "µ", "\u212a"]
    texts = [" ".join(simple), " ".join(w.upper() for w in simple), " ".join(f"{w}!?" for w in simple)]
    tokens, seen = token_files.Tokens(WORDS, True), []
    encode = tokens.pieces.encode
    monkeypatch.setattr(tokens.pieces, "encode", lambda new: seen.extend(new) or encode(new))
    for text in texts:
        _, ids = next(tokens.batches([text]))
        assert ids.tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(seen) == len(set(seen)) and seen.count("strasse") == seen.count("straße") == 1 and not any(set(s) & set("'<>œµ") for s in seen)


def test_recurring_words_outlast_a_full_memory():
    calls = []
    memory = token_files._Memory(lambda new: calls.append(new) or (np.arange(len(new)), np.ones(len(new), np.int64), np.array([ord(s) for s in new], np.uint32)), 8, 100)

    def of(strings):
        starts, sizes, ids = memory.of(list(strings))
        assert sizes.tolist() == [1] * len(strings) and [chr(i) for i in ids[starts]] == list(strings)

    for strings in ("abcd", "ab", "efgh", "aijb", "a", "ab", "klmnopqrst"):
        of(strings)
    assert calls == [list("abcd"), list("efgh"), list("ij"), list("klmnopqrst")]


def test_coder_takes_a_step_for_each_id(monkeypatch):
    """It took one for each of four digits."""
    steps, part = [], token_coder._Mixer.part
    monkeypatch.setattr(token_coder._Mixer, "part", lambda self, ids: steps.append(len(ids)) or part(self, ids))
    ids = ids_like(5, 9000, 40_000)
    data = token_coder.encode(ids, 4)
    assert sum(steps) == len(ids) and np.array_equal(np.concatenate(list(token_coder.decode(data))), ids)
    assert sum(steps) == 2 * len(ids)


def plain(rows):
    return [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows]


@pytest.mark.parametrize(("file", "apart", "most"), [(WORDS, True, 1 << 23), (WORDS, True, 400), (BYTES, False, 900)])
def test_files(spark, monkeypatch, tmp_path, file, apart, most):
    token_files._tokens.cache_clear()
    rows = [(i * 7 % 101 - 3, t) for i, t in enumerate(TEXTS)] + [(500, None), (None, "a null id"), (501, "b " * 5000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOC + ", start int, name string").repartition(4)
    manifest = token_files.write_ids(df, str(tmp_path), file, apart)
    got = sorted(token_files.read_ids(manifest, str(tmp_path), "bigint").collect(), key=lambda r: r.start)
    want = brute(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), file)
    assert plain(got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_tokens for r in got)
    files = manifest.collect()
    assert sum(f.n_docs for f in files) == len(rows) and sum(f.n_ids for f in files) == want[-1][1] + want[-1][2]


def test_ties_repeated_rows_and_empty_tables(spark):
    rows = [(1, "same"), (1, "same"), (1, "other"), (2, "z"), (None, None), (None, None)]
    got = plain(token_files.round_trip(spark, spark.createDataFrame(rows, DOC), WORDS, True).collect())
    assert len(got) == 6 and sorted(s for _, s, _, _ in got) == [0, 1, 2, 4, 6, 8]
    assert token_files.round_trip(spark, spark.createDataFrame([], DOC), WORDS, True).collect() == []
    text_ids = spark.createDataFrame([("b", "x"), ("a", None)], "doc_id string, text string")
    assert plain(sorted(token_files.round_trip(spark, text_ids, WORDS, True).collect())) == brute([("a", None), ("b", "x")], WORDS)


def test_many_files_of_one_task(tmp_path, monkeypatch):
    """Files close at ends of documents, and a document longer than a file is whole."""
    import pyarrow as pa

    monkeypatch.setattr(token_files, "FILE_IDS", 300)
    monkeypatch.setattr(token_files, "PIECE", 100)
    monkeypatch.setattr(token_files, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 5})())}))
    token_files._tokens.cache_clear()
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    batch = pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    made = [m.to_pylist()[0] for m in token_files._file_writer(str(tmp_path), WORDS, True, 2, pa.int64())(iter([batch]))]
    token_files._tokens.cache_clear()
    assert len(made) > 3 and [m["number"] for m in made] == list(range(len(made)))
    want, got = brute(rows, WORDS), []
    store, base = _file(str(tmp_path))
    for m in made:
        index, parts = token_files.read_file(store, f"{base}/{m['name']}")
        sizes = index.column("n_tokens").to_pylist()
        got += [(i, n, crc) for i, n, (crc, _) in zip(index.column("doc_id").to_pylist(), sizes, token_files._each_document(sizes, parts, True))]
        assert m["n_ids"] <= 300 or m["n_docs"] == 1
    assert got == [(i, n, crc) for i, _, n, crc in want]
    path = tmp_path / made[0]["name"]
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(ValueError):
        token_files.read_file(store, str(path))


def test_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = queries.QUERIES["op13_token_files"](spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(plain(got.collect())) == brute(rows, WORDS)
