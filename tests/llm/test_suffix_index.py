import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from waymesh.llm import suffix_index
from waymesh.llm.suffix_index import IndexFamily, pieces

DOC = "doc_id long, text string"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(r) else 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), len(r) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40, letters="abcdefg é\n"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [word(rng.randint(30, 300)) for _ in range(5)]
    texts = []
    for _ in range(n):
        t = word(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(passages)[rng.randint(0, 20) :] + word(rng.randint(0, 60))
        texts.append(t)
    return texts + [texts[3], texts[4][:120] + "X" + texts[4][120:], "a" * 500, "ab" * 300, "", None, passages[0] * 3]


def test_pieces_cover_each_window_once():
    texts = [t.encode() for t in corpus(1) if t]
    index, start, count, anchor, piece = pieces(texts, 40, 8)
    windows = Counter((int(i), int(s) + j) for i, s, n in zip(index, start, count) for j in range(n))
    assert windows == Counter((i, j) for i, t in enumerate(texts) for j in range(len(t) - 39))
    by_window = {}
    for i, s, n, a in zip(index, start, count, anchor):
        for j in range(n):
            by_window.setdefault(texts[i][s + j : s + j + 40], set()).add(int(a))
    assert all(len(a) == 1 for a in by_window.values())


def test_long_texts_are_cut_in_chunks(monkeypatch):
    monkeypatch.setattr(suffix_index, "CHUNK", 64)
    test_pieces_cover_each_window_once()


def test_index_family_flags_what_a_count_of_windows_flags(monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abc\0") for _ in range(900)).encode("latin1")
    family, texts = IndexFamily(20), []
    for _ in range(40):
        batch = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, 800)
            batch.append(base[a : a + rng.randint(20, 90)] + bytes(rng.choices(b"xyz\0", k=rng.randint(0, 30))))
        family.add(batch)
        texts += batch
    seen = Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))
    want = [seen[t[i : i + 20]] > 1 for t in texts for i in range(len(t) - 19)]
    assert family.flags[: family.seen].tolist() == want
    sizes = [len(level.order) for level in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(want)


@pytest.mark.parametrize(("hot", "seed"), [(20_000, 1), (2, 2)])
def test_removal_matches_brute_force(spark, hot, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC + ", th string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.remove_repeats(df, length=40, k=8, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def near_copies():
    """One passage, each copy with another byte changed."""
    passage = "".join(random.Random(11).choices("abcdefgh ", k=300))
    return [passage[:i] + "#" + passage[i + 1 :] for i in range(0, 300, 5)] + [passage, "ab" * 60, "ab" * 61, "tail " + passage[:90]]


@pytest.mark.parametrize("recuts", [0, 1, 3])
def test_hot_anchors_are_cut_again(spark, monkeypatch, recuts):
    monkeypatch.setattr(suffix_index._index_ranges, "__defaults__", (recuts,))
    texts = near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.remove_repeats(df, length=40, k=8, hot=3 if recuts < 3 else 5).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_near_copies_are_not_taken_window_by_window(spark, monkeypatch):
    def fails(batches):
        for batch in batches:
            assert not batch.num_rows, "windows dealt one by one"
        yield from ()

    monkeypatch.setattr(suffix_index, "_window_hashes", lambda length: fails)
    df = spark.createDataFrame(list(enumerate(near_copies())), DOC)
    assert suffix_index.remove_repeats(df, length=40, k=8, hot=5).count() == len(near_copies())


def test_odd_rows(spark):
    long = "".join(random.Random(9).choices("abcdefgh ", k=600_000))
    rows = [(1, "x" * 10), (1, long[:300]), (1, long[:300]), (None, None), (None, ""), (5, long)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_index.remove_repeats(spark.createDataFrame(rows, DOC)).collect())
    assert got == sorted([("1", 10, 0), ("1", 300, 300), ("1", 300, 300), ("None", 0, 0), ("None", 0, 0), ("5", 600_000, 300)])
    empty = suffix_index.remove_repeats(spark.createDataFrame([], DOC))
    assert empty.collect() == []
