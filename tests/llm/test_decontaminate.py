import hashlib
import random
import re
import time

import pyarrow as pa
import pytest

from waymesh.llm import decontaminate

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, size=13):
    words, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "cat", "Sat", "x1", "é", "über", "a"])
    say = lambda n: rng.choice([" ", ", ", "-"]).join(word() for _ in range(n))
    items = [(i, say(rng.randint(0, 30))) for i in range(12)] + [(50, "rare words only"), (51, "rare words only"), (52, None), (53, "...")]
    docs = []
    for i in range(60):
        a = rng.choice(items)[1] or ""
        b = a.split(" ")
        docs.append((i, rng.choice([say(rng.randint(0, 50)), say(20) + "! " + a.upper() + " " + say(200), " ".join(b[: rng.randint(0, len(b))]) + " " + say(5), "rare, WORDS/only"])))
    return docs + [(100, None), (101, ""), (102, "!!"), (None, items[3][1]), (3, docs[3][1]), (103, "z " * 50_000 + "rare words only")], items


@pytest.mark.parametrize(("seed", "block"), [(1, 2_000_000), (2, 40)])  # 40: several blocks
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = corpus(seed)
    df = spark.createDataFrame([(*d, "x") for d in docs], DOC + ", row string").repartition(3)
    found = decontaminate.contamination(df, spark.createDataFrame(items, ITEM))
    got = sorted(tuple(map(str, (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))) for r in found.collect())
    assert got == sorted(tuple(map(str, (i, *brute(t, items)))) for i, t in docs)


def test_modes(spark):
    items = spark.createDataFrame([(1, "one two three")], ITEM)
    df = spark.createDataFrame([(1, "One, two three."), (2, "clean text"), (3, "x " * 100 + "one two three"), (4, None)], DOC)
    assert sorted(r.doc_id for r in decontaminate.decontaminated(df, items).collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminated(df, items, mode="spans").collect()}
    assert cut[1] == "." and cut[2] == "clean text" and cut[3].endswith("one two three") and cut[4] is None
    assert decontaminate.clean_text("a ONE two-three b", [(1, 4)]) == "a  b"


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOC), spark.createDataFrame([], ITEM)
    row = decontaminate.contamination(docs, items).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert decontaminate.contamination(spark.createDataFrame([], DOC), items).collect() == []


@pytest.mark.parametrize(("seed", "block"), [(1, 2_000_000), (2, 40), (5, 40)])
def test_decontaminated_matches_brute_force_in_any_number_of_blocks(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = corpus(seed)
    # Each item alone hits less than a twentieth of the words, all together more.
    few = [("alpha beta gamma", 300), ("delta eps zeta", 301), ("eta theta iota", 302), ("kappa lam my", 303)]
    items += [(n, t) for t, n in few]
    docs.append((200, "w " * 110 + " v ".join(t for t, _ in few)))
    table = spark.createDataFrame(items, ITEM)
    assert (len(decontaminate._item_blocks(table)) > 1) == (block == 40)
    df = spark.createDataFrame([(t, i, "x") for i, t in docs], "text string, doc_id long, row string").repartition(3)
    bad = [brute(t, items)[4] for _, t in docs]
    assert bad[-1]
    got = decontaminate.decontaminated(df, table)
    assert got.columns == df.columns
    key = lambda rows: sorted((str(i), str(t)) for i, t in rows)
    assert key((r.doc_id, r.text) for r in got.collect()) == key(d for d, b in zip(docs, bad) if not b)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 2_000_000)
    want = decontaminate.decontaminated(df, table, mode="spans").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    cut = decontaminate.decontaminated(df, table, mode="spans")
    assert cut.schema == df.schema
    assert key((r.doc_id, r.text) for r in cut.collect()) == key((r.doc_id, r.text) for r in want)
    assert {r.doc_id: r.text for r in want}[200].split() == ["w"] * 110 + ["v"] * 3


def test_a_long_item_is_hashed_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    body = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(300))
    items, docs = [(1, body), (2, "p q")], [(i, " ".join(body.split()[i * 7 : i * 7 + 15])) for i in range(40)]
    want = [tuple(map(str, (i, *brute(t, items)))) for i, t in docs]
    monkeypatch.setattr(decontaminate, "PART_WORDS", 20)
    parts = pa.concat_tables([pa.Table.from_batches([b]) for b in decontaminate._part_maker(13)(iter([pa.record_batch([pa.array([1, 2]), pa.array([body, "p q"])], ["item_id", "text"])]))])
    assert parts.num_rows > 10
    found = decontaminate.scan([t for _, t in docs], decontaminate.Windows(parts))
    got = [tuple(map(str, (i, n, sum(b - a for a, b in decontaminate.merge_spans(s)), len(x), decontaminate.items_digest(x), decontaminate.contaminated(sum(b - a for a, b in decontaminate.merge_spans(s)), n)))) for (i, _), (n, s, x) in zip(docs, found)]
    assert got == want


def test_two_million_words_are_hashed_in_a_minute():
    rng = random.Random(4)
    items = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9999)) for _ in range(2000)) for _ in range(1000)]
    began = time.perf_counter()
    batch = pa.record_batch([pa.array([str(i) for i in range(1000)]), pa.array(items)], ["item_id", "text"])
    parts = pa.Table.from_batches(list(decontaminate._part_maker(13)(iter([batch]))))
    windows = decontaminate.Windows(parts)
    assert len(windows.by_size[13][0]) == 1000 * 1988 and time.perf_counter() - began < 60
