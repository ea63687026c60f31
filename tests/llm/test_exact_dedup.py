import hashlib
import random
import re
from collections import Counter

import pytest

from waymesh.llm import exact_dedup

DOC = "doc_id long, text string"


def brute(rows):
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append(i)
    out = []
    for i, t in rows:
        same = groups[digest(t)]
        keep = min((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), digest(t)))
    return out


def corpus():
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "a  b", "a\tb\n", "hot text", "hot \x0b text", "ä", f"own {i}", "", None, "\x1c"])) for i in range(400)]
    return rows + [(1000 + i, "one third of all") for i in range(200)] + [(None, "null id"), (None, "ä"), (7, rows[7][1]), (7, "other")]


@pytest.mark.parametrize("phi", [1 / 128, 0.4, 1.0])
def test_groups_match_brute_force(spark, phi):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", digest int").repartition(5)
    got = exact_dedup.exact_groups(df, phi=phi).collect()
    key = lambda r: [(x is None, x) for x in r]
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(brute(rows), key=key)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in got}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_misra_gries_keeps_every_heavy_key():
    rng = random.Random(2)
    keys = ["hot"] * 400 + ["warm"] * 150 + [f"k{rng.randint(0, 5000)}" for _ in range(1000)]
    rng.shuffle(keys)
    counts = exact_dedup.misra_gries((keys[i : i + 37] for i in range(0, len(keys), 37)), counters=20)
    real = Counter(keys)
    assert len(counts) <= 20
    assert all(real[k] - len(keys) / 21 <= n <= real[k] for k, n in counts.items())
    assert {"hot", "warm"} <= set(counts)


def test_drop_copies(spark):
    rows = [(3, "a b"), (2, "a  b"), (2, "a  b"), (9, "c"), (None, None), (5, "")]
    df = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows)], DOC + ", kept string")
    got = exact_dedup.drop_exact_copies(df).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(2, "a  b"), (5, ""), (9, "c")]
    assert len(exact_dedup.drop_exact_copies(df.filter("kept <> '2'")).collect()) == 3
    empty = spark.createDataFrame([], DOC)
    assert exact_dedup.drop_exact_copies(empty).collect() == [] and exact_dedup.exact_groups(empty).collect() == []
