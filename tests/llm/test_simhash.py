import itertools
import random

import numpy as np
import xxhash

from waymesh.llm import simhash
from waymesh.llm.components import components

DOC = "doc_id long, text string"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


def near_values(rng, n):
    out = []
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            x = centre
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
            out.append(x)
    return out[:n]


def test_fingerprints_match_plain_counting():
    rng = random.Random(1)
    texts = ["", "  \t", "One", "a b c d", "É À Ü ß Ω", " ".join(rng.choice("xyzw") for _ in range(3000))]
    texts += [" ".join(rng.choice(["The", "cat", "sat", "on", "ÉT"]) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    assert [int(x) for x in simhash.fingerprints(texts)] == [brute_fingerprint(t) for t in texts]


def test_golay_code_is_perfect():
    code = simhash.Golay()
    values = np.arange(1 << 14) * 509 % (1 << 23)
    words = sorted({int(h) << 11 | int(code.high[h]) for h in range(1 << 12)})
    assert len(words) == 4096
    near = [sum(bin(w ^ int(v)).count("1") <= 3 for w in words) for v in values[:50]]
    assert near == [1] * 50
    who, anchors = code.visits(values[:50])
    for i in range(50):
        within = {w >> 11 for w in words if bin(w ^ int(values[i])).count("1") <= 4}
        assert set(anchors[who == i].tolist()) == within


def test_every_close_pair_shares_a_key():
    rng = random.Random(2)
    code = simhash.Golay()
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        index, key = simhash.keys(np.array([a, b], np.uint64), code)
        assert set(key[index == 0].tolist()) & set(key[index == 1].tolist())


def test_links_span_the_components(spark):
    rng = random.Random(3)
    values = sorted(set(near_values(rng, 400)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    linked = [(a, b) for a, b in itertools.combinations(values, 2) if bin(a ^ b).count("1") <= 4]
    want = brute_components(values, linked)
    for cell in (3, 20_000):  # 3: nearly every key takes the way for hot keys
        edges = simhash.near_edges(spark.createDataFrame([(s,) for s in signed], "fp long"), cell)
        got = [(r.u % (1 << 64), r.v % (1 << 64)) for r in edges.collect()]
        assert all(bin(a ^ b).count("1") <= 4 for a, b in got) or cell == 20_000
        assert brute_components(values, got) == want


def test_large_links_span_the_same_sets():
    rng = random.Random(4)
    values = sorted(set(near_values(rng, 300)))
    fps = np.array(values, np.uint64).view(np.int64)
    linked = [(a, b) for a, b in itertools.combinations(fps.tolist(), 2) if bin((a ^ b) % (1 << 64)).count("1") <= 4]
    assert brute_components(fps.tolist(), simhash.large_links(fps)) == brute_components(fps.tolist(), linked)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: v for k, v in brute_components({x for e in edges for x in e}, edges).items() if k != v}
    assert got == want


def test_documents_with_odd_rows(spark):
    rows = [(1, "the cat sat on the mat today"), (2, "The cat sat on the mat today"), (3, None), (4, ""), (None, "x y"), (2, "The cat sat on the mat today"), (7, "word " * 30000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOC + ", fp string, component_id string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_components(df).collect())
    fp = lambda t: f"{brute_fingerprint(t):016x}"
    assert len(got) == len(rows)
    by_id = {g[0]: g for g in got}
    assert by_id["1"][2] == by_id["2"][2] == 1 and by_id["1"][1] == fp(rows[0][1])
    assert by_id["3"][1] == "0" * 16 and by_id["3"][2] == by_id["4"][2] == 3
    assert by_id["None"][2] is None
    empty = simhash.near_components(spark.createDataFrame([], DOC))
    assert empty.collect() == [] and empty.columns == ["doc_id", "fingerprint", "component_id"]


def brute_sketch(text, size=5):
    """Four fingerprints of the set of words, and the sketch, as plain numbers."""
    words = (text or "").encode().lower().split()
    shingles = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} or ({b" ".join(words)} if words else set())
    most = lambda hashes: sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    views = [most([xxhash.xxh3_128_intdigest(w, seed) for w in set(words)]) for seed in (0, 1)]
    return [x for v in views for x in (v & (1 << 64) - 1, v >> 64)], most([xxhash.xxh3_128_intdigest(x, 42) for x in shingles])


def brute_near(texts):
    """Labels of components over texts: id -> text."""
    made = {i: brute_sketch(t) for i, t in texts.items()}
    linked = [(a, b) for a, b in itertools.combinations(sorted(made), 2) if (made[a][1] ^ made[b][1]).bit_count() <= simhash.SKETCH_THRESHOLD and min((x ^ y).bit_count() for x, y in zip(made[a][0], made[b][0])) <= 4]
    return brute_components(sorted(made), linked)


def test_near_copies_match_brute_force_and_are_found(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, pairs = [], []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(120, 400))]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, rng.randint(1, 4)):
            changed = [rng.choice(vocabulary) if rng.random() < 0.008 else w for w in words]
            rows.append((10 * k + c, " ".join(changed).title()))
            grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            if len(grams(words) & grams(changed)) >= 0.8 * len(grams(words) | grams(changed)):
                pairs.append((10 * k, 10 * k + c))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two three"), (1004, "One two  three"), (1005, "other words")]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    assert got == brute_near(dict(rows))
    assert all(got[i] // 10 == i // 10 for i in got if i < 1000)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs) > 20
    assert got[1002] == got[1001] == 1000 and got[1004] == 1003 and got[1005] == 1005


def test_drop_near_copies(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (3, "A B C D E F"), (9, "q w e r t y u i o p")], DOC)
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == [3, 9]
