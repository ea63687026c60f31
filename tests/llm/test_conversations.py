"""The search against all edits, the queries against SQL and a plain version, and the repaired rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from waymesh.llm import conversations, queries
from waymesh.llm.conversations import Search, fault

ROW = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired rows) over all edits with at most two inserts in a row. rows: (role, text, fault)."""
    best, gaps = None, len(rows) + 1
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "user", "assistant"] for _, _, f in rows]
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=gaps):
            cost, audit, out = 0, "", []
            for k in range(gaps):
                cost, audit = cost + 5 * len(added[k]), audit + "I" * len(added[k])
                out += [(r, "") for r in added[k]]
                if k == len(rows):
                    break
                role, text, kind = rows[k]
                edit = edits[k]
                cost += (2 if edit == "D" else 0 if edit == "K" else 1) + (5 if kind == "truncated" and edit != "D" else 0)
                audit += edit if edit in "DK" else "R"
                if edit != "D":
                    out.append((role if edit == "K" else edit, text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        kind = fault(role, text, (role, text) in seen)
        seen.add((role, text))
        out.append((role, text, kind))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_search_is_cheapest(seed):
    rng = random.Random(seed)
    rows = faults([(rng.choice(["user", "assistant", "system", "tool", "umpire", "", " "]), rng.choice(["Yes.", "cut of", " ", "Really? ", "a!"])) for _ in range(rng.randint(0, 4))])
    search = Search()
    for row in rows:
        search.feed(*row)
    cost, audit, out = cheapest(rows)
    assert search.result() == (cost, audit, digest(out))


def whole_search(rows, keep_all):
    search = Search()
    for row in rows:
        search.feed(*row)
    return search.result()


@pytest.mark.parametrize("seed", range(6))
def test_nothing_is_lost_by_dropping_hopeless_survivors_and_folding(monkeypatch, seed):
    rng = random.Random(seed)
    roles = [["user", "assistant", "system"], ["system"], ["assistant", "system"], ["user"], ["tool", "user"], ["user", "assistant"]][seed]
    rows = [(rng.choice(roles), f"{i}.", rng.choice([None, None, None, "truncated", "blank"])) for i in range(400)]
    want = whole_search(rows, True)
    monkeypatch.setattr(conversations, "TAIL", 3)
    assert whole_search(rows, True) == want
    monkeypatch.setattr(conversations, "HOPELESS", 10**9)
    assert whole_search(rows, True) == want


def test_long_conversation_of_one_role():
    """Survivors that never meet: all system messages."""
    search = Search()
    for i in range(30_000):
        search.feed("system", f"{i}.", None)
    cost, audit, _ = search.result()
    assert cost == 30_000 and len(audit) == 30_000 and set(audit[1:]) <= {"R", "K", "D"}


def hurt(rows):
    """rows: (conv_id, turn, role, text). Those of each conversation after damage, in order."""
    out = defaultdict(list)
    space = lambda v: " " if v is None else v
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv_id)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv_id] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain(rows, exact):
    out = []
    for conv_id, after in hurt(rows).items():
        marked = faults([(r, t) for _, r, t in after])
        turns = [t for t, _, _ in after if t is not None]
        count = [sum(k == f for _, _, k in marked) for f in ("blank", "duplicate", "truncated")]
        initials = [r[:1] for r, _, _ in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        if exact:
            cost, audit, repaired = cheapest(marked) if marked else (0, "", [])
            found = cost, audit, digest(repaired)
        else:
            found = whole_search(marked, False) if marked else (0, "", digest([]))
        out.append((conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, *found))
    return out


def awkward():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice(["Yes.", "no", "", None, " \n", "Well!\t", "é?"])) for c in range(60) for t in range(rng.randint(1, 3))]
    rows += [(100, None, "user", "a."), (100, None, "user", "a."), (100, 3, "assistant", "b."), (101, None, None, None), (None, 1, "user", "x."), (None, None, "assistant", "y.")]
    rows += [(102, 5, "user", "same."), (102, 5, "user", "same."), (102, 9, "assistant", "z.")]
    rows += [(c, 0, "user", "all of it may go") for c in range(200, 260)]
    return rows


def in_sql(path):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    return sorted(map(str, c.sql(conversations.SQL).fetchall()))


def test_awkward_rows(spark, tmp_path):
    rows = awkward()
    df = spark.createDataFrame([(*r, 1, True) for r in rows], ROW + ", n int, repeated boolean").repartition(3)
    got = conversations.diagnose(conversations.damage(df))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = sorted(map(str, plain(rows, True)))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    assert in_sql(tmp_path / "c" / "*.parquet") == want
    assert any(r[-2] == "" and r[0] is not None and r[0] >= 200 for r in plain(rows, True))  # one lost all its rows


def test_query_against_sql_and_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(str(tuple(r)) for r in queries.QUERIES["op11_conversation_repair"](spark, sf_dir).collect())
    assert got == sorted(map(str, plain(rows, False))) == in_sql(f"{sf_dir}/conversations.parquet")


def test_repaired_rows(spark):
    rows = awkward()
    df = conversations.damage(spark.createDataFrame(rows, ROW)).repartition(5)
    found = defaultdict(list)
    for r in conversations.repair(df).collect():
        found[r.conv_id].append(r)
    for conv_id, *_, audit, sha in plain(rows, False):
        kept = sorted(found[conv_id], key=lambda r: r.place)
        assert [r.place for r in kept] == list(range(len(kept)))
        assert digest([(r.role, r.text) for r in kept]) == sha and "".join(r.edit for r in kept) == audit.replace("D", "")
        assert all((r.edit != "I") or (r.turn is None and r.text == "") for r in kept)


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROW)
    assert conversations.diagnose(conversations.damage(empty)).collect() == [] and conversations.repair(empty).collect() == []
