"""Repair of a conversation's structure by a forward Viterbi search.

A repaired conversation follows `(s?(ua)+)?` in the initials of its roles: an optional system message, then pairs of user
and assistant. Four states tell what it ends with so far: nothing, the system message, a user, an assistant. For each state
the search carries the cheapest (cost, audit), audit being one letter for each edit: D(elete), I(nsert), K(eep), R(erole).
Ties go to the least audit in ASCII. After each turn its layer is closed by at most two inserts, since a third would only
repeat a state at a higher cost.

Rows are shuffled once, by conversation, and sorted by turn; tasks stream over them. Of a conversation of any length only
the four survivors are held: their audits, and the SHA-256 of the conversation as each would repair it. A SHA-256 reads
its bytes in order, so one conversation is the work of one task; its rows are never collected. Which rows repeat earlier
ones is found by a window on the same partitioning, which spills, rather than by a set of what was seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymesh.llm.common import column, cut, id_type

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs; Keep costs nothing
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a role's initial leads to from a state; other pairs break the grammar.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The one role that may follow a state by Rerole or Insert, and the state after it.
FILL = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
LEGAL = frozenset(("su", "ua", "au"))
#: A survivor that costs more than the cheapest by this can't win: any way on from it is open to the other for 12 at most
#: (two inserts, and the deletion of a system message).
HOPELESS = 12
TAIL = 1024  # letters of an audit that are appended one by one before they join the rest


def fault(role: str, text: str, repeated: bool) -> str | None:
    """The first fault of a row."""
    body = text.rstrip(SPACE)
    return "blank" if not body else "duplicate" if repeated else "truncated" if body[-1] not in ".!?" else None


class Survivor:
    """The cheapest way into a state: cost, audit (head and tail), and the hash of the repaired conversation so far."""

    __slots__ = ("cost", "head", "tail", "hashed")

    def __init__(self, cost: int = 0, head: str = "", tail: str = "", hashed=None):
        self.cost, self.head, self.tail, self.hashed = cost, head, tail, hashed

    def before(self, other: Survivor | None) -> bool:
        if other is None or self.cost != other.cost:
            return other is None or self.cost < other.cost
        if self.head is other.head:
            return self.tail < other.tail
        return self.head + self.tail < other.head + other.tail


def _hash_on(hashed, role: str, text: str):
    """The hash with one more row. hashed: None where nothing stands before it."""
    row = f"{role}:{text}".encode("utf-8", "surrogatepass")
    if hashed is None:
        return hashlib.sha256(row)
    more = hashed.copy()
    more.update(b"\n")
    more.update(row)
    return more


class Search:
    """The search over one conversation; rows are fed in order."""

    def __init__(self) -> None:
        self.layer: list[Survivor | None] = [Survivor(), None, None, None]
        self._insert()

    def _insert(self) -> None:
        """Closes the layer: inserts from what it holds, twice at most."""
        for _ in range(2):
            for state in (START, SYSTEM, ASSISTANT, USER):
                way = self.layer[state]
                if way is None:
                    continue
                role, after = FILL[state]
                new = Survivor(way.cost + INSERT, way.head, way.tail + "I")
                if new.before(self.layer[after]):
                    new.hashed = _hash_on(way.hashed, role, "")
                    self.layer[after] = new

    def feed(self, role: str, text: str, kind: str | None) -> None:
        layer: list[tuple[Survivor, Survivor | None, str] | None] = [None] * 4  # the way, what it comes from, the role it writes

        def offer(state: int, way: Survivor, edit: str, cost: int, writes: str | None) -> None:
            new = Survivor(way.cost + cost, way.head, way.tail + edit, way.hashed)
            if layer[state] is None or new.before(layer[state][0]):
                layer[state] = (new, writes)

        initial, extra = role[:1], TRUNCATED if kind == "truncated" else 0
        for state, way in enumerate(self.layer):
            if way is None:
                continue
            offer(state, way, "D", DELETE, None)
            if kind in ("blank", "duplicate"):
                continue
            if (state, initial) in NEXT:
                offer(NEXT[state, initial], way, "K", extra, role)
            as_role, after = FILL[state]
            offer(after, way, "R", REROLE + extra, as_role)
        least = min(new.cost for new, _ in filter(None, layer)) + HOPELESS
        self.layer = [None] * 4
        for state, found in enumerate(layer):
            if found is not None and found[0].cost <= least:
                new, writes = found
                if writes is not None:
                    new.hashed = _hash_on(new.hashed, writes, text)
                self.layer[state] = new
        self._insert()
        if max(len(way.tail) for way in self.layer if way is not None) > TAIL:
            self._fold()

    def _fold(self) -> None:
        """Tails join their heads; those that say the same share one string again."""
        heads: dict[str, str] = {}
        for way in self.layer:
            if way is not None:
                whole = way.head + way.tail
                way.head, way.tail = heads.setdefault(whole, whole), ""

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired conversation)."""
        best = None
        for way in (self.layer[START], self.layer[ASSISTANT]):
            if way is not None and way.before(best):
                best = way
        return best.cost, best.head + best.tail, (best.hashed or hashlib.sha256()).hexdigest()


class _Conversation:
    def __init__(self, conv_id) -> None:
        self.conv_id, self.search = conv_id, Search()
        self.rows = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def feed(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        kind = fault(role, text, repeated)
        if kind is not None:
            self.counts[kind] += 1
        if turn is not None and turn != self.last:  # turns come in order, nulls first
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.rows:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.rows, self.initial = self.rows + 1, role[:1]
        self.search.feed(role, text, kind)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit, digest = self.search.result() if self.rows else (0, "", hashlib.sha256().hexdigest())
        return (self.conv_id, gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, cost, audit, digest)


_NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repairer(kind: pa.DataType):
    kinds = (kind, *[pa.int64()] * 6, pa.string(), pa.string())

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                yield from zip(*(batch.column(c).slice(a, 512).to_pylist() for c in ("conv_id", "turn", "role", "text", "repeated", "there")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size = 0
        now = None
        for conv_id, turn, role, text, repeated, there in rows_of(batches):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.result())
                    size += len(done[-1][7]) + 100
                now = _Conversation(conv_id)
                if size > 1 << 20:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], list(_NAMES))
                    done, size = [], 0
            if there:
                now.feed(turn, role, text, repeated)
        if now is not None:
            done.append(now.result())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], list(_NAMES))

    return run


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(column(df, name, "string"), F.lit(" "))


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and there of df, its rows damaged by crc32('conv_id:turn') % 20: 0 drops a row (there: false),
    1 empties its text, 2 takes [.!?] out of it, 3 repeats it, 4 makes its role user. Nulls are one space, in the key too."""
    part = lambda c: F.coalesce(column(df, c, "string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = df.select(df.conv_id, column(df, "turn", "long").alias("turn"), _text(df, "role").alias("role"), _text(df, "text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), copies.alias("copy")).drop("copy")


def _in_order(df: DataFrame) -> DataFrame:
    """Rows by conversation, turn, role and text, with repeated: whether role and text have come before in the conversation.
    One shuffle, by conversation; window and sort then work on what is there, and spill."""
    there = F.coalesce(df["there"], F.lit(True)) if "there" in df.columns else F.lit(True)
    rows = df.select(df.conv_id, column(df, "turn", "long").alias("turn"), _text(df, "role").alias("role"), _text(df, "text").alias("text"), there.alias("there"))
    rows = rows.withColumn("text", F.when(F.col("there"), F.col("text")).otherwise("")).withColumn("digest", F.sha2("text", 256)).repartition("conv_id")
    same = W.partitionBy("conv_id", "there", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    marked = rows.withColumn("repeated", F.row_number().over(same) > 1)
    # Copies of a row in one turn stand together, the one that isn't repeated first.
    return marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "repeated").select("conv_id", "turn", "role", "text", "repeated", "there")


def diagnose(df: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    df: conv_id, turn, role, text, and there (optional): false for a row that only says that its conversation exists. Null
    roles and texts are one space. Rows of one turn, and those of no turn, which come first, stand in the order of role and
    text; repeated rows are duplicates. Rows without a conv_id are one conversation. A conversation without rows has zeros and
    an empty audit, an empty table an empty result. Other columns are ignored. Roles count by their first
    letter as it is; an empty role fits nowhere.
    """
    kind = id_type(df, "conv_id")
    schema = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _in_order(df).mapInArrow(_repairer(to_arrow_type(kind)), schema)


def _applier(kind: pa.DataType):
    names = ("conv_id", "place", "turn", "role", "text", "edit")
    kinds = (kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, place = None, START, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                out = []
                for conv_id, n, edits, turn, role, text in zip(*(batch.column(c).slice(a, 512).to_pylist() for c in ("conv_id", "n", "edits", "turn", "role", "text"))):
                    if n == 0 or now != (conv_id,):
                        now, state, place = (conv_id,), START, 0
                    for edit in edits:
                        if edit == "D":
                            continue
                        if edit == "K":
                            state = NEXT[state, role[:1]]
                            out.append((conv_id, place, turn, role, text, edit))
                        else:
                            as_role, state = FILL[state]
                            out.append((conv_id, place, *((turn, as_role, text) if edit == "R" else (None, as_role, "")), edit))
                        place += 1
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], list(names))

    return run


def repair(df: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), turn, role, text and edit (K, R or I; inserted rows have
    no turn and an empty text). Rows and nulls count as in diagnose; a conversation that repairs to nothing has no row.

    The audit of a conversation is cut into what happens to each row; that is joined to the rows by their number, so no
    task holds a conversation."""
    kind = id_type(df, "conv_id")
    audits = cut(diagnose(df).select("conv_id", "audit"))
    per_row = F.concat(F.array(F.regexp_extract("audit", "^I*", 0)), F.regexp_extract_all("audit", F.lit("[DKR]I*"), 0))
    plan = audits.select(F.col("conv_id").alias("c"), F.posexplode(per_row).alias("n", "edits"))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "repeated")
    rows = _in_order(df).filter("there").withColumn("at", F.row_number().over(order))
    both = plan.join(rows, plan.c.eqNullSafe(rows.conv_id) & (plan.n == rows["at"]), "left").select(plan.c.alias("conv_id"), "n", "edits", "turn", "role", "text")
    schema = f"conv_id {kind.simpleString()}, place long, turn long, role string, text string, edit string"
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "n").mapInArrow(_applier(to_arrow_type(kind)), schema)


def _sql() -> str:
    """The same in SQL: a recursive query that takes a row of every conversation at a time."""
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
    none = "{'cost': 1000000000000::BIGINT, 'audit': '', 'rows': []::VARCHAR[]}"

    def way(state: str, cost: str, edit: str, row: str | None) -> str:
        return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{edit}', 'rows': {state}.rows{'' if row is None else f' || [{row}]'}}}"

    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    delete = lambda s: way(s, "2", "D", None)
    keep = lambda s, i: f"CASE WHEN NOT gone AND i = '{i}' THEN {way(s, 'extra', 'K', chr(39).join(['role || ', ':', ' || text']))} ELSE {none} END"
    rerole = lambda s, role: f"CASE WHEN NOT gone THEN {way(s, '1 + extra', 'R', f'{chr(39)}{role}:{chr(39)} || text')} ELSE {none} END"
    insert = lambda s, role: way(s, "5", "I", f"'{role}:'")
    return f"""
        WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        hurt AS (SELECT conv_id, turn, role, text, {crc} % 20 AS h FROM base),
        rows_after AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
            FROM hurt WHERE h <> 0),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again
            FROM (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_after)),
        f AS (
            SELECT conv_id, turn, role, text, n, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS earlier,
                CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS kind
            FROM o),
        g AS (SELECT conv_id, n, role, text, i, kind IN ('blank', 'duplicate') AS gone, CASE WHEN kind = 'truncated' THEN 5 ELSE 0 END AS extra FROM f),
        steps(conv_id, n, s0, s1, s2, s3) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': '', 'rows': []::VARCHAR[]}}, {none}, {{'cost': 5::BIGINT, 'audit': 'I', 'rows': ['user:']}}, {{'cost': 10::BIGINT, 'audit': 'II', 'rows': ['user:', 'assistant:']}} FROM f
            UNION ALL
            SELECT conv_id, n, s0, s1, t2, {best("s3", insert("t2", "assistant"))} FROM (
                SELECT conv_id, n, s0, s1, s3, {best("s2", insert("s0", "user"), insert("s1", "user"), insert("s3", "user"))} AS t2 FROM (
                    SELECT s.conv_id, g.n, {delete("s0")} AS s0, {best(delete("s1"), keep("s0", "s"))} AS s1,
                        {best(delete("s2"), *(keep(s, "u") for s in ("s0", "s1", "s3")), *(rerole(s, "user") for s in ("s0", "s1", "s3")))} AS s2,
                        {best(delete("s3"), keep("s2", "a"), rerole("s2", "assistant"))} AS s3
                    FROM steps s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.n = s.n + 1))),
        counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
                count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (earlier IS NOT NULL AND earlier || i NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id),
        won AS (SELECT s.conv_id, {best("s0", "s3")} AS w FROM steps s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.n)
        SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(w.cost, 0) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.rows, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM base) b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM b.conv_id"""


SQL = _sql()
