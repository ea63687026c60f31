"""Line deduplication within one edit, by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are within one edit if they agree, if deleting the character at the same place from both gives the same
(a substitution), or if deleting one from the longer gives the shorter (an insertion). So each line is keyed by every
variant with one character deleted. Lines that share (place, variant) all differ at that place only, so the earliest of
them is a partner of each: an aggregation finds it, and no pairs are made. Insertions join variants with whole lines.

Equal lines of any length meet by their hash; only lines of NEAR_CHARS characters or more are compared within one edit.
Most of them have no partner, so variants are made only for lines that can have one. A single edit leaves the first or
the last part of a line untouched: each distinct line is keyed by both, and goes on only if another line shares one.
Lines are aggregated before each shuffle, hot keys are summed where they are found, and joins may be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geometry import let
from waymesh.llm.common import cut, documents, same_doc, with_text_hash

LEAST_CHARS = 1  # of a line that goes if the same line occurs earlier: all but empty lines
NEAR_CHARS = 16  # of both lines where one goes for another within one edit; below, an edit makes another word or number
FEW_KEYS = 500_000  # longs that may go to every task: 8 MB or so
_END = r"\n"


def _part(length: Column) -> Column:
    """Characters of a line's first and last part, so that both together are no longer than the line."""
    return (4 * F.floor(length / 8)).cast("int")


def _hash(*columns: Column) -> Column:
    """128 bits, as two longs."""
    return F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(77), *columns).alias("h2"))


def _parts(line: Column) -> Column:
    """array<struct<k, lo, hi>>: hashes of the line's first and last part, and the places where an edit can be if that part
    is shared. Where a line one character shorter has shorter parts, those as well."""
    n = F.length(line)
    parts = []
    for size in (_part(n), _part(n - 1)):
        for side, text, lo, hi in ((0, F.substring(line, F.lit(1), size), size + 1, n), (1, F.substring(line, F.greatest(n - size + 1, F.lit(1)), size), F.lit(1), n - size)):
            parts.append(F.struct(F.xxhash64(F.lit(side), size, text).alias("k"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))
    return F.array_distinct(F.array(*parts))


def _code_points(line: Column) -> Column:
    """The line in four bytes for each character: parts of it are then copied without counting characters."""
    return F.encode(line, "UTF-32")


BLOCK = 64  # code points hashed at once, at least


def _block_size(m: Column) -> Column:
    """For a line of m characters: about the root of m, in whole BLOCKs, so that work on a line grows as its length to 1.5."""
    return (F.lit(BLOCK) * F.greatest(F.lit(1), F.floor(F.sqrt(m) / BLOCK))).cast("int")


def _blocks(m: Column, size: Column) -> Column:
    return F.ceil(m / size).cast("int")


def _block_hashes(points: Column, size: Column, n: Column, shift: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.xxhash64(k, F.substring(points, 4 * (k * size + shift) + 1, 4 * size)))


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda h, x: h.bitwiseXOR(x))


def _whole(points: Column, m: Column) -> Column:
    """The hash of a line of m characters: of each block by its place, put together by exclusive or."""
    size = _block_size(m)
    return F.when(m <= BLOCK, F.xxhash64(F.lit(0), points)).otherwise(_xor(_block_hashes(points, size, _blocks(m, size), 0)))


def _deletions(points: Column, n: Column, lo: Column, hi: Column) -> Column:
    """array<struct<pos, h>> of the variants of a line of n characters with the character at pos deleted, for pos from lo to
    hi. h is what _whole gives for the variant: the blocks before pos are the line's own, those after it are the line's
    shifted by one, so only the block around pos is hashed for each variant. points: the line by _code_points."""
    rest = F.lit(1 << 30)
    m = n - 1
    short = F.transform(F.sequence(lo, hi), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(0), F.concat(F.substring(points, F.lit(1), 4 * (i - 1)), F.substring(points, 4 * i + 1, rest))).alias("h")))

    def variants(state: Column) -> Column:
        before, after, size = state["before"], state["after"], state["size"]

        def one(i: Column) -> Column:
            b = F.floor((i - 1) / size).cast("int")
            middle = F.concat(F.substring(points, 4 * b * size + 1, 4 * (i - 1 - b * size)), F.substring(points, 4 * i + 1, 4 * ((b + 1) * size - i + 1)))
            own = let(middle, lambda x: F.when(F.length(x) > 0, F.xxhash64(b, x)).otherwise(F.lit(0).cast("long")))
            return F.struct(i.alias("pos"), F.get(before, b).bitwiseXOR(own).bitwiseXOR(F.get(after, b)).alias("h"))

        return F.transform(F.sequence(lo, hi), one)

    size = _block_size(m)
    count = _blocks(m, size)
    hashes = F.struct(_block_hashes(points, size, count, 0).alias("own"), _block_hashes(points, size, count, 1).alias("moved"), count.alias("count"), size.alias("size"))

    def sums(h: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), h["count"]), lambda b: _xor(F.slice(h["own"], F.lit(1), b)))
        after = F.transform(F.sequence(F.lit(0), h["count"]), lambda b: _xor(F.slice(h["moved"], b + 2, h["count"])))
        return F.struct(before.alias("before"), after.alias("after"), h["size"].alias("size"))

    return F.when(m <= BLOCK, short).otherwise(let(let(hashes, sums), variants))


def _within_one(a: Column, b: Column) -> Column:
    """Whether two lines are within one edit. For long ones, where Spark's levenshtein takes the square of their length, the
    common beginning is found by bisection, and what follows the edit is compared."""
    steps = F.array(*[F.lit(1 << k) for k in range(28, -1, -1)])

    def after_edit(both: Column) -> Column:
        x, y = both["x"], both["y"]  # x is no shorter than y
        n, m = F.length(x) / 4, F.length(y) / 4
        same = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= m) & (F.substring(x, F.lit(1), 4 * (at + step)) == F.substring(y, F.lit(1), 4 * (at + step))), at + step).otherwise(at))
        rest = F.lit(1 << 30)
        return let(same, lambda at: (n - m <= 1) & (F.substring(x, 4 * (at + 1) + 1, rest) == F.substring(y, 4 * (at + F.when(n == m, 1).otherwise(0)) + 1, rest)))

    swap = F.length(a) < F.length(b)
    points = F.struct(_code_points(F.when(swap, b).otherwise(a)).alias("x"), _code_points(F.when(swap, a).otherwise(b)).alias("y"))
    return F.when(F.length(a) <= 256, F.levenshtein(a, b, 1) >= 0).otherwise(let(points, after_edit))


def _few(keys: DataFrame) -> bool:
    return keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS


def _keep_known(df: DataFrame, on: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose `on` is in keys (one long column, distinct, kept). Few keys go to every task; more than
    FEW_KEYS meet the rows by a shuffle that may be split."""
    return df.join(F.broadcast(keys) if _few(keys) else keys, F.col(on) == F.col(keys.columns[0]), "left_semi")


def _able_lines(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, first, line, lo, hi): the distinct lines with a part in shared, and where an edit of them can be.

    With few keys the lines are taken as they are read. With many, only their places are shuffled, and the text of each
    distinct line that is left is fetched from the document where it comes first."""
    few = _few(shared)
    part = _near_lines(_lines(docs)).select(F.explode_outer(_parts(F.col("line"))).alias("p"), "key", _order().alias("at"), *(["line"] if few else []))
    able = part.withColumn("pk", F.col("p.k")).join(F.broadcast(shared) if few else shared, F.col("pk") == F.col("k"), "left_semi")
    span = (F.min("at").alias("first"), F.min("p.lo").alias("lo"), F.max("p.hi").alias("hi"))
    if few:
        return able.groupBy("key").agg(F.min("line").alias("line"), *span)
    places = able.groupBy("key").agg(*span)
    wanted = places.select(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), F.struct("key", "first", "lo", "hi").alias("w")).groupBy("doc_id", "th").agg(F.collect_list("w").alias("wanted"))
    of_doc = docs.join(wanted, same_doc(docs, wanted)).select(F.split("text", _END, -1).alias("lines"), F.explode("wanted").alias("w"))
    return of_doc.select("w.key", F.element_at("lines", F.col("w.first.line_no") + 1).alias("line"), "w.first", "w.lo", "w.hi").dropDuplicates(["key"])


def _lines(docs: DataFrame) -> DataFrame:
    each = docs.select("doc_id", "th", F.posexplode_outer(F.split("text", _END, -1)).alias("line_no", "line"))
    return each.filter(F.length("line") >= LEAST_CHARS).select("doc_id", "th", "line_no", "line", _hash(F.col("line")).alias("key"))


def _near_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.length("line") >= NEAR_CHARS)


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "line_no", "th")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, th. (key, first, earlier): each distinct line that occurs more than once or has an earlier line
    within one edit. first: its first occurrence. earlier: that of the earliest line within one edit, or null."""
    every = _lines(docs)
    # What an aggregate finds is kept apart from the join that uses it, so that a hot key can be split there.
    part = _near_lines(every).select(F.explode_outer(_parts(F.col("line"))).alias("p"), F.col("key.h1").alias("h1"))
    met = part.groupBy(F.col("p.k").alias("k")).agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b")
    shared = cut(met.select("k"))
    lines = cut(_able_lines(docs, shared))

    # explode_outer, here and above: of a plain explode the optimiser infers a filter that computes the array once more.
    # Variants are rows of two longs until those that meet nothing are gone.
    lines = lines.withColumn("n", F.length("line"))
    variants = lines.select("key", F.explode_outer(let(_code_points(F.col("line")), lambda p: _deletions(p, F.col("n"), F.col("lo"), F.col("hi")))).alias("v"))
    placed = variants.select(F.xxhash64("v.pos", "v.h").alias("vk"), F.col("v.h").alias("h"), F.col("key.h1").alias("h1"), "key")
    several = cut(placed.groupBy("vk").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select(F.col("vk").alias("k")))
    first = lines.select(F.col("key").alias("lk"), "first")
    whole = cut(lines.select(let(_code_points(F.col("line")), lambda p: _whole(p, F.col("n"))).alias("wk"), F.col("key").alias("short"), F.col("first").alias("short_first")))
    # One more pass over the variants finds those that meet another line's variant, and those that are a whole line.
    met_keys = cut(several.unionByName(whole.select(F.col("wk").alias("k"))).distinct())
    hits = _keep_known(placed.select("key", F.explode(F.array("vk", "h")).alias("at_key")), "at_key", met_keys).distinct()
    hits = cut(hits.join(first, F.col("key") == F.col("lk")).select("at_key", "key", "first"))
    best = cut(hits.groupBy(F.col("at_key").alias("k")).agg(F.min("first").alias("best")).join(several, "k", "left_semi"))
    by_replacing = hits.join(best, F.col("at_key") == F.col("k")).select("key", "best")
    # A line and those one character longer: the longer line's variant is the whole of the shorter.
    pairs = hits.join(whole, F.col("at_key") == F.col("wk"))
    longer = pairs.select("key", F.col("short_first").alias("best"))
    shorter = pairs.groupBy(F.col("short").alias("key")).agg(F.min("first").alias("best"))
    partner = by_replacing.unionByName(longer).unionByName(shorter).groupBy(F.col("key").alias("k")).agg(F.min("best").alias("best"))

    # The partner's text is compared with the line's own.
    mine = lines.join(partner, F.col("key") == F.col("k")).filter(F.col("best") < F.col("first")).select("key", "line", "best")
    theirs = lines.select(F.col("first").alias("f"), F.col("line").alias("other"))
    verified = cut(mine.join(theirs, F.col("best") == F.col("f")).filter(_within_one(F.col("line"), F.col("other"))).select(F.col("key").alias("k"), "best"))
    distinct = every.groupBy("key").agg(F.min(_order()).alias("first"), F.count("*").alias("n"))
    both = distinct.join(verified, F.col("key") == F.col("k"), "left").filter("n > 1 or best is not null")
    return cut(both.select("key", "first", F.col("best").alias("earlier")))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, dropped (line numbers from 0), text (of the lines that stay).

    Lines end at a line feed. A line of any length but 0 goes if the same line occurs earlier in the corpus: in order of
    doc_id (null last), then line number. A line of NEAR_CHARS characters or more also goes if another of as many, within
    one edit of it, occurs earlier. Lines that go count as earlier lines for others. Empty lines, null and empty texts stay
    as they are. Rows that repeat a doc_id and text are one
    document and keep the same lines. An empty table gives an empty result. Columns beyond id and text are ignored.
    """
    docs = with_text_hash(documents(df, id_col, text_col))
    bad = repeated_lines(docs)
    places = _lines(docs).select("doc_id", "th", "line_no", "key", _order().alias("here"))
    bad = bad.select(F.col("key").alias("k"), "first", "earlier")
    gone = places.join(bad, F.col("key") == F.col("k")).filter((F.col("here") > F.col("first")) | F.col("earlier").isNotNull())
    by_doc = gone.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))
    both = docs.join(by_doc, docs.doc_id.eqNullSafe(by_doc["__id"]) & (docs.th == by_doc["__th"]), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    lines = F.split("text", _END, -1)
    kept = let(lines, lambda w: F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), dropped), lambda i: F.get(w, i)))
    text = F.when(F.size(dropped) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return both.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"), text.alias("text"))
