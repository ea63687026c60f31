"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every text by regular expressions. Split and extract_all by the same expression give what
stands between matches and the matches themselves; a running sum of their lengths over each row's matches gives positions
in code points, in time that grows with the matches. Each candidate's value is then looked up over the whole corpus by its
hash: in how many repositories and under how many owners it occurs. A value that several owners or many repositories have is
a widely copied example; one that a single owner has in few repositories, and that looks random, is taken for live. Owners
and repositories are made distinct before any shuffle, so a value in a third of all rows is summed where it is found; the
join back carries one row for each value and may be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymesh.llm.common import column, cut

#: The patterns of the base scan, in the order of their kinds. "raw": what is matched; "least": characters
#: that "part" of it must have. A run of hex digits or of an access key's characters is matched whole or not at all, so
#: there the least length is part of the pattern; an assignment is matched first and then judged.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WIDE_OWNERS = 3  # owners from which a value counts as a copied example
WIDE_REPOSITORIES = 10  # the same for distinct repositories, whoever owns them
LIVE_LENGTH = 16  # characters that a live-looking value has at least
LIVE_ENTROPY = 2.8  # bits a character that it has at least, by the frequency of its own characters
#: Runs that people type, but chance hardly makes.
TYPED = r"(?i)example|sample|dummy|changeme|placeholder|password|secret|your|test|qwerty|abcdef|12345|(.)\1\1\1"


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<rank, gap, len, value>>: the leftmost non-overlapping matches, each with the length of what stands
    before it; value is group 1 or the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len")))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "assign" else found
    matches = F.zip_with(lengths, values, lambda n, v: F.struct(F.lit(KINDS.index(kind)).alias("rank"), n["gap"].alias("gap"), n["len"].alias("len"), v.alias("value")))
    return F.when(text.rlike(pattern), matches).otherwise(F.array().cast("array<struct<rank:int,gap:int,len:int,value:string>>"))


def matches(text: Column) -> Column:
    """Those of all kinds, kind by kind."""
    return F.concat(_matches(text, ASSIGN, "assign"), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex"))


def base_spans(rows: DataFrame) -> DataFrame:
    """rows: row, found (matches). (row, start, rank, end, value): all base spans. Where a row has a million matches they are
    summed by a window over that row, not within an array that grows."""
    each = rows.select("row", F.posexplode("found").alias("n", "m"))
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(W.partitionBy("row", "m.rank").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    spans = each.select("row", (end - F.col("m.len")).cast("int").alias("start"), F.col("m.rank").alias("rank"), end.cast("int").alias("end"), F.col("m.value").alias("value"))
    return spans.filter((F.col("rank") > 0) | (F.length("value") >= ASSIGN_LEAST))


def entropy(value: Column) -> Column:
    """Bits a character, by the frequency of the value's own characters."""
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda h, c: h - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def looks_random(value: Column) -> Column:
    """Long, of digits and letters, of high entropy, and without what people type."""
    return (F.length(value) >= LIVE_LENGTH) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(TYPED) & (entropy(value) >= LIVE_ENTROPY)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "copied", "live")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str | None = None, owner_col: str = "source", wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live, spread.

    spans has the base spans and, for a value that wide_owners owners or wide_repositories repositories or more have,
    copied:start:end; for one that a single owner has in fewer repositories and that looks_random, live:start:end. spread has start:end:owners:repositories of each place. The repository is repository_col, or the document itself. Null text counts as empty; null owners and repositories count as one owner
    and one repository. Repeated rows each get their row and count as one repository. An empty table gives an empty
    result. Columns beyond those named are ignored.
    """
    text = F.coalesce(column(df, text_col, "string"), F.lit(""))
    repository = column(df, repository_col or id_col, "string")
    rows = df.select(df[id_col].alias("doc_id"), matches(text).alias("found"), repository.alias("repository"), column(df, owner_col, "string").alias("owner"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))

    spans = base_spans(rows.filter(F.size("found") > 0))
    of = rows.select(F.col("row").alias("r"), "owner", "repository")
    every = cut(spans.join(of, F.col("row") == F.col("r")).select("row", "start", "rank", "end", F.sha2("value", 256).alias("secret"), looks_random(F.col("value")).alias("random"), "owner", "repository"))
    # Distinct owners and distinct repositories of each value: a repository of two owners counts once.
    each = every.select("secret", F.explode(F.array(F.struct(F.lit(True).alias("owns"), F.col("owner").alias("name")), F.struct(F.lit(False).alias("owns"), F.col("repository").alias("name")))).alias("by"))
    distinct = each.select("secret", "by.owns", "by.name").distinct()
    # Kept apart, so that the join below has a plain exchange on both sides and a hot value can be split.
    spread = cut(distinct.groupBy(F.col("secret").alias("k")).agg(F.count_if("owns").alias("owners"), F.count_if(~F.col("owns")).alias("repositories")))

    wide = (F.col("owners") >= wide_owners) | (F.col("repositories") >= wide_repositories)
    judged = F.when(wide, F.lit(KINDS.index("hex") + 1)).when((F.col("owners") == 1) & F.col("random"), F.lit(KINDS.index("hex") + 2))
    met = every.join(spread, F.col("secret") == F.col("k")).select("row", "start", "rank", "end", judged.alias("verdict"), "owners", "repositories")
    added = F.collect_set(F.when(F.col("verdict").isNotNull(), F.struct("start", F.col("verdict").alias("rank"), "end")))  # nulls aren't collected
    places = F.array_sort(F.collect_set(F.struct("start", "end", "owners", "repositories")))
    by_row = met.groupBy(F.col("row").alias("r")).agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("base"), added.alias("added"), places.alias("places"), *[F.count_if(F.col("rank") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    )
    judged_as = lambda rank: F.size(F.filter("added", lambda s: s["rank"] == rank)).cast("long")
    by_row = by_row.select(
        "r",
        *[f"n_{k}" for k in KINDS],
        _joined(F.col("base")).alias("base"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        judged_as(len(KINDS)).alias("n_copied"),
        judged_as(len(KINDS) + 1).alias("n_live"),
        F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"), p["owners"].cast("string"), p["repositories"].cast("string"))), ",").alias("spread"),
    )
    out = rows.select("doc_id", "row").join(by_row, F.col("row") == F.col("r"), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    words = lambda c: F.coalesce(c, F.lit(""))
    return out.select("doc_id", *[count(f"n_{k}") for k in KINDS], F.sha2(words("base"), 256).alias("base_sha256"), words("spans").alias("spans"), count("n_copied"), count("n_live"), words("spread").alias("spread"))
