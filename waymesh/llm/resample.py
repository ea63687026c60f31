"""Importance resampling towards a target distribution, on hashed n-grams.

Two passes over the texts, neither with a shuffle of them. In the first each task counts its features in a vector of
BUCKETS longs (np.bincount), and treeReduce adds the vectors up, so the driver and every task hold a few of 80 kB at any
size. Of the corpus's vector and the target's comes a gain for each bucket. The second pass looks the gains of each
document's features up in a broadcast vector and sums them by document (np.bincount with weights).

What is drawn are the highest scores: weight and Gumbel noise from a hash of the id. Scores are whole numbers within some
ten thousands, so counting them finds the score at which the draw ends; only what reaches it is sorted for its rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from waymesh.llm.common import column, cut, documents, id_type
from waymesh.session import with_dense_ids

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
PIECE = 1 << 20  # bytes of a text that are cut into words at once

#: Lower case for A-Z; every byte of [\x00-\x2F\x3A-\x60\x7B-\x7F] that is then left becomes a space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """The bucket of a feature, worked out once for as long as it is remembered."""

    MOST = 1 << 18

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.n
        return bucket


def word_parts(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in parts of about PIECE bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _features(words: list[bytes], before: list[bytes], shortest: int, longest: int) -> Iterator[bytes]:
    """The runs that end in words; before: the words right before them, longest - 1 at most."""
    every = before + words
    for n in range(shortest, longest + 1):
        if n == 1:
            yield from words
        else:
            for i in range(max(0, len(before) - n + 1), len(every) - n + 1):
                yield b" ".join(every[i : i + n])


def _scan(texts: list[str | None], buckets: _Buckets, runs: tuple[int, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of each part of each text: the text's place, how many words, the buckets of the features."""
    shortest, longest = runs
    for i, text in enumerate(texts):
        before: list[bytes] = []
        for words in word_parts(text):
            found = words if longest == 1 else list(_features(words, before, shortest, longest))
            yield i, len(words), np.fromiter(map(buckets.__getitem__, found), np.int64, len(found))
            before = (before + words)[len(before) + len(words) - longest + 1 :] if longest > 1 else before


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    for a in range(0, len(texts), 256):
        yield a, texts.slice(a, 256).to_pylist()


def _counter(n: int, runs: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, buckets = np.zeros(n, np.int64), _Buckets(n)
        for batch in batches:
            for _, texts in _batches(batch.column("text")):
                parts = [found for _, _, found in _scan(texts, buckets, runs)]
                if parts:
                    total += np.bincount(np.concatenate(parts), minlength=n)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return run


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, runs: tuple[int, int] = (1, 1)) -> np.ndarray:
    """How many features of all texts of df are in each bucket. runs: the shortest and the longest run of words that is a
    feature. Null and empty texts have none, repeated rows count each time."""
    texts = df.select(column(df, text_col, "string").alias("text"))
    vectors = texts.mapInArrow(_counter(buckets, runs), "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r.counts), np.int64))
    if vectors.getNumPartitions() == 0:
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add, depth=3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 ln(share in the target / share in the source)), both smoothed by one feature for each bucket."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigher(gain: Broadcast, runs: tuple[int, int], columns: list[str], text_at: str, schema: pa.Schema):
    """Adds n_words, n_features and weight to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = gain.value
        buckets = _Buckets(len(vector))
        for batch in batches:
            for a, texts in _batches(batch.column(text_at)):
                words, of, found = np.zeros(len(texts), np.int64), [], []
                for i, n, some in _scan(texts, buckets, runs):
                    words[i] += n
                    of.append(np.full(len(some), i))
                    found.append(some)
                if found:
                    owner, every = np.concatenate(of), np.concatenate(found)
                    n_features = np.bincount(owner, minlength=len(texts))
                    sums = np.bincount(owner, weights=vector[every], minlength=len(texts)).astype(np.int64)  # whole and below 2**53: exact
                else:
                    n_features = sums = np.zeros(len(texts), np.int64)
                weight = sums // np.maximum(n_features, 1)
                rows = batch.slice(a, len(texts)).select(columns)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(words), pa.array(n_features), pa.array(weight)], schema=schema)

    return run


def _noisy(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds score: weight and Gumbel noise from the hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(df[id_col].cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return df.withColumn("score", F.col("weight") + noise)


def _weighed(df: DataFrame, names: list[str], gain: Broadcast, runs: tuple[int, int], text_col: str) -> DataFrame:
    """names of df, n_words, n_features and weight."""
    kept = df.select(*names, *([] if text_col in names else [text_col]))
    fields = [kept.schema[c] for c in names]
    added = ("n_words", "n_features", "weight")
    arrow = pa.schema([*(pa.field(f.name, to_arrow_type(f.dataType)) for f in fields), *(pa.field(a, pa.int64()) for a in added)])
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), *(T.StructField(a, T.LongType()) for a in added)])
    return kept.mapInArrow(_weigher(gain, runs, names, text_col, arrow), schema)


class Importance:
    """The weights and scores of df's documents against target's texts, and where the draw of percent of those with
    least_words words or more ends. The vectors are counted and the scores written when it is made."""

    def __init__(
        self,
        df: DataFrame,
        target: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        target_text_col: str = "text",
        buckets: int = BUCKETS,
        runs: tuple[int, int] = (1, 1),
        least_words: int = LEAST_WORDS,
        percent: int = PERCENT,
        seed: int = SEED,
    ):
        if not 1 <= runs[0] <= runs[1] or not 0 <= percent <= 100 or buckets < 1:
            raise ValueError("runs must rise from 1, percent be within 0 and 100, and buckets be positive")
        self.df, self.id_col, self.text_col, self.runs, self.least_words, self.seed = df, id_col, text_col, runs, least_words, seed
        self.kind = id_type(df, id_col)
        self.gains = gains(bucket_counts(df, text_col, buckets, runs), bucket_counts(target, target_text_col, buckets, runs))
        self.gain = df.sparkSession.sparkContext.broadcast(self.gains)
        self.scores = cut(_noisy(_weighed(documents(df, id_col, text_col), ["doc_id"], self.gain, runs, "text"), "doc_id", seed))
        counts = dict(self.scores.filter(F.col("n_words") >= least_words).groupBy("score").count().collect())  # some ten thousand scores
        self.drawn = percent * sum(counts.values()) // 100
        self.end, left = None, self.drawn  # the least score that is drawn
        for score in sorted(counts, reverse=True):
            if left <= 0:
                break
            self.end, left = score, left - counts[score]

    def table(self) -> DataFrame:
        """One row for each document: doc_id, n_words, n_features, weight, score, rank (null: not drawn)."""
        names = ["doc_id", "n_words", "n_features", "weight", "score"]
        if self.end is None:
            return self.scores.select(*names, F.lit(None).cast("long").alias("rank"))
        reaches = (F.col("n_words") >= self.least_words) & (F.col("score") >= self.end)
        top = with_dense_ids(self.scores.filter(reaches), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), name="at")
        ranked = top.select(*names, F.when(F.col("at") < self.drawn, F.col("at") + 1).alias("rank"))
        return ranked.unionByName(self.scores.filter(~reaches).select(*names, F.lit(None).cast("long").alias("rank")))

    def sample(self) -> DataFrame:
        """The drawn rows of df, with all their columns, in a further pass without a shuffle. Rows that tie with the last
        one in score and id come along, so copies of a row stay together."""
        if self.end is None:
            return self.df.limit(0)
        last = self.table().filter(F.col("rank") == self.drawn).select("doc_id").first()
        names = self.df.columns
        inner = self.df.select(F.struct(*names).alias("row"), column(self.df, self.text_col, "string").alias("text"), self.df[self.id_col].alias("doc_id"))
        scored = _noisy(_weighed(inner, ["row", "doc_id"], self.gain, self.runs, "text"), "doc_id", self.seed)
        tie = F.lit(True) if last.doc_id is None else F.col("doc_id") <= F.lit(last.doc_id)  # ids are drawn from the least, nulls last
        drawn = (F.col("n_words") >= self.least_words) & ((F.col("score") > self.end) | ((F.col("score") == self.end) & tie))
        return scored.filter(drawn).select("row.*")


def importance(df: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """One row for each document of df: doc_id, n_words, n_features, weight, score, rank. settings: those of Importance.

    Words are runs of letters, digits and bytes over 127, with A-Z lower-cased. weight is the floored mean of the gains of a
    document's features, 0 without any. rank counts the drawn documents from 1 in order of falling score, ties to the smaller
    id; it is null for the others. Null and empty texts have no words and are never drawn while least_words is over 0; a null
    id is hashed as an empty one and comes last in a tie. Repeated rows each have a row and a rank. An empty target gives
    gains from smoothing alone, an empty table an empty result. Columns beyond id and text are ignored.
    """
    return Importance(df, target, **settings).table()


def resample(df: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of df that importance() draws, whole."""
    return Importance(df, target, **settings).sample()


SQL = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    dw AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY r, f),
    bw AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM b) GROUP BY f),
    words AS (SELECT DISTINCT f FROM (SELECT f FROM dw UNION ALL SELECT f FROM bw)),
    hashed AS (
        SELECT f, xor(list_reduce([4294967295] || list_transform(range(1, CAST(strlen(f) AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i - 1, 2) AS BIGINT)),
            lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 10000 AS bucket
        FROM words),
    s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (f) GROUP BY bucket),
    t AS (SELECT bucket, sum(n) AS t FROM bw JOIN hashed USING (f) GROUP BY bucket),
    total AS (SELECT (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) AS s, (SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) AS t),
    gain AS (
        SELECT s.bucket, CAST(floor(1000 * ln((CAST(coalesce(t.t, 0) AS DOUBLE) + 1) * (total.s + 10000) / ((CAST(s.s AS DOUBLE) + 1) * (total.t + 10000)))) AS BIGINT) AS gain
        FROM s LEFT JOIN t USING (bucket), total),
    weights AS (SELECT r, sum(n * gain) AS g FROM dw JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY r),
    scored AS (
        SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE floor(CAST(g AS DOUBLE) / len(w)) END AS BIGINT) AS weight,
            CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
        FROM d LEFT JOIN weights USING (r)),
    placed AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id, n_features, weight) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)"""
