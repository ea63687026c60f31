"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of width 2, 3 and 4 run over each window of WINDOW bytes, every filter keeps its largest
value, and a softmax layer over these gives the language. A text's answer is the mean over its windows, which cover
all of it. The network is trained on the driver from a bounded sample of labelled rows: MAX_TRAIN_DOCS documents, or one
for each language if there are more languages, with TRAIN_WINDOWS windows of each. That is 3 MB, or 1 KB a language,
whatever the table's size. Prediction is one pass with no shuffle.

For prediction the first layer is folded into two tables over byte pairs, so a window costs two lookups a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymesh.llm.common import column, documents, id_type

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
MAX_TRAIN_DOCS = 3000
TRAIN_WINDOWS = 4
EPOCHS = 6
UNKNOWN = "und"
MIN_SCORE = 0.4  # keep_identified: under this, no language stands out


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x DIM
    conv: dict[int, np.ndarray]  # by width: width x DIM x FILTERS
    bias: np.ndarray  # of all filters
    dense: np.ndarray
    out: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By the pair of bytes at p: what the filters get from p and p+1; what they get from p+2 and p+3."""
        step = {w: np.einsum("bd,odf->obf", self.embed, c) for w, c in self.conv.items()}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        zero = np.zeros_like(step[3][0])
        front = np.concatenate([pair(step[w][0], step[w][1]) for w in WIDTHS], axis=1)
        back = np.concatenate([pair(step[3][2], zero), pair(step[4][2], step[4][3])], axis=1)
        return np.ascontiguousarray(front, np.float32), np.ascontiguousarray(back, np.float32)

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """windows: n x WINDOW bytes."""
        front, back = tables
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        n, m = pairs.shape
        best = np.empty((n, 3 * FILTERS), np.float32)
        for a in range(0, n, 64):
            p = pairs[a : a + 64]
            value = front[p[:, : m - 2]]
            value[:, :, FILTERS:] += back[p[:, 2:]]
            best[a : a + 64] = value.max(axis=1)
        hidden = np.maximum(best + self.bias, 0)
        return softmax(hidden @ self.dense + self.out)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """windows: n x WINDOW bytes with their languages. Adam on the cross-entropy, in fixed order, so repeatable."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    p = {"embed": rng.normal(0, 0.5, (256, DIM)), "bias": np.zeros(3 * FILTERS), "dense": rng.normal(0, 0.2, (3 * FILTERS, len(languages))), "out": np.zeros(len(languages))}
    p |= {f"conv{w}": rng.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean, var, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = np.bincount(y, minlength=len(languages)).astype(np.float32)
    weight = (len(y) / (len(languages) * np.maximum(weight, 1)))[y].astype(np.float32)
    size = 64
    epochs = max(epochs, min(60, -(-150 * size // max(1, len(y)))))  # at least 150 steps
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            pick = order[at : at + size]
            x, n = windows[pick], len(pick)
            e = p["embed"][x]
            top, where = [], []
            for w in WIDTHS:
                m = WINDOW - w + 1
                unfolded = np.concatenate([e[:, o : o + m] for o in range(w)], axis=2)
                value = unfolded.reshape(n * m, w * DIM) @ p[f"conv{w}"].reshape(w * DIM, FILTERS)
                value = value.reshape(n, m, FILTERS)
                where.append(arg := value.argmax(axis=1))
                top.append(np.take_along_axis(value, arg[:, None, :], 1)[:, 0])
            before = np.concatenate(top, axis=1) + p["bias"]
            hidden = np.maximum(before, 0)
            prob = softmax(hidden @ p["dense"] + p["out"])
            prob[np.arange(n), y[pick]] -= 1
            prob *= weight[pick, None] / n
            g = {"dense": hidden.T @ prob, "out": prob.sum(0)}
            back = (prob @ p["dense"].T) * (before > 0)
            g["bias"] = back.sum(0)
            g["embed"] = np.zeros_like(p["embed"])
            rows = np.arange(n)[:, None]
            for i, w in enumerate(WIDTHS):
                d = back[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"conv{w}"] = np.zeros_like(p[f"conv{w}"])
                for o in range(w):
                    b = x[rows, where[i] + o]  # n x FILTERS
                    g[f"conv{w}"][o] = np.einsum("nfd,nf->df", p["embed"][b], d)
                    np.add.at(g["embed"], b, d[:, :, None] * p[f"conv{w}"][o].T[None])
            t += 1
            for k in p:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                var[k] = 0.999 * var[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - np.float32(0.01) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.999**t)) + 1e-8)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    return Network(languages, p["embed"], {w: p[f"conv{w}"] for w in WIDTHS}, p["bias"], p["dense"], p["out"])


def cut_windows(data: bytes) -> np.ndarray:
    """All of data in windows of WINDOW bytes; the last one reaches back to stay full, a short text gets zeros."""
    n = len(data)
    if n <= WINDOW:
        return np.frombuffer(data.ljust(WINDOW, b"\0"), np.uint8).reshape(1, WINDOW)
    whole = np.frombuffer(data, np.uint8)
    full = whole[: n - n % WINDOW].reshape(-1, WINDOW)
    return full if n % WINDOW == 0 else np.concatenate([full, whole[n - WINDOW :][None]])


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        windows = []
        for text in batch.column("text").to_pylist():
            every = cut_windows(text.encode("utf-8", "surrogatepass"))
            windows.append([every[i].tobytes() for i in np.unique(np.linspace(0, len(every) - 1, TRAIN_WINDOWS).astype(int))])
        yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), batch.column("at"), pa.array(windows, pa.list_(pa.binary()))], ["doc_id", "lang", "at", "windows"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAIN_DOCS, max_languages: int | None = None) -> DataFrame | None:
    """(lang, windows): of each language the same share of max_docs, one row at least, or all rows where it has fewer;
    those that come first by a hash of the id. None if no row has a label.

    A language's rows are thinned to about twice its share where they are read, so no more than that meets by language.
    max_languages: only so many of the most frequent labels; by default all are learned.
    """
    rows = df.select(df[id_col].cast("string").alias("doc_id"), column(df, text_col, "string").alias("text"), column(df, lang_col, "string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    ranked = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    counts = (ranked if max_languages is None else ranked.limit(max_languages)).collect()  # the vocabulary of labels
    if not counts:
        return None
    share = max(1, max_docs // len(counts))
    part = df.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * share + 30) / r["count"])) for r in counts], "of string, part double")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    thin = rows.join(F.broadcast(part), F.col("lang") == F.col("of")).withColumn("at", at).filter(F.col("at") < F.col("part") * (1 << 30))
    lettered = thin.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang", "at")
    windows = lettered.mapInArrow(_training_windows, "doc_id string, lang string, at long, windows array<binary>")
    first = F.row_number().over(W.partitionBy("lang").orderBy("at", "doc_id", F.xxhash64("windows")))
    return windows.withColumn("n", first).filter(F.col("n") <= share).select("lang", "windows")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAIN_DOCS, max_languages: int | None = None) -> Network | None:
    """The network, from the training_sample of labelled rows outside the held-out quarter; None if there are none.

    Rows with null id, label or text, or a text without letters, aren't learned from.
    """
    sample = training_sample(df, id_col, text_col, lang_col, max_docs, max_languages)
    got = [(r["lang"], bytes(w)) for r in sample.collect() for w in r["windows"]] if sample is not None else []
    if not got:
        return None
    got.sort()  # the same network however the rows came
    windows = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, WINDOW)
    return train(windows, [lang for lang, _ in got])


def _predictor(network: Network, id_arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in batches:
            letters = batch.column("letters").to_pylist()
            lang, score = [UNKNOWN] * len(letters), np.zeros(len(letters))
            group: list[int] = []
            parts: list[np.ndarray] = []
            size = 0

            def flush() -> None:
                if not group:
                    return
                prob = network.probabilities(np.concatenate(parts), tables)
                first = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
                mean = np.add.reduceat(prob, first, axis=0, dtype=np.float64) / np.array([len(p) for p in parts])[:, None]
                for i, row in zip(group, mean):
                    lang[i], score[i] = network.languages[int(row.argmax())], min(1.0, float(row.max()))

            for i, text in enumerate(batch.column("text").to_pylist()):
                if letters[i]:
                    group.append(i)
                    parts.append(cut_windows(text.encode("utf-8", "surrogatepass")))
                    size += len(parts[-1])
                    if size >= 2048:
                        flush()
                        group, parts, size = [], [], 0
            flush()
            yield pa.record_batch([batch.column("doc_id").cast(id_arrow), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    und with score 0 for null or empty texts, texts without a letter, and all texts if there was nothing to learn
    from. A null id is not held out. Repeated rows each get their row; an empty table gives an empty result. Columns
    beyond id and text are ignored.
    """
    docs = documents(df, id_col, text_col).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    if network is None:
        out = docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        kind = id_type(df, id_col)
        out = docs.mapInArrow(_predictor(network, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, network: Network | None, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """df without the rows whose language can't be told: und, or a score under min_score. One pass, no shuffle.

    With no network (nothing to learn from) only rows without letters go. Null texts go; repeated rows are judged alike;
    an empty table gives an empty result; all columns stay as they are.
    """
    names = df.columns
    marked = df.withColumn("__letters", F.coalesce(df[text_col].rlike(r"\p{L}"), F.lit(False)))
    if network is None:
        return marked.filter("__letters").drop("__letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(network, pa.string())
        for batch in batches:
            one = pa.record_batch([pa.nulls(batch.num_rows, pa.string()), batch.column(text_col), batch.column("__letters")], ["doc_id", "text", "letters"])
            found = next(predict(iter([one])))
            lang, score = found.column("lang_pred").to_pylist(), found.column("score").to_pylist()
            keep = pa.array([x != UNKNOWN and s >= min_score for x, s in zip(lang, score)], pa.bool_())
            yield batch.select(names).filter(keep)

    return marked.mapInArrow(run, df.schema)
