"""A quality classifier over document statistics: random Fourier features, ridge, isotonic calibration.

Some twenty statistics of a text are standardised and mapped to ``FEATURES`` cosines of random
projections, whose inner products approximate a Gaussian kernel. Every task adds up its part of the
normal equations of a ridge regression on the labels; the sums, of a size that depends on ``FEATURES``
alone, are solved on the driver. The scores of the training rows are counted in ``BINS`` bins and made
monotone by pooling adjacent violators, which gives a calibrated value from 0 to 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import Words, raw, row_chunks, settled, table

FEATURES = 384
RIDGE = 1e-4
BINS = 2048
SEED = 9
THRESHOLD = 0.3

# Standardised statistics are cut off here, so that one odd text cannot leave the kernel's range.
FAR = 6.0

BLANKS = bytes([0x20, *range(0x09, 0x0E)])

_classes = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "blank": b" \t",
    "newline": b"\n\r",
    "stop": b".,;:!?",
    "quote": b"'\"()-",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "control": [*range(9), 11, 12, *range(14, 32), 127],
    "wide": range(128, 256),
}

STATISTICS = [
    "log_bytes", "log_words", "word_mean", "word_spread", "distinct_words", "top_word", "symbol_ends",
    "line_mean", "distinct_lines", "short_lines", "entropy", *_classes,
]


def _per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)


def _distinct_and_top(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number of distinct keys and the count of the most frequent one."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1]))))
    counts, owner = np.diff(np.append(new, len(k))), r[new]
    top = np.zeros(n)
    np.maximum.at(top, owner, counts)
    return np.bincount(owner, minlength=n).astype(float), top


def statistics(data: np.ndarray, at: np.ndarray, words: Words, lines: Words) -> np.ndarray:
    """(rows, statistics) of the texts that lie one after another in ``data``; an empty text has zeros."""
    n, size = len(at) - 1, np.diff(at).astype(float)
    row = np.repeat(np.arange(n), np.diff(at))
    some = np.maximum(size, 1)
    out: dict[str, np.ndarray] = {"log_bytes": np.log1p(size)}
    histogram = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256) if len(data) else np.zeros((n, 256))
    share = histogram / some[:, None]
    out["entropy"] = -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0).sum(axis=1)
    for name, members in _classes.items():
        out[name] = share[:, list(members)].sum(axis=1)

    starts, ends = words.bounds(data, at)
    owner = np.searchsorted(at, starts, "right") - 1
    length = (ends - starts).astype(float)
    count = np.bincount(owner, minlength=n).astype(float)
    many = np.maximum(count, 1)
    out["log_words"] = np.log1p(count)
    out["word_mean"] = _per_row(length, owner, n) / many
    out["word_spread"] = np.sqrt(np.maximum(_per_row(length**2, owner, n) / many - out["word_mean"] ** 2, 0))
    distinct, top = _distinct_and_top(words.hashes(data, starts, ends), owner, n)
    out["distinct_words"], out["top_word"] = distinct / many, top / many
    odd = np.zeros(256)
    odd[list(_classes["symbol"])] = 1
    odd[ord("!")] = 1
    out["symbol_ends"] = _per_row(odd[data[ends - 1]] if len(ends) else np.zeros(0), owner, n) / many

    starts, ends = lines.bounds(data, at)
    owner = np.searchsorted(at, starts, "right") - 1
    length = (ends - starts).astype(float)
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    out["line_mean"] = np.log1p(_per_row(length, owner, n) / count)
    distinct, _ = _distinct_and_top(lines.hashes(data, starts, ends), owner, n)
    out["distinct_lines"] = distinct / count
    out["short_lines"] = _per_row(length < 30, owner, n) / count
    return np.stack([out[s] for s in STATISTICS], axis=1)


def batch_statistics(column: pa.Array) -> np.ndarray:
    words, lines = Words(BLANKS), Words(b"\n\r")
    data, at = raw(column)
    parts = [
        statistics(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], words, lines) for lo, hi in row_chunks(at)
    ]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): the statistics of every whole text, about 200 bytes a row."""

    def go(batches):
        for batch in batches:
            x = batch_statistics(batch.column(1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(go, "doc_id bigint, stats array<double>")


@dataclass
class Model:
    """All that scoring needs; its size is fixed by FEATURES and BINS."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    at: np.ndarray | None = None
    value: np.ndarray | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """The random features and a constant."""
        rng = np.random.default_rng(SEED)
        d = x.shape[1]
        directions, phase = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.spread, -FAR, FAR)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + phase), np.ones((len(x), 1))])

    def plain(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.cosines(x[i : i + 4096]) @ self.weights for i in range(0, len(x), 4096)] or [np.zeros(0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1. Without any labelled row every text scores one half."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.plain(x), self.at, self.value), 0, 1)


def pooled(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values by weighted least squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fitted(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows whose crc32(doc_id as text) is not divisible by five.

    Standardisation uses all rows of ``stats``. A document labelled twice counts twice; a null label
    counts for nothing.
    """
    k = len(STATISTICS)
    total = stats.agg(
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(k)],
    ).first()
    mean = np.array([total[f"m{i}"] or 0.0 for i in range(k)])
    spread = np.array([max(total[f"s{i}"] or 0.0, 1e-9) for i in range(k)])
    model = Model(mean, spread)
    own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label")).where("label IS NOT NULL")
    train = settled(stats.where(~held_out()).join(own, "doc_id").select("stats", "label"))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)

    def sums(batches):
        whole = np.zeros((FEATURES + 1, FEATURES + 3))
        for batch in batches:
            x, y = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 4096):
                z, t = model.cosines(x[i : i + 4096]), y[i : i + 4096]
                whole[:, : FEATURES + 1] += z.T @ z
                whole[:, FEATURES + 1] += z.T @ t
                whole[:, FEATURES + 2] += len(t)
        if whole[0, -1]:
            rows = [r.tobytes() for r in whole]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["i", "sums"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "sums": [sum(np.frombuffer(b) for b in frame["sums"]).tobytes()]})

    rows = train.mapInArrow(sums, "i int, sums binary").groupBy("i").applyInPandas(added, "i int, sums binary").collect()
    if not rows:
        return model
    whole = np.stack([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["i"])])
    n = whole[0, -1]
    penalty = RIDGE * n * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(whole[:, : FEATURES + 1] + penalty, whole[:, FEATURES + 1])

    lo, hi = -0.5, 1.5

    def counted(batches):
        hits = np.zeros((BINS, 2))
        for batch in batches:
            s = model.plain(matrix(batch.column(0)))
            bins = np.clip(((s - lo) / (hi - lo) * BINS).astype(int), 0, BINS - 1)
            np.add.at(hits, bins, np.stack([np.ones(len(s)), batch.column(1).to_numpy(zero_copy_only=False)], axis=1))
        full = np.flatnonzero(hits[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(hits[full, 0]), pa.array(hits[full, 1])], names=["bin", "n", "good"])

    bins = train.mapInArrow(counted, "bin bigint, n double, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    found = bins.toPandas().sort_values("bin")
    model.at = lo + (found["bin"].to_numpy() + 0.5) * (hi - lo) / BINS
    model.value = pooled((found["good"] / found["n"]).to_numpy(), found["n"].to_numpy())
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from measured statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(go, "doc_id bigint, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns; nothing is joined or shuffled."""
    model = fitted(settled(measured(docs)), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        for batch in batches:
            score = shared.value.score(batch_statistics(batch.column("row").field("text")))
            yield batch.filter(pa.array(score >= threshold))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(go, rows.schema).select("row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = settled(measured(table(spark, sf_dir, "documents")))
    model = fitted(stats, table(spark, sf_dir, "labels"))
    return scored(stats, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
