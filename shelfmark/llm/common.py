"""What the operators share: the scratch folder, raw texts of an Arrow batch, hashed words."""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A task hashes texts in pieces of about so many bytes, which bounds its arrays.
PIECE = 1 << 20

_local_root: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder that the session names.

    A folder of this machine is taken only where none is named and the session runs in one
    process, as in tests; elsewhere a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="llm-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there."""
    path = path or scratch(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def told_apart(docs: DataFrame) -> DataFrame:
    """(row, id, text): all columns of each document, and a number that no other document has.

    Numbers follow doc_id, then a hash of the text; documents without doc_id come last. Rows that are equal in doc_id and
    text are one document, except those without doc_id, each of which is one. The number is the doc_id where that tells
    all documents apart; otherwise the rows are written once with their numbers.
    """
    id_, text = F.col("row.doc_id").cast("long"), F.col("row.text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hash_ = F.xxhash64(text, text.isNull())
    plain = rows.select("row", id_.alias("id"), text.alias("text"))
    shared = rows.select(id_.alias("id"), hash_.alias("hash")).groupBy("id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    if shared.where("id IS NULL OR lo <> hi").isEmpty():
        return plain
    order = ["late", "doc_id", "hash", "copy"]
    once = settled(rows.withColumn("place", F.monotonically_increasing_id()))
    copy = F.when(id_.isNull(), F.col("place")).otherwise(F.lit(0).cast("long"))
    keys = once.select("place", id_.isNull().alias("late"), id_.alias("doc_id"), hash_.alias("hash"), copy.alias("copy"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settled(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    ranked = settled(ranged.withColumn("rank", F.dense_rank().over(Window.partitionBy("part").orderBy(*order)).cast("long")).select("place", "part", "rank"))
    ends, starts = 0, []
    for part, most in sorted(map(tuple, ranked.groupBy("part").agg(F.max("rank")).collect())):  # a row for each partition
        starts.append((part, ends))
        ends += most
    first = F.broadcast(docs.sparkSession.createDataFrame(starts, "part int, start bigint"))
    numbers = ranked.join(first, "part").select("place", (F.col("start") + F.col("rank")).alias("id"))
    numbered = settled(once.join(numbers, "place").select("row", "id"))
    return numbered.select("row", "id", text.alias("text"))


_sent: set[str] = set()


# Rows go to Python in batches of at most so many bytes; Spark's own limit is a number of rows.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, as ``--py-files`` would.

    It also bounds the session's Arrow batches by bytes, as rows may be long texts.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="llm-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query`` after the package has been sent; its first argument is the session."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return query(spark, *rest)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def row_chunks(at: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * PIECE:
            _powers[base] = have
    return have[:n]


def byte_values(fold: bool, seed: int = 7) -> np.ndarray:
    """A random 64-bit value for each byte; with ``fold`` A-Z share those of a-z."""
    values = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)
    if fold:
        values[65:91] = values[97:123]
    return values


LONG_WORD = 256


class Words:
    """Finds and hashes the words of many texts at once.

    ``breaks`` are the bytes between words; every other byte, those of UTF-8 sequences
    included, is part of a word. A-Z count as a-z. Words are equal when their hashes are: 64 bits of
    a random polynomial, mixed. Its sums are taken modulo 2**64, which long words of a certain build would
    defeat (from 1,024 bytes on), so words over ``LONG_WORD`` bytes take 64 bits of a cryptographic hash.
    """

    def __init__(self, breaks: bytes):
        self.is_word = np.ones(256, bool)
        self.is_word[list(breaks)] = False
        self.values = byte_values(fold=True)

    def bounds(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every word; no word goes over the end of a row."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = self.is_word[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = at[:-1] < at[1:]
        begins, ends = at[:-1][full], at[1:][full] - 1
        first[begins], last[ends] = inside[begins], inside[ends]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, "right")))
            base, n = int(starts[lo]), int(ends[hi - 1] - starts[lo])
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.values[data[base : base + n]] * powers(_BASE, n), out=sums[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = mixed((sums[e] - sums[s]) * powers(_INVERSE, n)[s])
            lo = hi
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            word = data[starts[i] : ends[i]].tobytes().lower()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, number of words before each row and in all)."""
        starts, ends = self.bounds(data, at)
        return self.hashes(data, starts, ends), np.searchsorted(starts, at, "left")


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, over row ends too: callers take those within a row."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    return mixed(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n])
