"""Target-distribution importance resampling: draw the documents that look most like a target, with Gumbel noise.

Every feature of a document, a run of words, falls into one of a fixed number of buckets. The buckets of the corpus and of the target
are counted over all their texts; the logarithm of their ratio is a gain for each bucket. The gains are an array that every task
holds, and a document's weight is the sum of the array's entries at its features. With the noise of its doc_id added, the documents of
the highest scores are a sample drawn by the weights.

Which they are is found on the written scores alone, by halving the range of scores and counting how many lie
above, exactly, then the range of the doc_ids tied on the last score. The drawn rows are then cut into ranges and numbered within.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import Words, raw, row_chunks, settled, table
from shelfmark.llm.decontaminate import BREAKS

RUNS = (1, 1)
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

# A count job counts at the middles of so many halvings to come, 2**HALVINGS - 1 places.
HALVINGS = 5

# Features up to so many bytes are hashed together, a byte of all of them at a time.
TOGETHER = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each range of ``data``."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(sizes > TOGETHER).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    short = np.flatnonzero(sizes <= TOGETHER)
    order = short[np.argsort(-sizes[short].astype(np.int8), kind="stable")]
    at, left = starts[order], sizes[order]
    # left falls along order, so those with a j-th byte come first.
    more = len(order) - np.searchsorted(left[::-1], np.arange(TOGETHER + 1), "right")
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        k = more[j]
        c[:k] = CRC[(c[:k] ^ data[at[:k] + j]) & 0xFF] ^ (c[:k] >> np.uint32(8))
    out[order] = ~c
    return out


def features(data: np.ndarray, at: np.ndarray, runs: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, row of each feature, words of each row) of texts with the bytes ``data``."""
    data = FOLD[data]
    starts, ends = Words(BREAKS).bounds(data, at)
    first = np.searchsorted(starts, at, "left")
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    if runs[1] > 1 and len(starts):
        # Words behind one another with one blank between, so a run of words is a range of bytes.
        sizes = ends - starts
        begins = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int(begins[-1] + sizes[-1]), 0x20, np.uint8)
        inside = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        joined[inside + np.repeat(begins - starts, sizes)] = data[inside]
        data, starts, ends = joined, begins, begins + sizes
    found, rows = [], []
    for n in range(runs[0], runs[1] + 1):
        last = len(starts) - n + 1
        if last <= 0:
            break
        whole = row[:last] == row[n - 1 :]
        found.append(crc32(data, starts[:last][whole], ends[n - 1 :][whole]).astype(np.int64) % buckets)
        rows.append(row[:last][whole])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *rows]), np.diff(first)


def bucket_counts(docs: DataFrame, runs: tuple[int, int] = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of all texts; a task counts its own before anything is shuffled."""

    def go(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            data, at = raw(batch.column(0))
            for lo, hi in row_chunks(at):
                found, _, _ = features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], runs, buckets)
                counts += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(counts[there])], names=["bucket", "n"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(go, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the ``bucket_counts`` of both: an array of ``buckets`` whole numbers."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((corpus, s), (target, t)):
        for bucket, n in counts.collect():  # a row per bucket at most
            into[bucket] = n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the id; a null id is written as nothing."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, carry: list[str], runs: tuple[int, int] = RUNS, seed: int = SEED) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, place), written once. ``row`` holds the columns ``carry``, ``place`` tells rows apart."""
    buckets = len(gain)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.select("row", "doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight")])
    names = out.columns

    def go(batches):
        for batch in batches:
            data, at = raw(batch.column(2))
            numbers = np.zeros((3, batch.num_rows), np.int64)
            for lo, hi in row_chunks(at):
                found, row, words = features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], runs, buckets)
                numbers[0, lo:hi] = words
                numbers[1, lo:hi] = np.bincount(row, minlength=hi - lo)
                # Sums of whole numbers below 2**53 are exact in doubles.
                numbers[2, lo:hi] = np.bincount(row, gain[found], minlength=hi - lo).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, numbers)], names=names)

    found = own.mapInArrow(go, out.schema)
    return settled(found.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("place")))


def nth(rows: DataFrame, value: Column, k: int) -> tuple[int, int]:
    """(the k-th smallest ``value``, how many are smaller), for 1 <= k <= rows, by halving the range of values and counting."""
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    below = 0  # values under lo
    while lo < hi:
        # Of the next halvings, whichever way they go, all middles.
        spans, middles = [(lo, hi)], []
        for _ in range(HALVINGS):
            halves = []
            for a, b in spans:
                if a < b:
                    middle = (a + b) // 2
                    middles.append(middle)
                    halves += [(a, middle), (middle + 1, b)]
            spans = halves
        counts = rows.agg(*[F.count_if(value <= m) for m in middles]).first()
        upto = dict(zip(middles, counts, strict=True))
        while lo < hi and (lo + hi) // 2 in upto:
            middle = (lo + hi) // 2
            if upto[middle] >= k:
                hi = middle
            else:
                below, lo = upto[middle], middle + 1
    return lo, below


def drawing_order() -> list[Column]:
    """Highest score, smallest doc_id (nulls last), and the place, which tells equal rows apart."""
    return [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("place")]


def cutoff(rows: DataFrame, k: int) -> list[int]:
    """The k-th row in drawing order, as values of that order, column by column among the rows tied so far."""
    found, tied = [], rows
    for value in drawing_order():
        v, below = nth(tied, value, k)
        found.append(v)
        tied, k = tied.where(value == v), k - below
    return found


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3, ... in drawing order: cut into ranges, which are counted and numbered within."""
    spark = rows.sparkSession
    order = [f"o{i}" for i in range(len(drawing_order()))]
    keyed = rows.select("*", *[v.alias(o) for o, v in zip(order, drawing_order(), strict=True)])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = settled(keyed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    starts, before = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):  # a row per range
        starts.append((part, before))
        before += n
    first = F.broadcast(spark.createDataFrame(starts, "part int, start bigint"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    numbered = ranged.withColumn("within", within).join(first, "part")
    return numbered.select(*rows.columns, (F.col("start") + F.col("within")).cast("long").alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, carry: list[str] | None = None, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, runs: tuple[int, int] = RUNS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """(row, n_words, n_features, weight, score, rank), a row per document; ``rank`` is null for those not drawn.

    ``row`` holds the columns ``carry`` of the document, all by default, so no name can clash. Of the documents with
    ``least_words`` words ``percent`` hundredths are drawn. A null text has no words; a null doc_id is written as nothing for the noise and
    comes last among ties; repeated rows are drawn one by one. An empty target gives each bucket the gain of its rarity in the corpus.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets), buckets)
    rows = scored(docs, gain, docs.columns if carry is None else carry, runs, seed)
    enough = F.col("n_words") >= least_words
    k = percent * rows.where(enough).count() // 100
    none = F.lit(None).cast("long").alias("rank")
    out = ["row", "n_words", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, none)
    last = F.struct(*[F.lit(v).cast("long") for v in cutoff(rows.where(enough), k)])
    drawn = enough & (F.struct(*drawing_order()) <= last)
    return ranked(rows.where(drawn)).select(*out, "rank").unionByName(rows.where(~drawn).select(*out, none))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")


#: The same from the definition; the checksum of each distinct word is worked out byte by byte.
OP11_SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
cut AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
words AS (SELECT side, word, count(*) AS n FROM (SELECT side, unnest(w) AS word FROM cut) GROUP BY ALL),
coded AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words), steps),
counted AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM words JOIN coded USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counted),
gained AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM counted, totals),
weighed AS (
  SELECT id, sum(gain)::BIGINT AS weight FROM (SELECT id, unnest(w) AS word FROM cut WHERE side = 'd') JOIN coded USING (word) JOIN gained USING (bucket) GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN weighed USING (id) WHERE side = 'd'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
