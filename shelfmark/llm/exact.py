"""Exact dedup: partitions exchange Golomb-coded fingerprints before any text moves.

Every partition sorts the distinct 64-bit fingerprints of its normalised texts and sends each owner of
a range of them its part, as Golomb-Rice coded gaps. An owner answers with a bitmap: which of them
another partition has too. With those bitmaps and its own repeats a partition knows its suspects. Only
their texts are shuffled, grouped by the text itself, so equality is that of bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import settled, table

# Fingerprints an owner decodes at most, on average; about 30 bytes each while it works.
PER_OWNER = 2_000_000


def normalised(text: Column) -> Column:
    """Each run of blanks, tabs and line ends as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def encoded(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted distinct unsigned 64-bit numbers as (bits, unary parts, remainders) of their gaps.

    A gap is its quotient by 2**bits in unary and its remainder in ``bits`` bits, which for
    evenly spread numbers is within a few percent of the least that is possible.
    """
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // len(values) if len(values) else 1
    bits = max(0, max(1, mean).bit_length() - 1)
    quotients = (gaps >> np.uint64(bits)).astype(np.int64) if bits < 64 else np.zeros(len(gaps), np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    rests = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return bits, np.packbits(unary).tobytes(), np.packbits(rests.ravel()).tobytes()


def decoded(n: int, bits: int, unary: bytes, rests: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ones, prepend=-1) - 1
    fields = np.unpackbits(np.frombuffer(rests, np.uint8))[: n * bits].reshape(n, bits)
    remainder = np.zeros(n, np.uint64)
    for j in range(bits):
        remainder = (remainder << np.uint64(1)) | fields[:, j]
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(bits)) + remainder, dtype=np.uint64)


def unsigned(fingerprints: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct fingerprints, how often each is there)."""
    return np.unique(fingerprints.to_numpy(np.int64).view(np.uint64), return_counts=True)


def suspects(light: DataFrame, total: int) -> DataFrame:
    """(doc_id): rows whose fingerprint another row has too. ``light``: doc_id, fp, sender."""
    power = max(0, (max(1, total) // PER_OWNER).bit_length())

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        values, _ = unsigned(frame["fp"])
        owner = (values >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(values), np.int64)
        rows = []
        for o in np.unique(owner).tolist():
            own = values[owner == o] - np.uint64(o << (64 - power) if power else 0)
            rows.append((o, int(frame["sender"].iloc[0]), len(own), *encoded(own)))
        return pd.DataFrame(rows, columns=["owner", "sender", "n", "bits", "unary", "rests"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [decoded(*r) for r in frame[["n", "bits", "unary", "rests"]].itertuples(index=False, name=None)]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        shared = values[counts > 1]
        marks = []
        for own in lists:
            at = np.minimum(np.searchsorted(shared, own), max(0, len(shared) - 1))
            marks.append(np.packbits(shared[at] == own if len(shared) else np.zeros(len(own), bool)).tobytes())
        return pd.DataFrame({"owner": frame["owner"], "sender": frame["sender"], "n": frame["n"], "marks": marks})

    def pick(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        values, counts = unsigned(mine["fp"])
        shared = counts > 1
        if len(answers):
            parts = answers.sort_values("owner")
            shared |= np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[:n].astype(bool) for n, m in zip(parts["n"], parts["marks"], strict=True)])
        own = mine["fp"].to_numpy(np.int64).view(np.uint64)
        return mine.loc[shared[np.searchsorted(values, own)], ["doc_id"]]

    sent = light.groupBy("sender").applyInPandas(send, "owner bigint, sender bigint, n bigint, bits int, unary binary, rests binary")
    answers = sent.groupBy("owner").applyInPandas(answer, "owner bigint, sender bigint, n bigint, marks binary")
    return light.groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(pick, "doc_id bigint")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Null texts are empty ones. ``keep_id`` is the smallest doc_id of the equal texts; null ids come
    after all others. A row that is there twice with its doc_id counts twice; both are marked kept, as
    they cannot be told apart. Grouping the suspects' texts is combined before the shuffle, so a text
    that a third of the rows share leaves a task once.
    """
    text = normalised(F.col("text"))
    light = settled(
        docs.select(
            F.col("doc_id").cast("long"),
            F.xxhash64(text).alias("fp"),
            F.sha2(text, 256).alias("text_sha256"),
            F.spark_partition_id().cast("long").alias("sender"),
        )
    )
    found = settled(suspects(light.select("doc_id", "fp", "sender"), light.count()))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    classes = (
        texts.select("doc_id", normalised(F.col("text")).alias("norm"))
        .groupBy("norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
        .where("group_size > 1")
    )
    joined = light.select("doc_id", "text_sha256").join(settled(classes), "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
