"""Placing rows on shards by a lookup table that the shards fill in turns.

Every shard has its own order of preference over the slots of a table of prime size: an offset and a
step, both from a hash of its name. The shards take turns, each claiming the first slot of its order
that is free, until none is left; so their shares differ by one slot at most, and when a shard goes
few other slots change hands. The table is filled once on the driver (its size is a parameter with a
fixed bound), sent along in the plan as text, and joined by broadcast: placing a row is one hash and
one lookup. Only SQL functions are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table

SHARDS = 64

# Slots for each shard, so that the shares differ by about one percent at most, and the bound of the table.
SLOTS_PER_SHARD = 100
MOST_SLOTS = 1 << 20


def next_prime(n: int) -> int:
    def prime(x: int) -> bool:
        return x > 1 and all(x % d for d in range(2, int(x**0.5) + 1))

    while not prime(n):
        n += 1
    return n


def filled(names: list[str], size: int) -> list[int]:
    """The shard at each slot of a table of prime ``size``."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need names, each its own")
    if not len(names) <= size <= MOST_SLOTS:
        raise ValueError(f"a table has a slot for every shard and at most {MOST_SLOTS}")
    at, step = [], []
    for name in names:
        h = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(h[:8], "big") % size)
        step.append(int.from_bytes(h[8:], "big") % (size - 1) + 1 if size > 1 else 0)
    slots, free = [-1] * size, size
    while free:
        for shard in range(len(names)):
            while slots[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            slots[at[shard]] = shard
            free -= 1
            if not free:
                break
    return slots


def shard_names(shards: int) -> list[str]:
    return [f"shard-{i}" for i in range(shards)]


def slot(key: Column, size: int) -> Column:
    """The first 60 bits of the MD5 of the key as text, modulo the table's size; null counts as ''."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size))


def lookup(spark: SparkSession, names: list[str], size: int) -> DataFrame:
    """(slot, shard): the table as rows, made from one literal of a bounded length."""
    text = ",".join(map(str, filled(names, size)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("_slot", "_shard"))
    return rows.select(F.col("_slot").cast("long"), F.col("_shard").cast("int"))


def placed(df: DataFrame, key: str, names: list[str], size: int | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; both replace columns of these names.

    The rows are not shuffled. Equal keys share a shard, a repeated row is placed each time, a
    null key has the place of the empty text, and no rows give no rows.
    """
    size = size or next_prime(SLOTS_PER_SHARD * len(names))
    rows = df.withColumn("_slot", slot(F.col(key), size))
    found = rows.join(F.broadcast(lookup(df.sparkSession, names, size)), "_slot")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    return found.select(*kept, F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))


def write_shards(df: DataFrame, path: str, tasks_per_shard: int = 1) -> None:
    """One folder for each shard, each written by ``tasks_per_shard`` tasks; needs a ``shard`` column."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(tasks_per_shard))
    df.repartition("shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return placed(docs, "doc_id", shard_names(SHARDS))


def op6_sql() -> str:
    size = next_prime(SLOTS_PER_SHARD * SHARDS)
    text = ",".join(map(str, filled(shard_names(SHARDS), size)))
    return f"""
WITH t AS (SELECT string_split('{text}', ',') AS shards),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size} AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1]::INTEGER AS shard FROM d, t
"""
