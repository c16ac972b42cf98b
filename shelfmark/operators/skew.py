"""Key joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.bloom import KeyFilter, key_filter
from shelfmark.session import settled, shuffle_partitions

# A key side up to this many distinct keys is broadcast; its size is counted first.
BROADCAST_KEYS = 1_000_000

# A key is heavy from this share of the rows on, so at most 200 keys are heavy.
HEAVY_SHARE = 200

# Parts are placed by hash; several small ones per task even out.
PARTS_PER_TASK = 4


def fits_broadcast(keys: DataFrame, limit: int = BROADCAST_KEYS) -> bool:
    """Counts at most ``limit + 1`` rows."""
    return keys.limit(limit + 1).count() <= limit


def heavy_keys(facts: DataFrame, key: str) -> DataFrame:
    """(key, _parts): the heavy keys and into how many parts each should be split.

    Counted with map-side combine on the key column alone. There are at most
    ``HEAVY_SHARE`` rows, and ``_parts`` adds up to at most ``PARTS_PER_TASK`` times the
    shuffle partitions plus one per key.
    """
    tasks = PARTS_PER_TASK * shuffle_partitions(facts.sparkSession)
    counts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = facts.agg(F.count(F.lit(1)).alias("_total")).scalar()
    return counts.where(F.col("_n") * HEAVY_SHARE >= total).select(
        key, F.ceil(F.col("_n") * tasks / total).cast("int").alias("_parts")
    )


def with_membership(
    facts: DataFrame, keys: DataFrame, key: str, flag: str, limit: int = BROADCAST_KEYS
) -> DataFrame:
    """``facts`` with a boolean column ``flag``: is its ``key`` among ``keys``.

    Few keys are broadcast and the facts are not shuffled. Beyond ``limit`` both sides
    are shuffled, and the rows of a heavy key are spread: each takes one of ``_parts``
    salts, of which every one holds a copy of the key. The salt comes from the row and
    its input partition, so a task that is run again gives the same salts, and equal
    rows from different partitions are spread too.
    """
    known = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    if fits_broadcast(known, limit):
        joined = facts.join(F.broadcast(known), key, "left")
    else:
        heavy = F.broadcast(heavy_keys(facts, key))
        # Rows without a key match nothing; they are spread over all tasks.
        parts = F.when(F.col(key).isNull(), shuffle_partitions(facts.sparkSession)).otherwise(
            F.coalesce("_parts", F.lit(1))
        )
        row = F.xxhash64(*[F.col(c) for c in facts.columns])
        salt = F.pmod(F.pmod(row, F.lit(1 << 40)) + F.spark_partition_id(), parts).cast("int")
        salted = facts.join(heavy, key, "left").withColumn("_salt", salt)
        copies = known.join(heavy, key, "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        )
        joined = salted.drop("_parts").join(copies.drop("_parts"), [key, "_salt"], "left").drop("_salt")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False))).select(*facts.columns, flag)


def keep_known(facts: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``facts`` whose key is among ``keys``; beyond ``limit`` keys a Bloom filter of them goes before the shuffle."""
    maybe, known, _ = _filtered(facts, keys, key, limit)
    return with_membership(maybe, known, key, "_known", limit).where("_known").drop("_known")


def drop_known(facts: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The other rows. Those that the filter tells apart stay where they are; for that ``facts`` is read a second time."""
    maybe, known, filter_ = _filtered(facts, keys, key, limit)
    left = with_membership(maybe, known, key, "_known", limit).where("NOT _known").drop("_known")
    return left if filter_ is None else left.unionByName(filter_.failing(facts, key))


def _filtered(facts: DataFrame, keys: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame, KeyFilter | None]:
    """(rows that may have one of ``keys``, the distinct keys, the filter that said so)."""
    known = keys.select(key).where(F.col(key).isNotNull()).distinct()
    if fits_broadcast(known, limit):
        return facts, known, None
    known = settled(known)
    filter_ = key_filter(known, key, known.count())
    return (facts if filter_ is None else filter_.passing(facts, key)), known, filter_


def latest(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """One row per key, the one with the highest ``order``, combined before the shuffle.

    A null order comes before all others, so a key of which no row has one keeps a row. Rows are
    structs, which Spark aggregates after a sort within each task, before the shuffle and after it.
    """
    rest = [c for c in df.columns if c != key]
    order = F.col(order) if isinstance(order, str) else order
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(order.isNotNull(), order)).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )
