"""A Bloom filter of many keys, built by an aggregate and broadcast, that drops rows before they are shuffled for a key join.

The filter is cut into blocks of 32,768 bits; a key has all its bits in one, so a row is looked up with one join by the block's number. Sixteen
bits a key let about one of four hundred other keys pass. What passes is joined exactly afterwards, so nothing rests on the filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import settled

BLOCK_BITS = 1 << 15
BITS_PER_KEY = 16
PROBES = 4

# A filter is broadcast up to this size, so it serves up to 128 million keys; beyond that all rows are shuffled.
MOST_BYTES = 256 << 20


@dataclass(frozen=True)
class KeyFilter:
    """``bits``: (_block, _bits), a row per block."""

    bits: DataFrame
    blocks: int

    def passing(self, facts: DataFrame, key: str) -> DataFrame:
        """The rows of ``facts`` whose key may be in the filter: all that are, and few others. Rows without key go."""
        return self._looked_up(facts.where(F.col(key).isNotNull()), key).where("_hit").select(*facts.columns)

    def failing(self, facts: DataFrame, key: str) -> DataFrame:
        """All other rows, those without key too."""
        return self._looked_up(facts, key).where("NOT _hit").select(*facts.columns)

    def _looked_up(self, facts: DataFrame, key: str) -> DataFrame:
        block, *probes = _hashes(key, self.blocks)
        hit = F.col(key).isNotNull()
        for probe in probes:
            hit = hit & _bit(probe)
        found = facts.withColumn("_block", block).join(F.broadcast(self.bits), "_block", "left")
        return found.withColumn("_hit", F.coalesce(hit, F.lit(False)))


def key_filter(keys: DataFrame, key: str, n: int) -> KeyFilter | None:
    """The filter of ``n`` distinct keys, settled; none where it would be too large to broadcast."""
    if n * BITS_PER_KEY > 8 * MOST_BYTES:
        return None
    blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    block, *probes = _hashes(key, blocks)
    bits = keys.where(F.col(key).isNotNull()).select(block.alias("_block"), F.explode(F.array(*probes)).alias("_bit"))
    return KeyFilter(settled(bits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))), blocks)


def _hashes(key: str, blocks: int) -> list[Column]:
    """The block of a key, and its bits in it."""
    within = F.xxhash64(F.lit(1), key)
    return [F.pmod(F.xxhash64(key), F.lit(blocks)), *[F.pmod(F.shiftright(within, 15 * i), F.lit(BLOCK_BITS)) for i in range(PROBES)]]


def _bit(position: Column) -> Column:
    """Whether a bit of ``_bits`` is set."""
    byte = F.substring("_bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(position, F.lit(8)).cast("int")) == 1
