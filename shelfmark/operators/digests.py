"""What differs between two images of a table, found by digests before any row is moved.

Rows fall into leaves by a hash of their key. The digest of a leaf adds up hashes of its rows, that of a node those of the leaves below
it, so equal sets of rows have equal digests at every level, and a changed row changes its leaf and the nodes above. Two trees
are compared from the root down; only children of nodes that differ are looked at. Only the rows of leaves that differ are
joined, so what is shuffled follows the changes. A tree is small and may be written beside its image; then the older image is not read
for it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.skew import keep_known
from shelfmark.session import settled

# A node has so many children. With the default depth there are 65,536 leaves.
FAN = 16
DEPTH = 4

_SUMS = ("d0", "d1", "d2", "d3")


def leaf_of(key: str, depth: int = DEPTH) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FAN**depth))


def _row_digest(columns: Sequence[str]) -> list[Column]:
    """128 bits of a row as four numbers of 32 bits, whose sums over less than 2**31 rows fit a long. Nulls count by their place."""
    row = [F.col(c) for c in columns] + [F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])]
    halves = [F.xxhash64(F.lit(seed), *row) for seed in (1, 2)]
    return [x for h in halves for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]


def digest_tree(image: DataFrame, key: str, columns: Sequence[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """(level, node, n, d0..d3) of all nodes that hold rows, the root at level 0, settled. Rows without key are not in it.

    ``columns`` are those that count, all by default. The leaves are added up before the shuffle; the levels above come from them.
    """
    columns = sorted(columns or image.columns)
    parts = [d.alias(s) for s, d in zip(_SUMS, _row_digest(columns), strict=True)]
    rows = image.where(F.col(key).isNotNull()).select(leaf_of(key, depth).alias("leaf"), *parts)
    sums = [F.sum(s).alias(s) for s in _SUMS]
    leaves = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *sums)
    level = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    spread = leaves.select(level.alias("level"), "leaf", "n", *_SUMS)
    node = F.floor(F.col("leaf") / F.pow(F.lit(float(FAN)), depth - F.col("level"))).cast("bigint")
    return settled(spread.groupBy("level", node.alias("node")).agg(F.sum("n").alias("n"), *sums))


def differing_leaves(old: DataFrame, new: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(leaf) of the leaves whose digests differ; ``old`` and ``new`` are trees of one depth.

    A level has at most ``FAN`` times as many nodes to compare as differed above it, and ``FAN`` ** ``depth`` in all.
    """
    differ = old.sparkSession.createDataFrame([(0,)], "node BIGINT")
    for level in range(depth + 1):
        asked = F.broadcast(differ)  # nodes of one level, at most FAN ** depth numbers
        sides = [t.where(F.col("level") == level).join(asked, "node", "left_semi").select("node", F.struct("n", *_SUMS).alias(d)) for t, d in ((old, "o"), (new, "w"))]
        here = sides[0].join(sides[1], "node", "full_outer").where(~F.col("o").eqNullSafe(F.col("w"))).select("node")
        here = settled(here)
        if level == depth or here.isEmpty():
            return here.select(F.col("node").alias("leaf"))
        differ = here.select(F.explode(F.sequence(F.col("node") * FAN, F.col("node") * FAN + FAN - 1)).alias("node"))
    raise AssertionError("a tree has at least a root")


def differing_rows(
    old: DataFrame, new: DataFrame, key: str, old_tree: DataFrame | None = None, new_tree: DataFrame | None = None, depth: int = DEPTH
) -> tuple[DataFrame, DataFrame]:
    """The rows of both images in leaves that differ: every row that was added, removed or changed, and those that share its leaf.

    Trees that were written with the images are taken as they are; they must have been made over the columns of ``new`` with the same depth.
    """
    columns = new.columns
    trees = [t if t is not None else digest_tree(df.select(*columns), key, columns, depth) for t, df in ((old_tree, old), (new_tree, new))]
    leaves = differing_leaves(*trees, depth).withColumnRenamed("leaf", "_leaf")
    return tuple(keep_known(df.select(*columns).withColumn("_leaf", leaf_of(key, depth)), leaves, "_leaf").drop("_leaf") for df in (old, new))
