"""N-gram Jaccard join with signature trees.

A text is the set of its hashed shingles. Texts with equal sets are one class, of which one goes on. Two sets that
are similar enough share one of the first shingles of both in a common order (the prefix filter), so
classes meet by those. Where they meet they are put into a tree by size: each node has the OR of the bitmaps below it
and their range of sizes, and pairs of nodes are followed down only while the bits that both have leave room for
the overlap that their sizes ask for. What comes out is compared set by set.

The result is components, not pairs. A first round compares each class with the two that share most of its
first shingles. In the second round the trees leave out pairs that are connected already, and tell which components may be
connected beyond that; those are brought together once and compared set by set, again without pairs that are
connected by then. So a group of thousands of copies does not give its pairs, and no link between
different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfmark.llm.common import Words, grams, mixed, raw, row_chunks, settled, table, told_apart
from shelfmark.llm.graph import components
from shelfmark.llm.quality import BLANKS

SHINGLE = 3
PERCENT = 90

# A set of more than so many shingles is drawn as a bitmap of those in the lowest half, quarter or eighth of all
# hashes only; unlike sets still differ there by more than like ones can in all.
DRAWN = 2048
LEAST_SHARE = 3

# Shingles in a hundredth of so many sampled documents are put last in the common order, the most frequent
# ones only up to a bound. Any order gives the same links; this one keeps frequent shingles from being met at.
SAMPLE = 20_000
FREQUENT_SHARE = 100
FREQUENT_MOST = 20_000

# Ids up to so many (8 bytes each) are broadcast to pick their documents; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

LEAF = 32

# Sets of a cluster that are compared in one task, about so many bytes of them.
BLOCK_BYTES = 32 << 20


def _sets(data: np.ndarray, at: np.ndarray, words: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in order; one of all words where they are fewer than ``k``."""
    h, first = words(data, at)
    whole = grams(h, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            yield grams(h[a:b], b - a)
        else:
            yield whole[:0]


def sets_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(doc_ids, sets) of a batch (doc_id, text), for about a megabyte of text at a time."""
    words = Words(BLANKS)
    data, at = raw(batch.column(1))
    for lo, hi in row_chunks(at):
        yield batch.column(0).slice(lo, hi - lo), list(_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], words, k))


def need(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set similar to it."""
    return -(-n * percent // 100)


def bitmap(s: np.ndarray) -> bytes:
    """A byte k and the bits of the hashes below 2**(64 - k), in their order: at least two bits for each of them."""
    k = min(LEAST_SHARE, max(0, (len(s) // DRAWN).bit_length()))
    bits = max(64, 1 << (2 * (len(s) >> k) - 1).bit_length())
    width = bits.bit_length() - 1
    low = s[: np.searchsorted(s, np.uint64(1 << (64 - k)))] if k else s
    out = np.zeros(bits, np.uint8)
    out[(low >> np.uint64(64 - k - width)).astype(np.int64)] = 1
    return bytes([k]) + np.packbits(out).tobytes()


def drawn(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of one range of hashes and one width, as rows of 64-bit words: the smallest range, the coarsest steps."""
    range_ = max(m[0] for m in maps)
    widths = [(len(m) - 1) * 8 for m in maps]
    step = max(64 - m[0] - (w.bit_length() - 1) for m, w in zip(maps, widths, strict=True))
    bits = 1 << (64 - range_ - step)
    rows = np.empty((len(maps), bits // 8), np.uint8)
    for row, m, w in zip(rows, maps, widths, strict=True):
        own = np.frombuffer(m, np.uint8, offset=1)
        within = w >> (range_ - m[0])
        if within == bits:
            row[:] = own[: bits // 8]
        else:
            row[:] = np.packbits(np.unpackbits(own[: within // 8]).reshape(bits, -1).any(axis=1))
    return rows.view(np.uint64) if bits >= 64 else np.pad(rows, ((0, 0), (0, 8 - bits // 8))).view(np.uint64)


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that many of a bounded sample of the documents hold, at most FREQUENT_MOST of them."""
    total = docs.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches):
        for batch in batches:
            for _, sets in sets_of(batch, k):
                some = [s for s in sets if len(s)] or [np.zeros(0, np.uint64)]
                values, n = np.unique(np.concatenate(some), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["token", "n"])

    counts = sample.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    least = max(8, min(SAMPLE, total) // FREQUENT_SHARE)
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).collect()
    return np.unique(np.array([r["token"] for r in top], np.int64).view(np.uint64))


def described(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, prefix, bits): a set's size, 128 bits of it, its first shingles and its bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))

    def go(batches):
        late = shared.value
        for batch in batches:
            for ids, sets in sets_of(batch, k):
                n, h1, h2, prefixes, maps = [], [], [], [], []
                for s in sets:
                    n.append(len(s))
                    h1.append(mixed(s + np.uint64(1)).sum(dtype=np.uint64))
                    h2.append(mixed(s + np.uint64(2)).sum(dtype=np.uint64))
                    p = len(s) - need(len(s), percent) + 1 if len(s) else 0
                    at = np.minimum(np.searchsorted(late, s), max(0, len(late) - 1))
                    is_late = late[at] == s if len(late) else np.zeros(len(s), bool)
                    early = s[~is_late]
                    chosen = early[:p] if len(early) >= p else np.concatenate([early, s[is_late][: p - len(early)]])
                    prefixes.append(chosen.view(np.int64))
                    maps.append(bitmap(s) if len(s) else b"")
                sizes = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(prefixes)))
                hashes = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.array(n, np.int64)), *hashes, lists, pa.array(maps, pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "prefix", "bits"],
                )

    return docs.mapInArrow(go, "doc_id bigint, n bigint, h1 bigint, h2 bigint, prefix array<bigint>, bits binary")


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """(token, doc_id, n, near): the rows whose token another row has. ``rows`` are sorted by token in each task.

    ``near`` are up to two rows to compare with first: the first of the token of a similar size, and the one before.
    Rows pass one batch at a time, however many share a token.
    """

    def go(batches):
        held = None  # the last row so far, of which it isn't known yet if the next one has its token
        anchor = None  # (token, doc_id, n) that rows of its token and size are compared with first
        for batch in batches:
            token, doc, n = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(3))
            out = [[], [], [], []]
            for row in zip(token, doc, n, strict=True):
                if held is not None:
                    if held[0][0] == row[0] and not held[2]:
                        held = (held[0], held[1], True)
                    if held[2]:
                        for column, value in zip(out, (*held[0], held[1]), strict=True):
                            column.append(value)
                same = held is not None and held[0][0] == row[0]
                near = []
                if same and anchor is not None and 100 * anchor[2] >= percent * row[2]:
                    near = [anchor[1]]
                    if held[0][1] != anchor[1]:
                        near.append(held[0][1])
                else:
                    anchor = row
                held = (row, near, same)
            yield _rows(out)
        if held is not None and held[2]:
            yield _rows([[x] for x in (*held[0], held[1])])

    def _rows(out):
        arrays = [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["token", "doc_id", "n", "near"])

    return rows.mapInArrow(go, "token bigint, doc_id bigint, n bigint, near array<bigint>")


def whole_groups(batches, keys: int) -> Iterator[pa.Table]:
    """Tables that hold every row of their keys, the first ``keys`` columns, from batches sorted by them."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        if not len(now):
            continue
        same = np.ones(len(now), bool)
        for i in range(keys):
            column = now.column(i).to_numpy()
            same &= column == column[-1]
        cut = len(now) - int(same.sum())
        if cut:
            yield now.slice(0, cut)
        rest = now.slice(cut)
    if rest is not None and len(rest):
        yield rest


class Tree:
    """Sets of a group in order of size, and levels of nodes above them: ORed bitmaps, sizes, components."""

    def __init__(self, n: np.ndarray, component: np.ndarray, maps: list[bytes]):
        self.order = np.argsort(n, kind="stable")
        self.maps = drawn([maps[i] for i in self.order])
        self.n, self.component = n[self.order], component[self.order]
        self.slack = self.n - np.bitwise_count(self.maps).sum(axis=1).astype(np.int64)
        edges = np.arange(0, len(n), LEAF)
        level = (
            np.bitwise_or.reduceat(self.maps, edges), np.minimum.reduceat(self.n, edges), np.maximum.reduceat(self.n, edges),
            np.maximum.reduceat(self.slack, edges), np.minimum.reduceat(self.component, edges), np.maximum.reduceat(self.component, edges),
        )
        self.levels = [level]
        while len(level[0]) > 1:
            pairs = np.arange(0, len(level[0]), 2)
            joins = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            level = tuple(j.reduceat(x, pairs) for j, x in zip(joins, level, strict=True))
            self.levels.append(level)

    def candidates(self, percent: int) -> Iterator[tuple[int, int]]:
        """Places of pairs in different components whose overlap may be large enough."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            depth, a, b = stack.pop()
            maps, low, high, slack, least, most = self.levels[depth]
            if least[a] == most[a] == least[b] == most[b] or 100 * high[a] < percent * low[b]:
                continue
            room = int(np.bitwise_count(maps[a] & maps[b]).sum()) + int(min(slack[a], slack[b]))
            if room * (100 + percent) < percent * int(low[a] + low[b]):
                continue
            if depth:
                below = len(self.levels[depth - 1][0])
                left = [i for i in (2 * a, 2 * a + 1) if i < below]
                right = [i for i in (2 * b, 2 * b + 1) if i < below]
                stack += [(depth - 1, i, j) for i in left for j in right if i <= j]
            else:
                yield from self.leaves(a, b, percent)

    def leaves(self, a: int, b: int, percent: int) -> Iterator[tuple[int, int]]:
        x, y = slice(a * LEAF, (a + 1) * LEAF), slice(b * LEAF, (b + 1) * LEAF)
        common = np.bitwise_count(self.maps[x, None, :] & self.maps[None, y, :]).sum(axis=2).astype(np.int64)
        room = common + np.minimum(self.slack[x, None], self.slack[None, y])
        fits = room * (100 + percent) >= percent * (self.n[x, None] + self.n[None, y])
        fits &= self.component[x, None] != self.component[None, y]
        if a == b:
            fits = np.triu(fits, 1)
        for i, j in zip(*np.nonzero(fits), strict=True):
            yield int(self.order[a * LEAF + i]), int(self.order[b * LEAF + j])


class Union:
    """Which components are connected so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _links(found) -> pa.RecordBatch:
    flat = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])


def _near(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that may be linked, from rows (token, bucket, own, doc_id, n, component, bits) sorted by token and bucket.

    Of each group as many pairs as connect what may be connected, fewer than the group has rows.
    """

    def go(batches):
        for part in whole_groups(batches, 2):
            token, bucket, own, doc, n, component = (part.column(i).to_numpy() for i in range(6))
            maps = part.column(6).to_pylist()
            edges = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (bucket[1:] != bucket[:-1]), [True])))
            found = set()
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo < 2 or not own[lo:hi].any() or (component[lo:hi] == component[lo]).all():
                    continue
                tree, joined = Tree(n[lo:hi], component[lo:hi], maps[lo:hi]), Union()
                for i, j in tree.candidates(percent):
                    x, y = int(component[lo + i]), int(component[lo + j])
                    if (own[lo + i] or own[lo + j]) and joined.join(x, y):
                        found.add((min(x, y), max(x, y)))
            yield _links(found)

    return rows.mapInArrow(go, "a bigint, b bigint")


def _fetched(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, set): the whole sets of some documents, as bytes."""
    ids = settled(ids.distinct())
    own = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def build(batches):
        for batch in batches:
            for ids, sets in sets_of(batch, k):
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "set"])

    return settled(own.mapInArrow(build, "doc_id bigint, set binary"))


def similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    common = int((v[at] == u).sum())
    return 100 * common >= percent * (len(u) + len(v) - common)


def _connected(docs: DataFrame, labelled: DataFrame, near: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links that connect the components which are connected, from pairs ``near`` of components that may be.

    Components that may be connected, directly or through others, are a cluster. Each set of a cluster is sent once to
    the task that compares it; the sets of a large cluster are dealt into blocks, each pair of them a task. Within a
    task only pairs that are not connected yet are compared.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    clusters = components(near).toDF("component", "cluster")
    members = settled(labelled.select("doc_id", "n", "component").join(clusters, "component"))
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("long").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (
        members.join(blocks, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
        .withColumn("other", other)
        .join(_fetched(docs, members.select("doc_id"), k), "doc_id")
        .select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "component", "set")
        .repartition(parts, "cluster", "lo", "hi")
        .sortWithinPartitions("cluster", "lo", "hi")
    )

    def go(batches):
        for part in whole_groups(batches, 3):
            keys = [part.column(i).to_numpy() for i in range(3)]
            new = np.any([c[1:] != c[:-1] for c in keys], axis=0)
            edges = np.flatnonzero(np.concatenate(([True], new, [True])))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                some = part.slice(lo, hi - lo)
                doc, component = some.column("doc_id").to_pylist(), some.column("component").to_numpy()
                sets = [np.frombuffer(x, np.uint64) for x in some.column("set").to_pylist()]
                tree = Tree(np.array([len(x) for x in sets]), component, [bitmap(x) for x in sets])
                joined, found = Union(), set()
                for i, j in tree.candidates(percent):
                    x, y = int(component[i]), int(component[j])
                    if joined.find(x) != joined.find(y) and similar(sets[i], sets[j], percent):
                        joined.join(x, y)
                        found.add((min(doc[i], doc[j]), max(doc[i], doc[j])))
                yield _links(found)

    return dealt.mapInArrow(go, "a bigint, b bigint")


def _linked(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = settled(pairs)
    sets = _fetched(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), k)
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def compare(batches):
        for batch in batches:
            values = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
            keep = [similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), percent) for pair in values]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "a bigint, b bigint")


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs`` (doc_id, text).

    Two documents link when their sets' overlap is at least ``percent`` hundredths of the union; a component is
    named by its least doc_id. A null or empty text and one without words have an empty set, linked with nothing.
    A row repeated with its doc_id is the same document; rows that share a doc_id and differ in text are documents of
    their own. A null doc_id links with nothing and has no component.
    """
    rows = told_apart(docs.select("doc_id", "text"))
    number = F.when(F.col("row.doc_id").isNotNull(), F.col("id"))
    found = _groups(rows.select(number.alias("doc_id"), "text"), shingle, percent)
    names = rows.where("row.doc_id IS NOT NULL AND id <> row.doc_id").select("id", F.col("row.doc_id").cast("long").alias("name")).distinct()
    if names.isEmpty():
        return found
    # Numbers follow the ids, so the least number of a component is that of its least id.
    names = settled(names)
    own = found.join(names.toDF("doc_id", "own"), "doc_id", "left").join(names.toDF("component_id", "first"), "component_id", "left")
    return own.select(F.coalesce("own", "doc_id").alias("doc_id"), "n_shingles", F.coalesce("first", "component_id").alias("component_id"))


def _groups(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``similar_groups`` for documents with an id each, or none."""
    all_ = settled(described(docs, shingle, percent))
    some = all_.where("doc_id IS NOT NULL AND n > 0")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    member = settled(all_.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("first")).alias("first")))
    firsts = member.where("first = doc_id").select("doc_id").distinct()
    single = settled(some.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "prefix", "bits"))

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    meet = single.select(F.explode("prefix").alias("token"), "doc_id", "n").repartition(parts, "token").sortWithinPartitions("token", "n", "doc_id")
    met = settled(_met(meet, percent))

    # First round: the two that share most of a set's first shingles.
    counts = met.select("doc_id", "n", F.explode("near").alias("other")).groupBy("doc_id", "n", "other").agg(F.count(F.lit(1)).alias("shared"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("shared"), "other"))
    firsthand = counts.where(F.col("shared") * 300 >= F.col("n") * (100 - percent)).withColumn("place", best).where("place <= 2")
    pairs = firsthand.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    links = settled(_linked(docs, pairs, shingle, percent))
    known = settled(components(links))

    # Second round: whatever else may link two components.
    labelled = single.select("doc_id", "n", "bits").join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    labelled = settled(labelled.withColumn("component", F.coalesce("component", "doc_id")))
    tagged = met.select("token", "doc_id", "n").join(labelled.select("doc_id", "component"), "doc_id")
    mixed_ = tagged.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    # Similar sizes lie in the same bucket or the next one; the margin is for rounding.
    bucket = F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(100 / percent)) * 1.000001)).cast("long")
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(1).cast("long").alias("own"))
    next_ = F.struct((F.col("_bucket") + 1).alias("bucket"), F.lit(0).cast("long").alias("own"))
    rows = (
        met.select("token", "doc_id", "n").join(mixed_, "token", "left_semi").join(labelled.drop("n"), "doc_id")
        .withColumn("_bucket", bucket)
        .withColumn("place", F.explode(F.array(own, next_)))
        .select("token", "place.bucket", "place.own", "doc_id", "n", "component", "bits")
        .repartition(parts, "token", "bucket")
        .sortWithinPartitions("token", "bucket")
    )
    near = settled(_near(rows, percent).distinct())
    more = settled(_connected(docs, labelled, near, shingle, percent))
    whole = components(links.union(more))
    done = member.join(whole.withColumnRenamed("id", "first"), "first", "left")
    # A class is named by its first member, so a component by its first class.
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The first document of every component, by doc_id, with all its columns.

    Rows that share a doc_id and differ in text are documents of their own; those without doc_id all stay.
    """
    rows = told_apart(docs)
    number = F.when(F.col("row.doc_id").isNotNull(), F.col("id"))
    found = _groups(rows.select(number.alias("doc_id"), "text"), shingle, percent)
    drop = settled(found.where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct())
    kept = rows.join(F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop, "id", "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
