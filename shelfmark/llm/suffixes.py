"""Repeated substrings by enhanced suffix arrays, in two steps.

Of each window of LENGTH bytes the least of its GRAM-byte hashes is its anchor (the last of equals), and the consecutive
windows with one anchor are a segment. Equal windows have equal anchors at the same place in them, so they meet where
segments are grouped by the anchor's hash. A segment whose bytes an earlier one has is a repeat as a whole. Of the
others only those go on whose anchor another segment has too, a few percent: the edges of repeats.

Those are brought together by anchor and their windows' suffixes put in a suffix array with common-prefix lengths. A scan with a
stack gives the intervals of suffixes that share LENGTH bytes or more; one whose occurrences have different bytes before them
is a maximal repeat with all its occurrences. All but its first occurrence are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import _BASE, _INVERSE, byte_values, mixed, powers, raw, row_chunks, settled, sliding_min, table, told_apart
from shelfmark.llm.decontaminate import merged
from shelfmark.llm.jaccard import whole_groups

LENGTH = 100
GRAM = 24

# Anchors in a two-thousandth of the segments of a bounded sample of documents are split by segment where they are
# counted, and by window where they are compared. There are at most so many of them.
SAMPLE = 20_000
HOT_SHARE = 2_000
HOT_PARTS = 64

# Anchors up to so many (8 bytes each) are broadcast to cut out their segments; more are joined by document.
BROADCAST_ANCHORS = 4_000_000

# A text longer than this is read in parts that overlap by LENGTH - 1 bytes, and so many suffixes are sorted at a time.
PART = 1 << 20
AT_ONCE = 1 << 17

_low = np.uint64((1 << 24) - 1)


def hashed(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Sums from which the hash of any stretch follows."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values(fold=False, seed=5)[data] * powers(_BASE, n), out=sums[1:])
    return sums, n


def stretch(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[begin]) * powers(_INVERSE, len(sums))[begin]


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, begin, windows, anchor hash, segment hash) of texts one after another, shorter than 2**24 bytes in all."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    sums, n = hashed(data)
    starts = np.arange(n - GRAM + 1)
    g = mixed(stretch(sums, starts, starts + GRAM))
    least = sliding_min((g & ~_low) | (_low - starts.astype(np.uint64)), LENGTH - GRAM + 1)
    anchor = (_low - (least & _low)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[: len(anchor)] == row[LENGTH - 1 :]
    anchor = np.where(inside, anchor, -1)
    edges = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    begin, end = edges[:-1], edges[1:]
    # Two texts never share an anchor's place in a row unless windows between them are missing; there are LENGTH - 1.
    real = anchor[begin] >= 0
    begin, end = begin[real], end[real]
    a = anchor[begin]
    shape = ((a - begin).astype(np.uint64) << np.uint64(8)) | (end - begin).astype(np.uint64)
    whole = mixed(mixed(stretch(sums, begin, end + LENGTH - 1)) + shape)
    return row[begin], begin - at[row[begin]], end - begin, g[a].view(np.int64), whole.view(np.int64)


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the batch, place in its text, bytes, ends) of texts of about PART bytes, long ones in overlapping parts."""
    data, at = raw(batch.column("text"))
    for lo, hi in row_chunks(at, PART):
        if hi - lo > 1 or at[hi] - at[lo] <= 2 * PART:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        else:
            for a in range(int(at[lo]), int(at[hi]) - LENGTH + 1, PART):
                part = data[a : min(a + PART + LENGTH - 1, int(at[hi]))]
                yield np.array([lo]), np.array([a - at[lo]]), part, np.array([0, len(part)])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """doc_ids, a null one as the largest number."""
    return batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def _found(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(gram, segment, doc_id, begin, windows) of all texts of a batch, by segment and place in the order of texts."""
    ids, parts = _ids(batch), []
    for rows, places, data, at in chunks(batch):
        row, begin, windows, gram, whole = segments(data, at)
        parts.append((gram, whole, ids[rows[row]], begin + places[row], windows))
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5)]
    order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def _firsts(gram, whole, doc, begin) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted segments: which are the first of their kind, and which are later ones (not the same place again)."""
    if not len(gram):
        return np.zeros(0, bool), np.zeros(0, bool)
    first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])))
    own = np.flatnonzero(first)[np.cumsum(first) - 1]
    return first, ~first & ((doc != doc[own]) | (begin != begin[own]))


FIELDS = ["gram", "whole", "doc_id", "begin", "windows"]
SEGMENT = "gram bigint, whole bigint, doc_id bigint, begin bigint, windows bigint"


def _batch(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _distinct(docs: DataFrame) -> DataFrame:
    """The segments of the documents, the first of those that a batch repeats."""

    def go(batches):
        for batch in batches:
            found = _found(batch)
            first, _ = _firsts(*found[:4])
            yield _batch([c[first] for c in found], FIELDS)

    return docs.mapInArrow(go, SEGMENT)


def _inside(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, end): what repeats within a batch of documents, joined to the longest stretches."""

    def go(batches):
        for batch in batches:
            gram, whole, doc, begin, windows = _found(batch)
            _, later = _firsts(gram, whole, doc, begin)
            yield _batch(_joined(doc[later], begin[later], begin[later] + windows[later] + LENGTH - 1), ["doc_id", "begin", "end"])

    return docs.mapInArrow(go, "doc_id bigint, begin bigint, end bigint")


def _joined(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Overlapping or touching stretches of a document as one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    out: list[list[int]] = []
    for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
        if out and out[-1][0] == d and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([d, a, b])
    return list(np.array(out, np.int64).reshape(-1, 3).T)


def _sorted_out(rows: DataFrame, hot: frozenset[int]) -> DataFrame:
    """(kind, ...) of segments sorted by anchor, segment and place: 0 repeats an earlier one, 1 shares its anchor with others.

    Rows pass one batch at a time; what is held between batches is one segment.
    """

    def go(batches):
        held = None  # the last first segment, and whether the one before it has its anchor
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.append(h, c) for h, c in zip(held[0], columns, strict=True)]
            first, later = _firsts(*columns[:4])
            own = [c[first] for c in columns]
            like = own[0][1:] == own[0][:-1]
            before = np.concatenate(([held is not None and held[1]], like))
            met = before[:-1] | like
            if hot:
                met |= np.isin(own[0][:-1], list(hot))
            gone, kept = [c[later] for c in columns], [c[:-1][met] for c in own]
            kind = np.concatenate((np.zeros(len(gone[0]), np.int64), np.ones(len(kept[0]), np.int64)))
            yield _batch([kind, *[np.concatenate(p) for p in zip(gone, kept, strict=True)]], ["kind", *FIELDS])
            held = ([c[-1:] for c in own], bool(before[-1]))
        if held is not None and (held[1] or int(held[0][0][0]) in hot):
            yield _batch([np.ones(1, np.int64), *held[0]], ["kind", *FIELDS])

    return rows.mapInArrow(go, f"kind bigint, {SEGMENT}")


def frequent_anchors(docs: DataFrame) -> frozenset[int]:
    """Anchors of many segments in a bounded sample; being on the list changes where rows go, not what comes out."""
    total = docs.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = _distinct(sample).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(64, whole // HOT_SHARE)).orderBy(F.desc("n"), "gram").limit(HOT_SHARE).collect()
    return frozenset(r["gram"] for r in rows)


TEXTS = "key bigint, doc_id bigint, begin bigint, text binary"


def _rows(doc, begin, windows, gram, text_of, hot) -> Iterator[tuple[int, int, int, bytes]]:
    """Segments with their bytes by anchor; those of a hot anchor one window at a time, by the window."""
    for d, b, w, g in zip(doc.tolist(), begin.tolist(), windows.tolist(), gram.tolist(), strict=True):
        text = text_of(d, b, b + w + LENGTH - 1)
        if g not in hot:
            yield g, d, b, text
        else:
            for k in range(w):
                window = text[k : k + LENGTH]
                yield int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "big", signed=True), d, b + k, window


def _cut_by_anchor(docs: DataFrame, anchors: np.ndarray, hot: frozenset[int]) -> DataFrame:
    """The segments with one of a broadcast list of anchors, read again from the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(anchors)

    def go(batches):
        for batch in batches:
            wanted = shared.value
            ids, (data, at) = _ids(batch), raw(batch.column("text"))
            where = dict(zip(ids.tolist(), range(len(ids)), strict=True))
            found = _found(batch)
            first, _ = _firsts(*found[:4])
            place = np.minimum(np.searchsorted(wanted, found[0]), max(0, len(wanted) - 1))
            first &= wanted[place] == found[0] if len(wanted) else False
            gram, _, doc, begin, windows = (c[first] for c in found)
            cut = lambda d, a, b: data[at[where[d]] + a : at[where[d]] + b].tobytes()
            yield from _text_batches(list(_rows(doc, begin, windows, gram, cut, hot)))

    return docs.mapInArrow(go, TEXTS)


def _cut_by_document(docs: DataFrame, met: DataFrame, hot: frozenset[int]) -> DataFrame:
    """The segments that met, joined to their documents."""
    lists = met.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "begin", "windows")).alias("parts"))
    id_ = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max))
    joined = docs.withColumn("doc_id", id_).dropDuplicates(["doc_id"]).join(lists, "doc_id").select("doc_id", "text", "parts")

    def go(batches):
        for batch in batches:
            out = []
            data, at = raw(batch.column("text"))
            for i, (d, parts) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                gram, begin, windows = (np.array([p[k] for p in parts], np.int64) for k in ("gram", "begin", "windows"))
                out += _rows(np.full(len(gram), d), begin, windows, gram, lambda _, a, b, i=i: data[at[i] + a : at[i] + b].tobytes(), hot)
            yield from _text_batches(out)

    return joined.mapInArrow(go, TEXTS)


def _text_batches(rows: list) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 20_000):
        columns = list(zip(*rows[i : i + 20_000], strict=True))
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "begin", "text"])


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of all intervals of a suffix array with ``lcp[i]`` shared by suffixes i - 1 and i."""
    stack: list[tuple[int, int]] = []  # (length, first) of intervals still open
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= LENGTH and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(texts: list[bytes], doc: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, doc_ids, places) of each maximal repeat of LENGTH bytes or more, the first occurrence first.

    Only windows whose hash another window has are sorted. A text's begin counts as a byte of its own before it, so a
    repeat that goes on to the left of a text is given by the text that holds more of it.
    """
    sizes = np.array([len(t) for t in texts])
    at = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return
    sums, n = hashed(data)
    row = np.repeat(np.arange(len(texts)), sizes)
    start = np.flatnonzero(row[: n - LENGTH + 1] == row[LENGTH - 1 :])
    h = mixed(stretch(sums, start, start + LENGTH))
    _, back, counts = np.unique(h, return_inverse=True, return_counts=True)
    start = start[counts[back] > 1]
    if not len(start):
        return
    left = np.where(start == at[row[start]], -1, data[np.maximum(start - 1, 0)].astype(np.int64))
    left = np.where(left < 0, -1 - np.arange(len(left)), left)
    room = at[row[start] + 1] - start
    width = int(room.max())
    text = data[np.minimum(start[:, None] + np.arange(width), n - 1)]
    text[np.arange(width) >= room[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(text).view(f"S{width}").ravel(), kind="stable")
    text, room, left = text[order], room[order], left[order]
    differ = text[1:] != text[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.concatenate(([0], np.minimum(common, np.minimum(room[1:], room[:-1]))))
    changes = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    d, p = doc[row[start[order]]], begin[row[start[order]]] + start[order] - at[row[start[order]]]
    rank = np.empty(len(d), np.int64)
    rank[np.lexsort((p, d))] = np.arange(len(d))
    for length, first, last in intervals(lcp.tolist()):
        if changes[first] != changes[last]:
            own = np.arange(first, last + 1)
            own = own[np.argsort(rank[own])]
            yield length, d[own], p[own]


def _edges(rows: DataFrame) -> DataFrame:
    """(doc_id, begin, end) of all occurrences but the first of the maximal repeats of each key; rows are sorted by key."""

    def go(batches):
        for part in whole_groups(batches, 1):
            key = part.column("key").to_numpy()
            limits = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            weight = np.cumsum(np.concatenate(([0], np.array([len(x) for x in part.column("text").to_pylist()]) - LENGTH + 1)))
            lo = 0
            while lo < len(limits) - 1:  # whole keys of about AT_ONCE windows
                hi = max(lo + 1, int(np.searchsorted(weight[limits], weight[limits[lo]] + AT_ONCE, "right")) - 1)
                some = part.slice(int(limits[lo]), int(limits[hi] - limits[lo]))
                lo = hi
                doc, begin = some.column("doc_id").to_numpy(), some.column("begin").to_numpy()
                found = [[], [], []]
                for length, d, p in maximal_repeats(some.column("text").to_pylist(), doc, begin):
                    later = (d != d[0]) | (p != p[0])
                    for column, values in zip(found, (d[later], p[later], p[later] + length), strict=True):
                        column.append(values)
                if found[0]:
                    yield _batch(_joined(*[np.concatenate(c) for c in found]), ["doc_id", "begin", "end"])

    return rows.mapInArrow(go, "doc_id bigint, begin bigint, end bigint")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, end): stretches of bytes that are covered by repeats, which may overlap; a null id as the largest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = frequent_anchors(docs)
    salt = F.when(F.col("gram").isin(list(hot)), F.pmod("whole", F.lit(HOT_PARTS))).otherwise(F.lit(0)) if hot else F.lit(0)
    dealt = _distinct(docs).repartition(parts, "gram", salt).sortWithinPartitions("gram", "whole", "doc_id", "begin")
    rows = settled(_sorted_out(dealt, hot))
    met = rows.where("kind = 1").drop("kind")
    anchors = settled(met.select("gram").distinct())
    if anchors.count() <= BROADCAST_ANCHORS:
        cut = _cut_by_anchor(docs, np.sort(anchors.toPandas()["gram"].to_numpy(np.int64)), hot)
    else:
        cut = _cut_by_document(docs, met, hot)
    edges = _edges(cut.repartition(parts, "key").sortWithinPartitions("key"))
    whole = rows.where("kind = 0").select("doc_id", "begin", (F.col("begin") + F.col("windows") + LENGTH - 1).alias("end"))
    return _inside(docs).union(whole).union(edges)


def without_repeated(docs: DataFrame) -> DataFrame:
    """(row, kept, n_bytes, n_removed, n_spans): each document's bytes without those that a repeat covers.

    A repeat is a string of LENGTH bytes that starts earlier too, in a document with a smaller doc_id or earlier in the
    same one; matches do not cross documents, overlaps count, and the input is judged. ``row`` has all columns of the
    document. A null text is empty; a null doc_id comes after all others; a document there twice with its doc_id
    is one document. Rows that share a doc_id and differ in text, and rows without doc_id, are documents of their own.
    """
    rows = told_apart(docs)
    spans = repeated(rows.select(F.col("id").alias("doc_id"), "text")).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = rows.select("row", F.col("id").alias("_id")).join(spans.withColumnRenamed("doc_id", "_id"), "_id", "left")
    joined = joined.select("row", F.coalesce("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans"))
    schema = joined.select(
        "row", F.lit(b"").alias("kept"), *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")]
    ).schema

    def go(batches):
        for batch in batches:
            texts, lists = batch.column("row").field("text"), batch.column("spans")
            for lo in range(0, batch.num_rows, 256):
                small = batch.slice(lo, 256)
                kept, size, removed, count = [], [], [], []
                for text, spans in zip(texts.slice(lo, 256).to_pylist(), lists.slice(lo, 256).to_pylist(), strict=True):
                    data, at, out = (text or "").encode(), 0, []
                    runs = merged([(s["begin"], s["end"]) for s in spans])
                    for a, b in runs:
                        out.append(data[at:a])
                        at = b
                    out.append(data[at:])
                    kept.append(b"".join(out))
                    size.append(len(data))
                    removed.append(sum(b - a for a, b in runs))
                    count.append(len(runs))
                arrays = [small.column("row"), pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in (size, removed, count)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(go, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
