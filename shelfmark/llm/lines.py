"""Line dedup by a segment-partition edit join.

A line that is not blank is a repeat if an earlier line, by document and place, equals it or is within some edits of it:
one for every CHARS_AN_EDIT characters of the shorter line, ``EDITS`` at most, so the shortest lines are repeats only
where they are equal. Of two lines that are ``e`` edits apart, cut into e + 1 segments by the shorter one's length, at
least one segment of the shorter is in the longer, at a place that the edits to its left and right can explain. So each
line is entered under its own segments, and under those pieces of it that could be a segment of a line of its length or
up to e less. Keys are hashes of (length, segment, text); lines that share a key are compared by a banded bit-parallel
edit distance.

Only keys and line hashes move at first, 16 bytes a row; texts are fetched for lines whose key another line has. A key
with very many lines is split: two lines that share a segment are as close without it, so the rest of each line is cut
anew and entered under both keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import raw, row_chunks, settled, table, told_apart
from shelfmark.llm.jaccard import BROADCAST_IDS, whole_groups

EDITS = 2

# Few edits make any short line any other, so the edits allowed fall with the length: 2, 1 and, for the shortest, none.
CHARS_AN_EDIT = 10

# A key with more lines is split, this many times at most, while its lines have enough characters left to be cut.
MANY = 256
SPLITS = 4
LEAST_REST = 5

CHUNK = 1 << 20
BLANKS = " \t\n\v\f\r"


def within(x: str, y: str, most: int) -> bool:
    """Whether x becomes y by at most ``most`` insertions, deletions and replacements of a character.

    After the common begin and end are cut off, the columns of the distance matrix are followed as bit vectors of the
    vertical steps, in a band of 2 * most + 1 rows that moves down the diagonal (Hyyro 2003).
    """
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > most:
        return False
    lo, hi = 0, len(y)
    while lo < hi:  # the longest common begin
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    x, y = x[lo:], y[lo:]
    lo, hi = 0, len(y)
    while lo < hi:  # the longest common end
        mid = (lo + hi + 1) // 2
        if x[len(x) - mid :] == y[len(y) - mid :]:
            lo = mid
        else:
            hi = mid - 1
    x, y = x[: len(x) - lo], y[: len(y) - lo]
    if not y:
        return len(x) <= most
    if most == 0:
        return False
    width = 2 * most + 1
    every, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    up, down = every ^ ((1 << (width - most - 1)) - 1), 0
    distance, shift, row = most, most + 1 - width, top >> 1
    last = 2 * most + len(y) - len(x)
    for j, c in enumerate(y):
        match = where.get(c, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & every
        diagonal = ((((match & up) + up) ^ up) | match | down) & every
        right = (down | ~(diagonal | up)) & every
        left = diagonal & up
        if j < len(x) - most:
            distance += not diagonal & top
        else:
            distance += bool(right & row) - bool(left & row)
            row >>= 1
        if distance > last:
            return False
        up, down = (left | ~((diagonal >> 1) | right)) & every, (diagonal >> 1) & right
        shift += 1
    return distance <= most


def pieces(n: int, parts: int) -> list[tuple[int, int]]:
    """(begin, size) of even segments of a line of ``n`` characters, the longer ones last."""
    small, long = n // parts, n % parts
    out, at = [], 0
    for i in range(parts):
        size = small + (i >= parts - long)
        out.append((at, size))
        at += size
    return out


def places(n: int, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(length, segment, begin, size): what a line of ``n`` characters is entered under, its own segments among them."""
    out = []
    for shorter in range(max(edits + 1, n - edits), n + 1):
        gap = n - shorter
        for i, (at, size) in enumerate(pieces(shorter, edits + 1)):
            lowest = max(0, at - i, at + gap - (edits - i))
            highest = min(n - size, at + i, at + gap + (edits - i))
            out += [(shorter, i, begin, size) for begin in range(lowest, highest + 1)]
    return out


_places: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}


def keys(line: str, salt: int, edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(key, begin, size) for each place of a line."""
    return _hashed(line, salt, _places_of(len(line), edits))


def _places_of(n: int, edits: int) -> list[tuple[int, int, int, int]]:
    found = _places.get((n, edits))
    if found is None:
        if len(_places) > 10_000:
            _places.clear()
        found = _places[n, edits] = places(n, edits)
    return found


def _hashed(line: str, salt: int, found) -> list[tuple[int, int, int]]:
    return [
        (xxhash.xxh64_intdigest(f"{length},{i},{line[begin : begin + size]}", salt) - (1 << 63), begin, size)
        for length, i, begin, size in found
    ]


def allowed(n: int) -> int:
    """The edits by which two lines may differ, the shorter one of ``n`` characters."""
    return min(EDITS, n // CHARS_AN_EDIT)


def line_keys(line: str) -> list[tuple[int, int, int, int]]:
    """(key, begin, size, edits) for each place of a whole line, by the edits that the shorter line allows."""
    n, out = len(line), []
    for edits in range(1, EDITS + 1):
        found = _places_of(n, edits)
        if n - edits < EDITS * CHARS_AN_EDIT:
            found = [p for p in found if allowed(p[0]) == edits]
        elif edits < EDITS:
            continue
        out += [(*k, edits) for k in _hashed(line, EDITS - edits, found)]
    return out


def line_hash(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def long_lines(text: str | None, least: int = 1):
    """(place, line) of the lines of at least ``least`` characters, without blanks around them; all that are not blank."""
    for k, line in enumerate((text or "").split("\n")):
        line = line.strip(BLANKS)
        if len(line) >= least:
            yield k, line


def shared_keys(batches):
    """Of rows (key, id) sorted by both, one for each pair whose key another id has. Holds one row between batches."""
    held = None  # the last row, and whether the one before it has its key
    for batch in batches:
        key, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        known = held is not None
        if known:
            key, own = np.append(held[0], key), np.append(held[1], own)
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        key, own = key[new], own[new]
        like = key[1:] == key[:-1]
        before = np.concatenate(([held[2] if known else False], like))
        out = before[:-1] | like
        held = (key[-1], own[-1], bool(before[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][out]), pa.array(own[:-1][out])], names=["key", "a"])
    if held is not None and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], names=["key", "a"])


def _texts(batch: pa.RecordBatch):
    """(doc_id, text) of a batch, about CHUNK bytes of text at a time."""
    _, at = raw(batch.column(1))
    for lo, hi in row_chunks(at, CHUNK):
        yield list(zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True))


def _occurrences(docs: DataFrame) -> DataFrame:
    def go(batches):
        for batch in batches:
            for rows in _texts(batch):
                out = [(doc_id, k, *line_hash(line)) for doc_id, text in rows for k, line in long_lines(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["doc_id", "line", "a", "b"])

    return docs.mapInArrow(go, "doc_id bigint, line bigint, a bigint, b bigint")


def _entries(docs: DataFrame) -> DataFrame:
    """(key, a) for every line that may be edited, once for those that a chunk of documents repeats."""

    def go(batches):
        for batch in batches:
            for rows in _texts(batch):
                distinct = {line for _, text in rows for _, line in long_lines(text, CHARS_AN_EDIT)}
                key, own = [], []
                for line in distinct:
                    found = [k for k, *_ in line_keys(line)]
                    key += found
                    own += [line_hash(line)[0]] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(own, pa.int64())], names=["key", "a"])

    return docs.mapInArrow(go, "key bigint, a bigint")


def _lines(docs: DataFrame) -> DataFrame:
    """(a, b, doc_id, line, text) of every line that may be edited, the first of those that a chunk of documents repeats."""

    def go(batches):
        for batch in batches:
            for rows in _texts(batch):
                first: dict[str, tuple] = {}
                for doc_id, text in rows:
                    for k, line in long_lines(text, CHARS_AN_EDIT):
                        place = (doc_id is None, doc_id, k)
                        if line not in first or place < first[line]:
                            first[line] = place
                out = [(*line_hash(line), doc_id, k, line) for line, (_, doc_id, k) in first.items()]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "doc_id", "line", "text"])

    return docs.mapInArrow(go, "a bigint, b bigint, doc_id bigint, line bigint, text string")


ROW = "key bigint, salt bigint, edits bigint, rest string, a bigint, b bigint, doc_id bigint, line bigint, text string"


def _split(rows: DataFrame) -> DataFrame:
    """Rows of crowded keys, entered by what is left of each line without the shared segment."""
    names = [c.split()[0] for c in ROW.split(", ")]

    def go(batches):
        for batch in batches:
            for small in [batch.slice(i, 64) for i in range(0, batch.num_rows, 64)]:
                out = []
                for key, salt, edits, rest, *own in zip(*(c.to_pylist() for c in small.columns), strict=True):
                    # No edits: a whole line, whose keys say how many.
                    found = [(*k, edits) for k in keys(rest, salt, edits)] if edits else line_keys(rest)
                    for k, begin, size, most in found:
                        if k == key:
                            left = rest[:begin] + rest[begin + size :]
                            deeper = key + (1 << 63)
                            out += [(new, deeper, most, left, *own) for new in {x for x, _, _ in keys(left, deeper, most)}]
                columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
                kinds = [pa.int64(), pa.uint64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                arrays[1] = arrays[1].to_numpy(zero_copy_only=False).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    return rows.mapInArrow(go, ROW)


def _close(rows: DataFrame) -> DataFrame:
    """(a, b) of the lines of a key that an earlier line of that key is close to; rows are sorted by key and place."""

    def go(batches):
        for part in whole_groups(batches, 1):
            key = part.column("key").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            texts, ids = part.column("text").to_pylist(), list(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True))
            found = set()
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for i in range(lo + 1, hi):
                    x = texts[i]
                    if ids[i] not in found and any(texts[j] != x and within(texts[j], x, allowed(min(len(texts[j]), len(x)))) for j in range(lo, i)):
                        found.add(ids[i])
            flat = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

    return rows.mapInArrow(go, "a bigint, b bigint")


def close_lines(docs: DataFrame) -> DataFrame:
    """(a, b): hashes of the distinct lines whose first place has a close line, not an equal one, before it."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries = _entries(docs).repartition(parts, "key").sortWithinPartitions("key", "a")
    met = settled(entries.mapInArrow(shared_keys, "key bigint, a bigint"))
    wanted = settled(met.select("a").distinct())
    lines = _lines(docs).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "a", "left_semi")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "line")
    first = lines.groupBy("a", "b", "text").agg(F.min(place).alias("p")).select("a", "b", "p.doc_id", "p.line", "text")
    rows = met.join(settled(first), "a").select("key", F.lit(0).cast("long").alias("salt"), F.lit(0).cast("long").alias("edits"), F.col("text").alias("rest"), "a", "b", "doc_id", "line", "text")
    found = None
    for turn in range(SPLITS + 1):
        rows = settled(rows)
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("rest")).alias("least"))
        crowded = settled(counts.where((F.col("n") > MANY) & (F.col("least") >= LEAST_REST)).select("key"))
        last = turn == SPLITS or crowded.isEmpty()
        now = rows if last else rows.join(crowded, "key", "left_anti").select(*rows.columns)
        ready = now.select("key", "a", "b", "doc_id", "line", "text").repartition(parts, "key")
        hits = _close(ready.sortWithinPartitions("key", F.col("doc_id").asc_nulls_last(), "line"))
        found = hits if found is None else found.union(hits)
        if last:
            break
        rows = _split(rows.join(crowded, "key", "left_semi").select(*rows.columns))
    return found.distinct()


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, lines): the places of the lines of each document that repeat an earlier one."""
    occurrences = settled(_occurrences(docs))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "line")
    many = occurrences.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    close = settled(close_lines(docs).withColumn("close", F.lit(True)))
    odd = settled(many.join(close, ["a", "b"], "left").where("n > 1 OR close"))
    drop = occurrences.join(odd, ["a", "b"]).where(F.col("close").isNotNull() | (place != F.col("first")))
    return drop.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def deduped(docs: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_dropped): each document without the lines that repeat an earlier one.

    ``row`` holds all columns of the document; places in order are (doc_id, line), a null doc_id after all others. Rows that
    share a doc_id and differ in text, and rows without doc_id, are documents of their own. Lines
    are what line feeds part, compared without blanks at both ends; blank ones stay, as do all line feeds between lines
    that stay. It is the input that is judged: a line close to a repeat is one too. A document that
    is there twice with its doc_id is not a repeat of itself. A null text has no lines and stays null.
    """
    rows = told_apart(docs)
    drop = settled(repeats(rows.select(F.col("id").alias("doc_id"), "text")))
    rows = rows.select("row", "id")
    # The same plan at every size: the texts are shuffled once and not sorted.
    joined = rows.join(drop.withColumnRenamed("doc_id", "_id").hint("shuffle_hash"), F.col("id") == F.col("_id"), "left")
    joined = joined.select("row", F.coalesce("lines", F.array().cast("array<bigint>")).alias("lines"))
    schema = joined.select("row", F.col("row.text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema

    def go(batches):
        for batch in batches:
            text, drops = batch.column("row").field("text"), batch.column("lines")
            out, n, lost = [], [], []
            for i in range(batch.num_rows):
                whole, skip = text[i].as_py(), drops[i].as_py()
                lines = [] if whole is None else whole.split("\n")
                n.append(len(lines))
                lost.append(len(skip))
                if skip:
                    gone = set(skip)
                    whole = "\n".join(x for k, x in enumerate(lines) if k not in gone)
                out.append(whole)
            arrays = [batch.column("row"), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "text", "n_lines", "n_dropped"])

    return joined.mapInArrow(go, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines, with all their columns; ``n_chars`` follows the text.

    A document that loses lines and has nothing but blanks left goes.
    """
    found = deduped(docs)
    columns = [
        F.col("text") if c == "text" else F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.{c}")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return found.where((F.col("n_dropped") == 0) | (F.trim(F.translate("text", "\t\n\r\v\f", "     ")) != "")).select(*columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_chars, kept_sha256), a row for each document."""
    found = deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
