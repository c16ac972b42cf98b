"""Benchmark decontamination by winnowing.

Of every window of ``WINDOW`` grams of ``GRAM`` words the one with the least hash is a fingerprint
(the last of equals), so two texts that share WINDOW + GRAM - 1 = 10 consecutive words share a
fingerprint at the same place in them. The fingerprints of the documents are looked up among those
of the benchmark. Each hit says how a document and an item lie to each other; along that line their
words are compared and every run of ten or more equal words is marked.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import Words, grams, raw, row_chunks, sliding_min, table

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1

# The benchmark is broadcast in slices of about so many bytes of text, each its own pass over the
# documents in the same stage; a slice exceeds it only by one item.
SLICE_BYTES = 8 << 20

#: Fixed: words are runs of ASCII letters and digits and of anything beyond ASCII.
BREAKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def picked(g: np.ndarray, w: int) -> np.ndarray:
    """Places of the least gram of every w grams, the last of equals, each place once."""
    n = len(g)
    if n < w:
        return np.zeros(0, np.int64)
    least = sliding_min(g, w)
    at = np.zeros(n - w + 1, np.int64)
    for j in range(w):
        hit = g[j : j + n - w + 1] == least
        at[hit] = np.flatnonzero(hit) + j
    return np.unique(at)


class Items:
    """A slice of the benchmark: words of every item, its fingerprints, and its short items."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        cut = Words(BREAKS)
        self.words: list[np.ndarray] = []
        self.ids: list[int] = []
        prints: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            h, _ = cut(data, np.array([0, len(data)]))
            if not len(h) or item_id is None:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(h)
            if len(h) < SPAN:
                short[len(h)][int(grams(h, len(h))[0])].append(k)
            else:
                g = grams(h, GRAM)
                for q in picked(g, WINDOW):
                    prints[int(g[q])].append((k, int(q)))
        keys = sorted(prints)
        self.keys = np.array(keys, np.uint64)
        self.places = [prints[x] for x in keys]
        self.short = {n: (np.array(sorted(m), np.uint64), [m[x] for x in sorted(m)]) for n, m in short.items()}

    @staticmethod
    def found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``values`` are among the sorted ``keys``, and where there."""
        if not len(keys) or not len(values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == values)
        return hit, at[hit]

    def hits(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, begin, end, item) of every run of words that an item's windows cover."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        g = grams(h, GRAM)
        if len(g) >= WINDOW and len(self.keys):
            # Windows may reach over a row's end: they only add places to look at.
            places = picked(g, WINDOW)
            seen = set()
            hit, key = self.found(self.keys, g[places])
            for p, k in zip(places[hit].tolist(), key.tolist(), strict=True):
                r = int(row[p])
                for item, q in self.places[k]:
                    if (r, item, p - q) not in seen:
                        seen.add((r, item, p - q))
                        yield from self.extended(h, first, r, item, p - q)
        for n, (keys, items) in self.short.items():
            hit, key = self.found(keys, grams(h, n))
            inside = row[hit] == row[hit + n - 1] if len(hit) else hit
            for p, k in zip(hit[inside].tolist(), key[inside].tolist(), strict=True):
                for item in items[k]:
                    yield int(row[p]), p, p + n, item

    def extended(self, h: np.ndarray, first: np.ndarray, r: int, item: int, shift: int):
        """Runs of ten or more equal words of a row and an item whose first word lies at ``shift``."""
        words = self.words[item]
        lo, hi = max(int(first[r]), shift), min(int(first[r + 1]), shift + len(words))
        if hi - lo < SPAN:
            return
        same = h[lo:hi] == words[lo - shift : hi - shift]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= SPAN:
                yield r, lo + a, lo + b, item


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, shared, last: bool) -> DataFrame:
    """One slice over the documents: adds its spans and items to those found so far."""
    kept = [c for c in docs.columns if not (last and c == "text")]

    def go(batches):
        cut = Words(BREAKS)
        for batch in batches:
            data, at = raw(batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text"))
            n = batch.num_rows
            counts, spans, items = np.zeros(n, np.int64), [[] for _ in range(n)], [set() for _ in range(n)]
            for lo, hi in row_chunks(at):
                h, first = cut(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                counts[lo:hi] = np.diff(first)
                for r, a, b, item in shared.value.hits(h, first):
                    spans[lo + r].append((a - int(first[r]), b - int(first[r])))
                    items[lo + r].add(shared.value.ids[item])
            before = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for i in range(n):
                spans[i] = [{"begin": a, "end": b} for a, b in merged(spans[i] + [(s["begin"], s["end"]) for s in before[0][i]])]
                items[i] = sorted(items[i].union(before[1][i]))
            new = {"n_words": pa.array(counts), "spans": pa.array(spans, SPANS), "items": pa.array(items, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in kept], names=kept)

    return docs.mapInArrow(go, docs.select(*kept).schema)


def contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(row, n_words, spans, items): word ranges of each document that benchmark windows cover.

    ``row`` holds the columns ``carry`` of the document, all by default, so no name can clash. A
    window is ten consecutive words of an item, or all words of a shorter one. ``items`` are the
    item_ids with a window in the document. A null or empty text has no words; an item without words
    or without an id is passed over; a repeated row, of documents or of the benchmark, gives what it
    gives alone. Each input row gives a row. The benchmark is measured first and broadcast in
    slices of at most ``SLICE_BYTES`` and one item.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // SLICE_BYTES))
    carry = docs.columns if carry is None else carry
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        *([] if "text" in carry else [F.col("text").cast("string")]),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"),
        F.array().cast("array<bigint>").alias("items"),
    )
    for s in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s)
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in part.toLocalIterator()]))
        out = _pass(out, shared, s == slices - 1)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    return contamination(docs, benchmark).where(F.size("spans") == 0).select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "row.doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


#: The same from the definition: every ten-word window of every item is looked up in every document.
OP10_SQL = r"""
WITH cut AS (
  SELECT 'd' AS side, doc_id AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
windows AS (
  SELECT DISTINCT id AS item_id, len(part) AS n, array_to_string(part, ' ') AS gram
  FROM (SELECT id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: list_slice(w, i, i + 9))) AS part
        FROM cut WHERE side = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT id AS doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut, sizes WHERE side = 'd' AND len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN windows USING (gram) WHERE windows.n = p.n),
marked AS (SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT c.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM cut c LEFT JOIN marked m ON m.doc_id = c.id LEFT JOIN found f ON f.doc_id = c.id
WHERE side = 'd'
"""
