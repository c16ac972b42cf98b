"""Resampling against the definition, on odd rows, ties and runs of several words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import resampling

from llm_tables import ROWS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def buckets_of(text, runs, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]


def by_hand(rows, target, percent, least, runs, buckets):
    s, t = (Counter(b for text in texts for b in buckets_of(text, runs, buckets)) for texts in ([r[1] for r in rows], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in s}
    out = []
    for doc_id, text in rows:
        found = buckets_of(text, runs, buckets)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([doc_id, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter((*r, i) for i, r in enumerate(enough[: percent * len(enough) // 100], 1))
    ranks = {}
    for *r, rank in drawn:
        ranks.setdefault(tuple(r), []).append(rank)
    return Counter((*r, ranks[tuple(r)].pop(0) if ranks.get(tuple(r)) else None) for r in out)


def got(df):
    return Counter((r["row"]["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("runs", "percent", "least", "buckets"), [((1, 1), 10, 20, 10_000), ((1, 3), 60, 1, 97), ((2, 2), 100, 0, 7)])
def test_resampled(shipped, runs, percent, least, buckets):
    rows = [r[:2] for r in ROWS] + [(100 + i % 40, f"word{i % 5} " * (i % 33) + "end") for i in range(120)] + [(None, "same text " * 12)] * 40
    target = ["word1 word2 word2 end", None, "same text"]
    docs = shipped.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
    bench = shipped.createDataFrame([(t,) for t in target], "text STRING")
    found = resampling.resampled(docs, bench, None, percent, least, runs, buckets)
    assert found.columns == ["row", "n_words", "n_features", "weight", "score", "rank"]
    assert got(found) == by_hand(rows, target, percent, least, runs, buckets)


def test_checksums():
    texts = [b"", b"a", b"123456789", "ñé日本".encode(), b"x" * 64, b"y" * 65, b"z" * 5000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    assert resampling.crc32(data, ends - [len(t) for t in texts], ends).tolist() == [zlib.crc32(t) for t in texts]


@pytest.mark.parametrize("halvings", [1, 5])
def test_nth_by_halving(spark, monkeypatch, halvings):
    monkeypatch.setattr(resampling, "HALVINGS", halvings)
    values = sorted([-(1 << 40), -7, -7, 0, 3, 3, 3, 12, 1 << 61])
    rows = spark.createDataFrame([(v,) for v in values], "v BIGINT")
    for k in (1, 2, 3, 6, 9):
        assert resampling.nth(rows, F.col("v"), k) == (values[k - 1], sum(v < values[k - 1] for v in values))


def test_nothing_drawn_without_enough_words(shipped):
    docs = shipped.createDataFrame([(1, "a b c"), (2, None)], "doc_id BIGINT, text STRING")
    assert [r["rank"] for r in resampling.resampled(docs, docs.select("text")).collect()] == [None, None]


def test_equal_rows_of_one_id_are_spread(shipped):
    """A third of the rows hold one score and id: they are told apart by their place and numbered in ranges of equal size."""
    rows = [(7, "w " * 30)] * 400 + [(i, f"w{i} " * 25) for i in range(1000, 1800)]
    docs = shipped.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(6)
    found = resampling.resampled(docs, docs.select("text"), None, 100).select("rank", F.spark_partition_id().alias("part")).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 1201))
