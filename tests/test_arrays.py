"""Steps of the search that work on columns of numbers, against plain versions and with small bounds."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import arrays, typos
from shelfmark.operators import index as indexes
from shelfmark.operators import requests as req
from shelfmark.operators import search as text_search

REQUEST = "query_id BIGINT, query STRING, size INT"


@pytest.mark.parametrize("bound", [1, 7, 1 << 20])
def test_best_of_documents(spark, monkeypatch, bound):
    for name in ("CHUNK_ROWS", "CHUNK_PAIRS", "CHUNK_PRODUCTS"):
        monkeypatch.setattr(arrays, name, bound)
    rng = random.Random(5)
    lists = {t: [(q, rng.choice([0.5, 1.0])) for q in sorted(rng.sample(range(4), rng.randint(1, 4)))] for t in (3, 9, 1 << 40)}
    sizes, docs = [2, 1, 0, 50], [None, *range(12)]
    rows = [(d, rng.choice(list(lists)), None, float(rng.randint(1, 3))) for d in docs for _ in range(5)] + [(d, None, rng.randrange(4), 0.25) for d in docs]
    table = spark.createDataFrame(list(lists.items()), "_t BIGINT, list ARRAY<STRUCT<_q: INT, w: DOUBLE>>").toArrow()
    got = arrays.best_of_documents(
        spark.createDataFrame(rows, "doc_id BIGINT, _t BIGINT, _q INT, value DOUBLE").repartition(2, "doc_id").sortWithinPartitions("doc_id"), table, np.array(sizes)
    )
    got = {(r["_q"], r["doc_id"]): r["score"] for r in got.collect()}
    want = collections.Counter()
    for d, t, q, v in rows:
        for request, w in lists[t] if t is not None else [(q, 1.0)]:
            want[request, d] += v * w
    assert all(want[pair] == score for pair, score in got.items())
    for q, size in enumerate(sizes):
        scores = sorted((s for (request, _), s in want.items() if request == q), reverse=True)
        assert {p for p, s in want.items() if p[0] == q and size and s >= scores[min(size, len(scores)) - 1]} <= set(got)
    assert not any(q == 2 for q, _ in got)


def test_words_that_meet_most_documents_are_added_up_in_a_table(spark, monkeypatch):
    """No row for each request, document and word: postings go to their documents once and meet all requests there."""
    rng = random.Random(6)
    words = ["alpha", "alphas", "alhpa", "beta", "betas", "gamma", "gamme", "delta"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12))) for i in range(60)], "doc_id BIGINT, name STRING")
    requests = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6)), 1 + i) for i in range(8)] + [(3, "beta", 9)], REQUEST)
    index = indexes.scratch_index(docs, "doc_id", "name")
    run = lambda: sorted(tuple(r) for r in text_search.search(requests, index, docs).collect())
    sent = []
    original = text_search.best_of_documents
    monkeypatch.setattr(text_search, "best_of_documents", lambda rows, *rest: sent.append(rows.count()) or original(rows, *rest))
    by_table = run()
    postings = index.postings.count()
    assert len(sent) == 1 and sent[0] <= postings + 2 * 60 * 9
    monkeypatch.setattr(text_search, "TABLE_PRODUCTS", 0)
    assert run() == by_table and len(sent) == 2
    monkeypatch.setattr(text_search, "_products", lambda weights: 0)
    assert run() == by_table and len(sent) == 2 and len(by_table) > 8


def test_terms_of_a_wide_prefix_are_not_written_for_each_candidate(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"red fox a{i:03d}") for i in range(200)] + [(900, "red fox"), (901, "fox red a001")], "doc_id BIGINT, name STRING")
    index = indexes.scratch_index(docs, "doc_id", "name")
    words = req.query_tokens(spark.createDataFrame([(1, "red fox a")], "query_id BIGINT, text STRING"))
    slots = text_search.prefix_slots(words, index)
    run = lambda: {(r.query_id, r.doc_id, r.freq) for r in text_search.phrase_matches(slots, index).collect()}
    plain = run()
    assert plain == {(1, i, 1) for i in range(200)}
    rows, original = [], text_search.settled
    monkeypatch.setattr(text_search, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(text_search, "settled", lambda df: rows.append(original(df)) or rows[-1])
    assert run() == plain
    assert max(df.count() for df in rows) <= 3 * 202


def test_near_terms_by_numbers_are_those_by_keys(spark, monkeypatch):
    rng = random.Random(7)
    terms = {"".join(rng.choice("abñ😀") for _ in range(rng.randint(1, 8))) for _ in range(250)}
    terms |= {"abcdefghijklmno"[: 15 - i] + tail for i in range(3) for tail in ("", "x", "xyz")}
    df = spark.createDataFrame([(t, i) for i, t in enumerate(sorted(terms))], "term STRING, df BIGINT")
    words = df.where("df % 3 = 0").select(F.col("term").alias("qterm")).unionByName(spark.createDataFrame([("abcdefghijklmon",), ("zz",)], "qterm STRING"))
    run = lambda: sorted(tuple(r) for r in typos.fuzzy_terms(words, df).collect())
    numbers = run()
    monkeypatch.setattr(typos, "ARRAY_TERMS", 0)
    monkeypatch.setattr(typos, "pairs_of_dropped", None)
    assert run() == numbers and len(numbers) > 200


def test_folded_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(arrays, "CHUNK_WORDS", 5)
    docs = [(1, "b a b"), (2, "é " * 9), (None, "a"), (4, ""), (5, "c b a c c"), (6, None)]
    words = indexes.analysed(spark.createDataFrame(docs, "doc_id BIGINT, name STRING").coalesce(1), "doc_id", "name")
    want = {}
    for d, text in docs:
        for i, w in enumerate((text or "").split()):
            want.setdefault((w, d), []).append(i)
    got = {(r.term, r.doc_id): r.positions for r in arrays.folded(words).collect()}
    assert got == want
