"""An index that follows batches of changes by appended segments."""

import os
import random

from pyspark.sql import functions as F

from shelfmark.operators import index as indexes
from shelfmark.operators import search as text_search
from shelfmark.operators import segments

DOCS = "doc_id BIGINT, name STRING"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def size(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def equal(index, docs):
    plain = indexes.build_index(docs, "doc_id", "name")
    columns = ["term", "doc_id", "doc_len", "tf", "positions"]
    assert rows(index.postings.select(*columns)) == rows(plain.postings.select(*columns))
    assert rows(index.terms) == rows(plain.terms)
    assert rows(index.totals) == rows(plain.totals)


def test_twenty_batches_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "BUCKET_ROWS", 400)
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["milk", "cod", "raw", "whole", "x", f"w{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 9)))
    docs = {i: text() for i in range(400)}
    path = str(tmp_path / "index")
    indexes.save_index(spark.createDataFrame(list(docs.items()), DOCS), "doc_id", "name", path)
    for batch in range(20):
        ids = rng.sample(range(420), 4)
        before = [(i, docs[i]) for i in ids if i in docs]
        for i in ids:
            docs.pop(i, None)
            if rng.random() < 0.7:
                docs[i] = text()
        after = [(i, docs[i]) for i in ids if i in docs]
        segments.append_segment(spark, path, batch, *[spark.createDataFrame(x, DOCS) for x in (before, after)])
        if batch == 3:  # run again after a failure
            segments.append_segment(spark, path, batch, *[spark.createDataFrame(x, DOCS) for x in (before, after)])
    now = spark.createDataFrame(list(docs.items()), DOCS)
    index = segments.load_segments(spark, path)
    equal(index, now)
    requests = spark.createDataFrame([(1, "milk cod", 5), (2, "whole w1", 5)], "query_id BIGINT, query STRING, size INT")
    plain = indexes.build_index(now, "doc_id", "name")
    assert rows(text_search.search(requests, index, now).select("query_id", "rank", "doc_id")) == rows(text_search.search(requests, plain, now).select("query_id", "rank", "doc_id"))
    packed = segments.compact(spark, path, str(tmp_path / "packed"))
    equal(packed, now)
    equal(segments.load_segments(spark, str(tmp_path / "packed")), now)


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 256)).alias("name"))
    path = str(tmp_path / "index")
    indexes.save_index(docs, "doc_id", "name", path)
    whole = size(path)
    segments.append_segment(spark, path, 0, docs.where("doc_id < 5"), docs.where("doc_id < 5").withColumn("name", F.lit("changed words")))
    assert size(f"{path}/segments") < whole / 20
    term = spark.createDataFrame([("changed",)], "term STRING")
    assert text_search._postings_of(segments.load_segments(spark, path), term).count() == 5
