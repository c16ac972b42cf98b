"""A saved index that follows changes by appending: each batch adds a folder of postings and a list of documents that it replaces.

Below the index's folder ``segments/postings``, ``dead``, ``terms`` and ``totals`` each have a folder per batch. A posting counts if no later batch
replaced its document; frequencies and sums are those of the index plus those of all batches. What a batch writes follows its changes, and a
batch that is run again overwrites its own folders. ``compact`` writes all as one index again, before the lists of replaced documents
grow large.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from shelfmark.functions.text import TOKEN
from shelfmark.operators.index import (
    BUCKET_ROWS,
    SearchIndex,
    analysed,
    bucket_of,
    load_index,
    posting_rows,
    term_rows,
    total_row,
    with_average,
)
from shelfmark.session import settled, written

_DEAD = "doc_id BIGINT, batch BIGINT"
_TERMS = "term STRING, df BIGINT, cf BIGINT"
_TOTALS = "n_docs BIGINT, sum_len BIGINT"


def append_segment(spark: SparkSession, path: str, batch: int, before: DataFrame, after: DataFrame, pattern: str = TOKEN) -> None:
    """Adds the changes of one batch to the index at ``path``; batches are numbered upwards.

    ``before`` and ``after`` are (doc_id, name) of the changed documents alone, as indexed and as they are now; one that is
    new or gone is in one of them.
    """
    buckets = spark.read.parquet(f"{path}/buckets").first()["buckets"]
    at = lambda what: f"{path}/segments/{what}/batch={batch}"
    old, new = (settled(analysed(df, "doc_id", "name", pattern)) for df in (before, after))
    written(old.select("doc_id").union(new.select("doc_id")).distinct(), at("dead"))
    added = written(posting_rows(new, buckets).repartition("bucket"), at("postings"), partition_by="bucket")
    minus = lambda df, *columns: df.select(*[c for c in df.columns if c not in columns], *[(-F.col(c)).alias(c) for c in columns])
    gone = minus(term_rows(posting_rows(old)), "df", "cf")
    parts = gone.unionByName(term_rows(added)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    written(parts.where("df <> 0 OR cf <> 0"), at("terms"))
    sums = [total_row(words).select("n_docs", "sum_len") for words in (old, new)]
    written(minus(sums[0], "n_docs", "sum_len").unionByName(sums[1]).agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_len").alias("sum_len")), at("totals"))


def load_segments(spark: SparkSession, path: str) -> SearchIndex:
    """The index at ``path`` with all batches appended to it. A term's folders are opened in each segment, no others."""
    base = load_index(spark, path)
    columns = base.postings.columns
    kinds = StructType([*base.postings.schema.fields]).add("batch", LongType())
    added = _read(spark, f"{path}/segments/postings", kinds)
    last = _read(spark, f"{path}/segments/dead", _DEAD).groupBy("doc_id").agg(F.max("batch").alias("_died"))
    all_ = base.postings.withColumn("batch", F.lit(-1).cast("bigint")).unionByName(added.select(*columns, "batch"))
    live = all_.join(last, "doc_id", "left").where("_died IS NULL OR batch >= _died").select(*columns)
    terms = base.terms.select("term", "df", "cf").unionByName(_read(spark, f"{path}/segments/terms", _TERMS).select("term", "df", "cf"))
    terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    totals = base.totals.select("n_docs", "sum_len").unionByName(_read(spark, f"{path}/segments/totals", _TOTALS).select("n_docs", "sum_len"))
    totals = with_average(totals.agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_len").alias("sum_len")))
    return SearchIndex(live, terms, totals, base.buckets)


def compact(spark: SparkSession, path: str, target: str) -> SearchIndex:
    """Writes the index at ``path`` with its batches to ``target`` as an index without any; no text is read."""
    index = load_segments(spark, path)
    totals = written(index.totals, f"{target}/totals")
    buckets = max(1, -(-(totals.first()["sum_len"] or 0) // BUCKET_ROWS))
    placed = index.postings.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", "bucket")
    written(placed.sortWithinPartitions("bucket", "term", "doc_id"), f"{target}/postings", partition_by="bucket")
    written(index.terms, f"{target}/terms")
    written(spark.range(1).select(F.lit(buckets).alias("buckets")), f"{target}/buckets")
    return load_index(spark, target)


def _read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
