"""The tables that text search reads.

``postings`` has a row per term and document with the number of occurrences and their
positions, ``terms`` a row per distinct term with the documents holding it and the
occurrences, ``totals`` one row of sums over the documents. For repeated use write them once
with ``save_index``: the postings are then partitioned by a hash of the term and sorted, so a
search opens only the folders of its own terms. ``updated`` follows changed documents
without reading the others' texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import TOKEN, tokens as split
from shelfmark.operators.arrays import folded
from shelfmark.operators.skew import fits_broadcast
from shelfmark.session import drop_folder, scratch_dir, written

# Postings of a folder, about; their number decides how many folders there are.
BUCKET_ROWS = 2_000_000


@dataclass(frozen=True)
class SearchIndex:
    postings: DataFrame  # bucket, term, doc_id, doc_len, tf, positions
    terms: DataFrame  # term, df, cf
    totals: DataFrame  # n_docs, sum_len, avg_len
    buckets: int = 1


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def analysed(docs: DataFrame, id_column: str, text_column: str, pattern: str = TOKEN) -> DataFrame:
    """(doc_id, doc_len, words): the tokens of every document in order."""
    words = docs.select(F.col(id_column).alias("doc_id"), split(text_column, pattern).alias("words"))
    return words.select("doc_id", F.size("words").alias("doc_len"), "words")


def posting_rows(words: DataFrame, buckets: int = 1) -> DataFrame:
    """Occurrences folded by term and document, within the row of the document, so nothing is shuffled.

    Only rows that share their doc_id with another one are brought together, by term and length.
    """
    alone, repeated = _by_id(words)
    rows = _folded(alone).unionByName(_merged(repeated))
    return rows.select(bucket_of(F.col("term"), buckets).alias("bucket"), *_KEYS, F.size("positions").alias("tf"), "positions")


def term_counts(words: DataFrame) -> DataFrame:
    """``term_rows`` of the postings of ``words`` without making them: each word counts as an occurrence, each distinct one of a row as a document."""
    alone, repeated = _by_id(words)
    rows = alone.select("doc_len", F.posexplode(F.concat("words", F.array_distinct("words"))).alias("_i", "term"))
    again = F.col("_i") >= F.col("doc_len")
    counts = rows.groupBy("term").agg(F.count_if(again).alias("df"), F.count_if(~again).alias("cf"))
    shared = term_rows(_merged(repeated).withColumn("tf", F.size("positions")))
    return counts.unionByName(shared).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


_KEYS = ("term", "doc_id", "doc_len")


def _by_id(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose doc_id no other row has, and the others; null counts as an id."""
    ids = words.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    repeated = F.broadcast(ids) if fits_broadcast(ids) else ids
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    return words.join(repeated, same, "left_anti"), words.join(repeated, same, "left_semi")


def _merged(words: DataFrame) -> DataFrame:
    """``_folded`` over all rows of a doc_id that have the same length."""
    return _folded(words).groupBy(*_KEYS).agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def _folded(words: DataFrame) -> DataFrame:
    """(term, doc_id, doc_len, positions) of each row."""
    return folded(words.where("doc_len > 0"))


def term_rows(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf"))


def total_row(words: DataFrame) -> DataFrame:
    """Documents without any token do not count."""
    sums = words.where("doc_len > 0").agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("bigint").alias("sum_len")
    )
    return with_average(sums)


def with_average(sums: DataFrame) -> DataFrame:
    return sums.withColumn("avg_len", F.try_divide(F.col("sum_len").cast("double"), F.col("n_docs")))


def index_of(words: DataFrame) -> SearchIndex:
    return SearchIndex(posting_rows(words), term_counts(words), total_row(words))


def build_index(docs: DataFrame, id_column: str, text_column: str, pattern: str = TOKEN) -> SearchIndex:
    """The tables as plans over ``docs``; nothing is kept, and only the ids that several rows share are looked for."""
    return index_of(analysed(docs, id_column, text_column, pattern))


def save_index(docs: DataFrame, id_column: str, text_column: str, path: str, pattern: str = TOKEN) -> SearchIndex:
    """Write the tables under ``path`` and return them read back.

    The texts are split once, into a folder that goes when the tables are written. The rebalance
    hint lets AQE split a bucket that a frequent term makes large.
    """
    spark = docs.sparkSession
    words = written(analysed(docs, id_column, text_column, pattern), f"{path}/words")
    totals = written(total_row(words), f"{path}/totals")
    # A text has fewer distinct terms than words; this errs towards more folders.
    buckets = max(1, -(-totals.first()["sum_len"] // BUCKET_ROWS))
    placed = posting_rows(words, buckets).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id")
    columns = placed.columns
    postings = written(placed, f"{path}/postings", partition_by="bucket").select(*columns)
    terms = written(term_rows(postings), f"{path}/terms")
    written(spark.range(1).select(F.lit(buckets).alias("buckets")), f"{path}/buckets")
    drop_folder(spark, f"{path}/words")
    return SearchIndex(postings, terms, totals, buckets)


def load_index(spark: SparkSession, path: str) -> SearchIndex:
    read = spark.read.parquet
    buckets = read(f"{path}/buckets").first()["buckets"]
    return SearchIndex(read(f"{path}/postings"), read(f"{path}/terms"), read(f"{path}/totals"), buckets)


def scratch_index(docs: DataFrame, id_column: str, text_column: str, pattern: str = TOKEN) -> SearchIndex:
    """An index kept in the cluster's shared scratch folder."""
    return save_index(docs, id_column, text_column, scratch_dir(docs.sparkSession), pattern)


def updated(index: SearchIndex, before: DataFrame, after: DataFrame, pattern: str = TOKEN) -> SearchIndex:
    """The index after some documents changed.

    ``before`` and ``after`` are (doc_id, name) of the changed documents alone, as indexed and as they
    are now; one that is new or gone is in one of them. Only these are split into words. The postings are
    those of the others and the new ones; frequencies and sums follow by addition.
    """
    old, new = (analysed(df, "doc_id", "name", pattern) for df in (before, after))
    touched = before.select("doc_id").union(after.select("doc_id")).distinct()
    segment = posting_rows(new, index.buckets)
    postings = index.postings.join(touched, "doc_id", "left_anti").select(*segment.columns).unionByName(segment)
    gone = term_rows(posting_rows(old)).select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
    parts = index.terms.select("term", "df", "cf").unionByName(gone).unionByName(term_rows(segment))
    terms = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    less = total_row(old).select((-F.col("n_docs")).alias("n_docs"), (-F.col("sum_len")).alias("sum_len"))
    sums = index.totals.select("n_docs", "sum_len").unionByName(less).unionByName(total_row(new).select("n_docs", "sum_len"))
    totals = with_average(sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_len").alias("sum_len")))
    return SearchIndex(postings, terms, totals, index.buckets)


def term_statistics(index: SearchIndex) -> DataFrame:
    """(term, df, cf): documents holding the term, and occurrences."""
    return index.terms.select("term", "df", "cf")
