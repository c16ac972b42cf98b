"""Text search for a table of requests.

Three clauses score every matching document: all words in a row, all words in a row
with the last one a prefix, and any word with typos allowed. Their scores are added and
the best documents of each request are ranked.

A request's words are reduced to distinct terms before any term table is read; postings
are joined on their terms, and what they add to the requests is summed where a document's
postings lie, so that only the best of each part of the documents go on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfmark.fixed import MATCH_BOOST, MAX_SIZE, MIN_SIZE, PHRASE_BOOST, PREFIX_BOOST
from shelfmark.functions.scoring import idf, saturation
from shelfmark.functions.text import TOKEN, sanitize_query
from shelfmark.operators.arrays import best_of_documents
from shelfmark.operators.index import SearchIndex, bucket_of
from shelfmark.operators.requests import query_tokens, valid_requests
from shelfmark.operators.skew import BROADCAST_KEYS, fits_broadcast
from shelfmark.operators.typos import LONGEST, fuzzy_terms
from shelfmark.session import settled, shuffle_partitions

STRATEGIES = ("combined", "match")

# A term is frequent from this share of the documents on. As a document holds a limited number of terms, their number does
# not grow with the documents.
FREQUENT_SHARE = 1000

# Pairs of a request and a document that one task adds up, about.
PART_PAIRS = 500_000

# Weights of frequent terms and requests that every task may hold (12 bytes each).
TABLE_PRODUCTS = 4_000_000

# Places of phrases that one task counts, about.
PART_PLACES = 250_000


def prefix_terms(
    prefixes: DataFrame, terms: DataFrame, max_expansions: int | None = None
) -> DataFrame:
    """(prefix, term, df): terms starting with a prefix; with ``max_expansions`` the first in term order.

    A term is cut to each length that some prefix has, and joined on equality.
    """
    wanted = prefixes.select("prefix").distinct()
    lengths = wanted.agg(F.collect_set(_length_class(F.col("prefix"))).alias("l")).scalar()
    cut = terms.withColumn("_lengths", lengths).select(
        "term", "df", F.explode(F.filter("_lengths", lambda n: n <= F.length("term"))).alias("_cut")
    ).withColumn("_head", F.substring("term", F.lit(1), F.col("_cut")))
    head = F.substring("prefix", 1, LONGEST)
    found = wanted.withColumn("_head", head).join(cut, "_head").where(F.col("term").startswith(F.col("prefix")))
    if max_expansions is None:
        return found.select("prefix", "term", "df")
    first = Window.partitionBy("prefix").orderBy("term")
    return (
        found.withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= max_expansions)
        .select("prefix", "term", "df")
    )


@dataclass(frozen=True)
class MatchWeights:
    """What a word adds to a score is ``u`` times the sum, over its near terms in the document, of ``weight`` times the frequency part."""

    asked: DataFrame  # query_id, qterm, u
    near: DataFrame  # qterm, term, df, weight


def match_weights(
    words: DataFrame, index: SearchIndex, max_expansions: int | None = None
) -> MatchWeights:
    """The words of each request and the terms near each word, which are the same for every request.

    All expansions of a searched term share its rarest-case weight: the idf of the
    largest document frequency among them. A word asked for twice counts twice.
    """
    near = settled(fuzzy_terms(words, index.terms, max_expansions).select("qterm", "term", "df", "weight"))
    n_docs = index.totals.select("n_docs").scalar()
    widest = near.groupBy("qterm").agg(F.max("df").alias("_df"))
    asked = words.groupBy("query_id", "qterm").agg(F.count(F.lit(1)).alias("_times")).join(widest, "qterm")
    return MatchWeights(settled(asked.select("query_id", "qterm", (idf(n_docs, F.col("_df")) * F.col("_times")).alias("u"))), near)


def match_scores(weights: MatchWeights, index: SearchIndex, boost: float = MATCH_BOOST) -> DataFrame:
    """(query_id, doc_id, score) per request, document and matched term; to be summed."""
    average = index.totals.select("avg_len").scalar()
    part = F.col("weight") * saturation(F.col("tf"), F.col("doc_len"), average)
    found = _near_postings(index.postings, weights.near, index).join(_few(weights.asked), "qterm")
    return found.select("query_id", "doc_id", (F.lit(boost) * F.col("u") * part).alias("score"))


def _near_postings(postings: DataFrame, near: DataFrame, index: SearchIndex) -> DataFrame:
    """(doc_id, doc_len, tf, qterm, weight): each of ``postings`` with the words that its term is near to."""
    placed = near.where("term >= ''").select(bucket_of(F.col("term"), index.buckets).alias("bucket"), "term", "qterm", "weight")
    return postings.join(_few(placed), ["bucket", "term"]).select("doc_id", "doc_len", "tf", "qterm", "weight")


def best_scores(
    weights: MatchWeights, others: DataFrame, sizes: DataFrame, index: SearchIndex, boost: float = MATCH_BOOST
) -> DataFrame:
    """(query_id, doc_id, score), summed, for the documents that reach the ``size`` best of their request.

    ``others`` (query_id, doc_id, score) is what other clauses add, ``sizes`` (query_id, size). What the words have in
    a document and what the other clauses add are brought together by document, once for all requests. The task that holds
    a document then adds up its score for each request and passes on only what is among the best of its own documents,
    so rows of requests times documents are neither shuffled nor written.
    """
    products, every = _products(weights), sizes.count() * (index.totals.first()["n_docs"] or 0)
    partitions = _parts(sizes.sparkSession, min(products, every), PART_PAIRS)
    # Where words add to most pairs, each several times, the pairs are a table of numbers; elsewhere they are rows.
    best = (_best_by_table if products >= every else _best_by_rows)(weights, others, sizes, index, boost, partitions)
    best = settled(best.select("query_id", "size", "doc_id", "score"))
    reached = _top(best, [F.desc(F.round("score", 6))], "_place").where("_place = size").select(
        "query_id", F.round("score", 6).alias("_reach")
    )
    near = best.join(_few(reached), "query_id", "left").where(F.col("_reach").isNull() | (F.round("score", 6) >= F.col("_reach")))
    return near.select("query_id", "doc_id", "score")


def _by_part(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(partitions)).cast("int")).repartitionById(partitions, "_part")


def _best_by_rows(
    weights: MatchWeights, others: DataFrame, sizes: DataFrame, index: SearchIndex, boost: float, partitions: int
) -> DataFrame:
    """(query_id, size, doc_id, score): the best of each part, ranked among its rows."""
    n_docs, average = (index.totals.select(c).scalar() for c in ("n_docs", "avg_len"))
    # Frequent terms hold most postings and are near to several words each, so their words are looked up after the shuffle.
    often = F.col("df") * FREQUENT_SHARE >= n_docs
    often = often if fits_broadcast(weights.near.where(often)) else F.lit(False)
    frequent = F.broadcast(weights.near.where(often).select("term", F.col("qterm").alias("_near"), F.col("weight").alias("_w")))
    known = F.broadcast(weights.near.where(often).select("term").distinct())
    rows = {
        "frequent": _postings_of(index, known).select("doc_id", "doc_len", "tf", "term"),
        "rare": _near_postings(index.postings.join(known, "term", "left_anti"), weights.near.where(~often), index),
        "others": others.select("doc_id", F.col("score").alias("weight"), F.col("query_id").alias("_query")),
    }
    placed = _by_part(
        rows["frequent"].unionByName(rows["rare"], allowMissingColumns=True).unionByName(rows["others"], allowMissingColumns=True), partitions
    )
    words = placed.join(frequent, "term", "left").withColumn("qterm", F.coalesce("qterm", "_near"))
    part = F.lit(boost) * F.col("u") * saturation(F.col("tf"), F.col("doc_len"), average)
    score = F.coalesce(part, F.lit(1.0)) * F.coalesce("weight", "_w")
    scores = words.join(_few(weights.asked), "qterm", "left").groupBy(
        "_part", F.coalesce("query_id", "_query").alias("query_id"), "doc_id"
    ).agg(F.sum(score).alias("score"))
    # Equal after rounding is a tie, as in the ranking; all of those on the last place stay.
    own = Window.partitionBy("_part", "query_id").orderBy(F.desc(F.round("score", 6)))
    wanted = _few(sizes.groupBy("query_id").agg(F.max("size").alias("size")))
    return scores.withColumn("_rank", F.rank().over(own)).where(F.col("_rank") <= MAX_SIZE).join(wanted, "query_id").where("_rank <= size")


def _best_by_table(
    weights: MatchWeights, others: DataFrame, sizes: DataFrame, index: SearchIndex, boost: float, partitions: int
) -> DataFrame:
    """As ``_best_by_rows``, added up in a table of documents and requests.

    What a term adds to each request is summed over the words it is near to before any posting is read. A posting of a frequent
    term goes to its document once and meets the term's list there; one of a rare term takes its short list along.
    """
    spark = sizes.sparkSession
    n_docs, average = (index.totals.select(c).scalar() for c in ("n_docs", "avg_len"))
    asked = sizes.where("query_id IS NOT NULL").groupBy("query_id").agg(F.max("size").alias("size")).toArrow()
    asked = asked.add_column(0, "_q", pa.array(np.arange(len(asked), dtype=np.int32)))
    numbered = F.broadcast(spark.createDataFrame(asked, StructType([StructField("_q", IntegerType()), *(sizes.schema[c] for c in ("query_id", "size"))])))
    adds = weights.near.join(_few(weights.asked), "qterm").join(numbered.select("query_id", "_q"), "query_id").groupBy("term", "_q").agg(
        F.max("df").alias("df"), (F.lit(boost) * F.sum(F.col("u") * F.col("weight"))).alias("w")
    )
    lists = adds.groupBy("term").agg(F.max("df").alias("df"), F.sort_array(F.collect_list(F.struct("_q", "w"))).alias("list"))
    lists = settled(lists.withColumn("often", F.col("df") * FREQUENT_SHARE >= n_docs).withColumn("_t", F.monotonically_increasing_id()))
    n_often = lists.where("often").agg(F.sum(F.size("list"))).first()[0] or 0
    often = F.col("often") if n_often <= TABLE_PRODUCTS else F.lit(False)
    placed = lists.where("term >= ''").select(
        bucket_of(F.col("term"), index.buckets).alias("bucket"), "term", F.when(often, F.col("_t")).alias("_t"), F.when(~often, F.col("list")).alias("list")
    )
    part = saturation(F.col("tf"), F.col("doc_len"), average)
    found = index.postings.join(_few(placed), ["bucket", "term"]).select("doc_id", part.alias("part"), "_t", F.inline_outer("list"))
    found = found.select("doc_id", "_t", "_q", (F.col("part") * F.coalesce("w", F.lit(1.0))).alias("value"))
    given = others.join(numbered, "query_id").select("doc_id", F.lit(None).cast("bigint").alias("_t"), "_q", F.col("score").alias("value"))
    rows = _by_part(found.unionByName(given), partitions).sortWithinPartitions("doc_id")
    best = best_of_documents(rows, lists.where(often).select("_t", "list").toArrow(), asked.column("size").fill_null(0).to_numpy().astype(np.int64))
    return best.join(numbered, "_q")


def _products(weights: MatchWeights) -> int:
    """What words add to pairs of a request and a document, counted; a word has each document of its near terms."""
    times = weights.asked.groupBy("qterm").agg(F.count(F.lit(1)).alias("_asked"))
    rows = weights.near.groupBy("qterm").agg(F.sum("df").alias("_df")).join(times, "qterm").agg(F.sum(F.col("_df") * F.col("_asked")).alias("n"))
    return rows.first()["n"] or 0


def _parts(spark: SparkSession, rows: int, each: int) -> int:
    """The shuffle partitions, or more of about ``each`` rows, so what a task holds does not grow with the rows."""
    return max(shuffle_partitions(spark), -(-rows // each))


def _few(rows: DataFrame) -> DataFrame:
    """To be broadcast if it is small; otherwise as it is."""
    return F.broadcast(rows) if fits_broadcast(rows) else rows


def phrase_slots(words: DataFrame, index: SearchIndex, boost: float = PHRASE_BOOST) -> DataFrame:
    """(query_id, boost, n, qpos, term, df): the one term allowed at each position."""
    known = index.terms.withColumnRenamed("term", "qterm")
    return words.join(known, "qterm").select(
        "query_id", F.lit(boost).alias("boost"), "n", "qpos", F.col("qterm").alias("term"), "df"
    )


def prefix_slots(
    words: DataFrame,
    index: SearchIndex,
    max_expansions: int | None = None,
    boost: float = PREFIX_BOOST,
) -> DataFrame:
    """As ``phrase_slots``, with every expansion allowed at the last position."""
    last = F.col("qpos") == F.col("n") - 1
    tails = words.where(last)
    expansions = prefix_terms(tails.select(F.col("qterm").alias("prefix")), index.terms, max_expansions)
    tail = tails.withColumnRenamed("qterm", "prefix").join(expansions, "prefix").select(
        "query_id", F.lit(boost).alias("boost"), "n", "qpos", "term", "df"
    )
    return phrase_slots(words.where(~last), index, boost).unionByName(tail)


def phrase_matches(slots: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, boost, doc_id, doc_len, freq, idf_sum): documents with all positions in a row.

    Documents of the request's rarest position are the candidates. The other positions' terms are looked up
    for those documents; each gives where the phrase would begin, and the begins common to all positions are
    the occurrences.
    """
    n_docs = index.totals.select("n_docs").scalar()
    keys = ["query_id", "boost", "n"]
    positions = slots.groupBy(*keys, "qpos").agg(F.sum("df").alias("_df"), F.sum(idf(n_docs, F.col("df"))).alias("_idf"))
    plans = positions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_found"),
        F.sum("_idf").alias("idf_sum"),
        F.min(F.struct("_df", "qpos")).alias("_rarest"),
    ).where(F.col("_found") == F.col("n"))
    chosen = settled(slots.join(plans.select(*keys, "idf_sum", F.col("_rarest.qpos").alias("_at")), keys))
    found = lambda slots: _postings_of(index, slots.select("term").distinct()).select("term", "doc_id", "doc_len", "positions")
    columns = [*keys, "idf_sum", "qpos", "doc_id", "doc_len"]
    rarest, rest = chosen.where("qpos = _at"), chosen.where("qpos <> _at")
    first = settled(found(rarest).join(_few(rarest), "term").select(*columns, "positions"))
    # Rows take few bytes in files, so few tasks would read them; they are brought together by document in parts that follow their number.
    spark, n_first = first.sparkSession, first.count()
    candidates = settled(first.select(*keys, "doc_id").repartition(_parts(spark, n_first, PART_PLACES), "doc_id").distinct())
    # A request has a candidate for each of its documents, and looks up each term of its other positions there.
    counts = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_docs")).join(rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("_slots")), keys)
    sums = counts.agg(F.sum(F.col("_docs") * F.col("_slots")).alias("slots"), F.sum("_docs").alias("docs")).first()
    n_others, longest = sums["slots"] or 0, (sums["docs"] or 0) * (index.totals.first()["avg_len"] or 0)
    if n_others > max(BROADCAST_KEYS, longest):
        # A prefix may begin so many terms that those held by the candidates are fewer than those looked for.
        there = candidates.select("doc_id").distinct()
        held = found(rest).join(_few(there), "doc_id", "left_semi").join(candidates, "doc_id")
        more = settled(held.join(rest, [*keys, "term"]).select(*columns, "positions"))
        n_others = more.count()
    else:
        others = settled(rest.join(candidates, keys))
        asked = F.broadcast(others) if n_others <= BROADCAST_KEYS else others.repartition(_parts(spark, n_others, PART_PLACES), "term", "doc_id")
        more = found(rest).join(asked, ["term", "doc_id"]).select(*columns, "positions")
    placed = first.unionByName(more).repartition(_parts(spark, n_first + n_others, PART_PLACES), "doc_id")
    begins = placed.select(
        *columns, F.explode(F.transform("positions", lambda p: p - F.col("qpos"))).alias("_start")
    ).where("_start >= 0 AND _start + n <= doc_len")
    # A position may be held by several terms, a place by one of them.
    rows = begins.groupBy(*keys, "idf_sum", "doc_id", "doc_len", "_start").agg(F.count(F.lit(1)).alias("_hits"))
    return rows.where("_hits = n").groupBy("query_id", "boost", "doc_id", "doc_len", "idf_sum").agg(
        F.count(F.lit(1)).alias("freq")
    )


def phrase_scores(matches: DataFrame, index: SearchIndex) -> DataFrame:
    average = index.totals.select("avg_len").scalar()
    part = saturation(F.col("freq"), F.col("doc_len"), average)
    return matches.select("query_id", "doc_id", (F.col("boost") * F.col("idf_sum") * part).alias("score"))


def search(
    requests: DataFrame,
    index: SearchIndex,
    documents: DataFrame,
    strategy: str = "combined",
    max_expansions: int | None = None,
    pattern: str = TOKEN,
    unicode_queries: bool = False,
    stale: bool = False,
) -> DataFrame:
    """(query_id, rank, doc_id, score, ...documents' other columns) for valid requests.

    ``documents`` has doc_id and name; ``stale`` says that some indexed documents may be missing there. ``strategy`` is ``combined`` (three clauses, the
    text sanitised) or ``match`` (typo-tolerant words only, the text as given).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    valid = valid_requests(requests)
    text = sanitize_query("query", unicode_queries) if strategy == "combined" else F.col("query")
    words = settled(query_tokens(valid.select("query_id", text.alias("text")), pattern))
    weights = match_weights(words, index, max_expansions)
    if strategy == "combined":
        slots = settled(phrase_slots(words, index).unionByName(prefix_slots(words, index, max_expansions)))
        others = phrase_scores(phrase_matches(slots, index), index)
    else:
        others = weights.asked.select("query_id", F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"), F.lit(0.0).alias("score")).where("false")
    # A document that went since the index was built must not take a place.
    there = documents.select("doc_id")
    present = SearchIndex(index.postings.join(there, "doc_id", "left_semi"), index.terms, index.totals, index.buckets) if stale else index
    others = settled(others.join(there, "doc_id", "left_semi") if stale else others)
    return rank_hits(best_scores(weights, others, valid.select("query_id", "size"), present), valid, documents)


def rank_hits(scores: DataFrame, requests: DataFrame, documents: DataFrame) -> DataFrame:
    """The best ``size`` documents per request: score down, name up, id up.

    Scores are rounded first, so the order in which parts were added cannot decide a
    rank. The score of the last place is found first; documents that reach it, however
    many tie on it, then get their names and are ranked. Both rankings are cut before
    the shuffle, so the ties of one request are never brought together.
    """
    allowed = F.col("size").between(MIN_SIZE, MAX_SIZE)
    sizes = requests.select("query_id", F.when(allowed, F.col("size")).otherwise(F.raise_error(F.lit("a size is out of range"))).alias("size"))
    # Read twice below, so the sums are written rather than added up twice.
    totals = settled(scores.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score")))
    last = _top(totals, [F.desc("score")], "_place").join(sizes, "query_id").where("_place <= size").groupBy(
        "query_id", "size"
    ).agg(F.min("score").alias("_last"))
    # A row per request; broadcast if there are few, so the sums are not shuffled by request.
    if fits_broadcast(sizes):
        last = F.broadcast(last)
    near = totals.join(last, "query_id").where(F.col("score") >= F.col("_last")).drop("_last")
    named = near.join(documents, "doc_id")
    rest = [c for c in documents.columns if c != "doc_id"]
    return (
        _top(named, [F.desc("score"), F.asc("name"), F.asc("doc_id")], "rank")
        .where("rank <= size")
        .select("query_id", "rank", "doc_id", "score", *rest)
    )


def _top(rows: DataFrame, order: list[Column], place: str) -> DataFrame:
    """The first rows per request; the literal bound, the largest size allowed, is applied map-side."""
    window = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn(place, F.row_number().over(window)).where(F.col(place) <= MAX_SIZE)


def _postings_of(index: SearchIndex, searched: DataFrame) -> DataFrame:
    """Postings of the searched terms.

    Only the folders of their buckets are opened: the planner prunes partitions by a
    joined table if that is filtered, and a comparison that all terms pass will do.
    """
    keys = searched.where("term >= ''").withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    return index.postings.join(_few(keys), ["bucket", "term"], "left_semi")


def _length_class(term: Column) -> Column:
    return F.least(F.length(term), F.lit(LONGEST))
