"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import parsing
from shelfmark.functions.text import sanitize_query
from shelfmark.operators import changes, constraints, documents, ingest, mutations, quality, store
from shelfmark.operators import index as indexes
from shelfmark.operators import requests as req
from shelfmark.operators import search as text_search
from shelfmark.operators import segments
from shelfmark.operators import typos
from shelfmark.operators.digests import differing_rows
from shelfmark.plans import bindings as b
from shelfmark.plans.catalogue import table_counts
from shelfmark.plans.observed import Loaded, scratch_load
from shelfmark.session import scratch_dir, settled
from shelfmark.streaming.keyed import EventState, event_states, keyed_state, read_all

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Buckets of the tables that queries keep in buckets.
BUCKETS = 16


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- raw text ---------------------------------------------------------------------


@query
def safe_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct raw text of three kinds with its parsed value and how often it occurs."""
    value = parsing.safe_double("raw")
    inf = F.abs(value) == float("inf")
    amounts = b.raw_measures(spark, sf).groupBy(F.col("amount").alias("raw")).agg(F.count("*").alias("n")).select(
        F.lit("double").alias("kind"), "raw", F.lit(None).cast("bigint").alias("int_value"),
        F.when(~F.isnan(value) & ~inf, value).alias("double_value"),
        F.when(F.isnan(value), "nan").when(inf, "inf").alias("special"),
        F.lit(None).cast("string").alias("date_value"), "n",
    )
    ids = b.raw_measures(spark, sf).groupBy(F.col("row_id").alias("raw")).agg(F.count("*").alias("n")).select(
        F.lit("int").alias("kind"), "raw", parsing.safe_int("raw").alias("int_value"),
        F.lit(None).cast("double").alias("double_value"), F.lit(None).cast("string").alias("special"),
        F.lit(None).cast("string").alias("date_value"), "n",
    )
    dates = b.raw_items(spark, sf).groupBy(F.col("published").alias("raw")).agg(F.count("*").alias("n")).select(
        F.lit("date").alias("kind"), "raw", F.lit(None).cast("bigint").alias("int_value"),
        F.lit(None).cast("double").alias("double_value"), F.lit(None).cast("string").alias("special"),
        parsing.safe_date("raw").cast("string").alias("date_value"), "n",
    )
    return amounts.unionByName(ids).unionByName(dates)


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = b.raw_items(spark, sf)
    return raw.select(
        parsing.clean_text("item_class").alias("item_class"),
        parsing.clean_text("description").alias("kept_blank"),
        parsing.blank_to_null("description").alias("blank_to_null"),
    )


# --- load -------------------------------------------------------------------------


def _loaded_items(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.load_items(b.raw_items(spark, sf), b.CLASS)


def _judged_measures(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.judge_measures(b.raw_measures(spark, sf), _loaded_items(spark, sf), b.MAPPING)


@query
def load_reference(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.load_reference(b.raw_reference(spark, sf), b.REFERENCE_IDS)


@query
def load_items(spark: SparkSession, sf: str) -> DataFrame:
    return _loaded_items(spark, sf).withColumn("published", F.col("published").cast("string"))


@query
def load_measures(spark: SparkSession, sf: str) -> DataFrame:
    loaded = ingest.load_measures(b.raw_measures(spark, sf), _loaded_items(spark, sf), b.MAPPING)
    return loaded.select("row_id", "item_id", "measure_id", F.col("amount").cast("string").alias("amount"))


@query
def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.reject_counts(_judged_measures(spark, sf))


@query
def load_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.load_counters(ingest.judge_items(b.raw_items(spark, sf), b.CLASS), _judged_measures(spark, sf))


@query
def load_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.load_funnel(_judged_measures(spark, sf))


@query
def table_totals(spark: SparkSession, sf: str) -> DataFrame:
    return table_counts(b.items(spark, sf), b.measures(spark, sf), b.CLASS)


@query
def measure_counts(spark: SparkSession, sf: str) -> DataFrame:
    return b.measures(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


# --- lookups ----------------------------------------------------------------------


@query
def class_items(spark: SparkSession, sf: str) -> DataFrame:
    return documents.indexable(b.items(spark, sf), b.CLASS, trim_class=False)


@query
def paged_items(spark: SparkSession, sf: str) -> DataFrame:
    return documents.page(documents.indexable(b.items(spark, sf), b.CLASS, trim_class=False), "item_id", offset=20, limit=20)


@query
def lookup_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items that appear as users of the change feed."""
    keys = b.table(spark, sf, "events").select(F.col("user_id").alias("item_id"))
    return documents.lookup(b.items(spark, sf), keys, "item_id")


# --- quality ----------------------------------------------------------------------


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    return (
        quality.item_checks(b.raw_items(spark, sf), b.CLASS)
        .unionByName(quality.measure_checks(b.raw_measures(spark, sf), b.MAPPING))
        .unionByName(quality.reference_checks(b.raw_reference(spark, sf)))
    )


@query
def quality_items(spark: SparkSession, sf: str) -> DataFrame:
    return quality.item_checks(b.raw_items(spark, sf), b.CLASS).select("check", "n", "is_issue")


@query
def quality_reference(spark: SparkSession, sf: str) -> DataFrame:
    return quality.reference_checks(b.raw_reference(spark, sf)).select("check", "n", "is_issue")


@query
def quality_measures(spark: SparkSession, sf: str) -> DataFrame:
    return quality.measure_checks(b.raw_measures(spark, sf), b.MAPPING).select("check", "n", "is_issue")


@query
def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.summarize(_checks(spark, sf))


@query
def quality_lines(spark: SparkSession, sf: str) -> DataFrame:
    return quality.report_lines(_checks(spark, sf)).select("source", "line")


# --- mutations and constraints -----------------------------------------------------


@query
def upsert_items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts without those of Brand#4, changed and extended by one row per line item."""
    base = b.images(spark, sf)["old_items"]
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        F.concat(F.lit("FLAG "), "l_returnflag").alias("item_class"),
        F.col("l_linestatus").alias("description"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    # Equal row ids of one part carry different flags, so the last is made definite.
    changed = lines.groupBy("item_id", "seq").agg(
        F.max("item_class").alias("item_class"), F.max("description").alias("description")
    )
    return mutations.upsert(base, changed, "item_id", "seq")


@query
def insert_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Every event tries to insert its user as an item."""
    base = b.images(spark, sf)["old_items"]
    new = b.table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in b.INSERTS.items()])
    return mutations.insert_status(base, new, "item_id", "seq")


@query
def insert_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a new measure, with and without an id, against the parts and the nations' keys."""
    reference = b.table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("measure_id"))
    return mutations.insert_measures(
        b.keyed_measures(spark, sf), b.measure_batch(spark, sf), b.items(spark, sf), reference
    )


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("measure_id"))


@query
def measure_update_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a change of a measure, refused where it refers to a part or a nation's key that is not there."""
    base, batch = b.keyed_measures(spark, sf), b.measure_changes(spark, sf)
    return mutations.measure_update_status(base, batch, b.items(spark, sf), _nations(spark, sf))


@query
def update_measures(spark: SparkSession, sf: str) -> DataFrame:
    base = b.keyed_measures(spark, sf).select("row_id", "item_id", "measure_id", "amount")
    return mutations.update_measures(base, b.measure_changes(spark, sf), b.items(spark, sf), _nations(spark, sf))


@query
def delete_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Nations and some other keys, asked to be deleted while suppliers refer to some of them."""
    nations = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))
    keys = nations.union(nations.select((F.col("nation") + 20).cast("int")))
    left, statuses = mutations.delete_reference(nations, keys, b.table(spark, sf, "supplier"), "nation", "s_nationkey")
    return statuses.join(left.withColumn("stays", F.lit(True)), "nation", "left").select("nation", "status", F.coalesce("stays", F.lit(False)).alias("stays"))


def _bucketed_items(spark: SparkSession, sf: str) -> store.KeyedTable:
    return store.create_table(b.images(spark, sf)["old_items"], scratch_dir(spark), "item_id", BUCKETS)


@query
def upsert_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The upsert of ``upsert_items`` on a table in buckets."""
    table = _bucketed_items(spark, sf)
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        F.concat(F.lit("FLAG "), "l_returnflag").alias("item_class"),
        F.col("l_linestatus").alias("description"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    changed = lines.groupBy("item_id", "seq").agg(
        F.max("item_class").alias("item_class"), F.max("description").alias("description")
    )
    table.upsert(settled(changed), "seq")
    return table.rows()


@query
def update_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The updates of ``partial_update`` on a table in buckets."""
    table = _bucketed_items(spark, sf)
    table.update(settled(_updates(spark, sf)), "seq")
    return table.rows()


@query
def store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A store of the older image that follows to the newer one, then the documents of all its items."""
    images = {name: settled(df) for name, df in b.images(spark, sf, settled(b.keyed_measures(spark, sf))).items()}
    buckets = max(BUCKETS, store.buckets_for(images["old_measures"]))
    kept = store.create_store(images["old_items"], images["old_measures"], scratch_dir(spark), buckets)
    old, new = differing_rows(images["old_measures"], images["new_measures"], "row_id")
    # Rows that share a leaf with a changed one are left out, so the store is sent the changes alone.
    changed = settled(changes.changed_rows(old, new, "row_id"))
    kept.delete_measures(changed.where("_new IS NULL"))
    kept.upsert_measures(changed.where("_new IS NOT NULL").select("row_id", "_new.*", F.lit(0).alias("seq")), "seq")
    old, new = map(settled, differing_rows(images["old_items"], images["new_items"], "item_id"))
    kept.items.delete(old.join(new.select("item_id"), "item_id", "left_anti"))
    kept.items.upsert(new.withColumn("seq", F.lit(0)), "seq")
    return documents.explode_documents(kept.documents_for(kept.items.rows(), item_class=b.CLASS, mapping=b.MAPPING))


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "events").select(
        F.col("user_id").alias("item_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "click", "CLICKED").when(F.col("event_type") == "view", "VIEWED").alias("item_class"),
        F.when(F.col("value") > 30, F.col("props")).alias("description"),
    )


@query
def partial_update(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.partial_update(b.images(spark, sf)["old_items"], _updates(spark, sf), "item_id", "seq")


@query
def update_status(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.update_status(b.images(spark, sf)["old_items"], _updates(spark, sf), "item_id", "seq")


@query
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Items and measures left when every item of class SMALL is deleted."""
    gone = b.items(spark, sf).where("item_class = 'SMALL'")
    items, measures = mutations.delete_items(b.items(spark, sf), b.measures(spark, sf), gone)
    kept = items.select(F.lit("items").alias("source"), "item_id").unionByName(
        measures.select(F.lit("measures").alias("source"), "item_id")
    )
    return kept.groupBy("source", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query
def delete_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer key is asked to be deleted from the parts."""
    keys = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"))
    return mutations.delete_status(b.images(spark, sf)["old_items"], keys, "item_id")


@query
def delete_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Measures deleted because their row id is missing from the newer image, with their owner."""
    images = b.images(spark, sf)
    keys = images["old_measures"].join(images["new_measures"].select("row_id"), "row_id", "left_anti")
    left, deleted = mutations.delete_measures(images["old_measures"], keys.select("row_id"))
    return deleted.withColumn("outcome", F.lit("deleted")).unionByName(
        left.select("row_id", "item_id", F.lit("left").alias("outcome"))
    )


@query
def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every event becomes a measure row with the next free id, in order of arrival."""
    base = b.keyed_measures(spark, sf)
    batch = b.table(spark, sf, "events").select(
        F.col("user_id").alias("item_id"), F.col("value").alias("amount"), F.col("event_id").alias("seq")
    )
    return mutations.assign_ids(base, batch, "row_id", "seq")


@query
def pk_violations(spark: SparkSession, sf: str) -> DataFrame:
    return constraints.duplicate_keys(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def null_violations(spark: SparkSession, sf: str) -> DataFrame:
    typed = ingest.typed_measures(b.raw_measures(spark, sf))
    return constraints.null_counts(typed, ["row_id", "item_id", "measure_id", "amount"])


@query
def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    images = b.images(spark, sf)
    return constraints.orphan_keys(images["new_measures"], "item_id", images["new_items"], "item_id")


@query
def restrict_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that customers still refer to."""
    keys = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))
    return constraints.restricted_deletes(keys, "nation", b.table(spark, sf, "customer"), "c_nationkey")


# --- documents --------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents.build_documents(b.items(spark, sf), b.measures(spark, sf), b.CLASS, b.MAPPING, order="seq")


@query
def map_measures(spark: SparkSession, sf: str) -> DataFrame:
    return documents.map_measures(b.measures(spark, sf), b.MAPPING, order="seq")


@query
def build_docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents.explode_documents(_documents(spark, sf))


def _image_documents(spark: SparkSession, sf: str, which: str) -> DataFrame:
    images = b.images(spark, sf)
    return documents.build_documents(images[f"{which}_items"], images[f"{which}_measures"], b.CLASS, b.MAPPING)


@query
def docs_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The newer documents over the older ones; documents that should be gone stay."""
    new = _image_documents(spark, sf, "new").withColumn("seq", F.lit(1))
    return documents.explode_documents(documents.upsert_documents(_image_documents(spark, sf, "old"), new, "seq"))


@query
def docs_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """The newer documents written over a target that held the older ones, and read back."""
    target = scratch_dir(spark)
    documents.write_documents(_image_documents(spark, sf, "old"), target)
    documents.write_documents(_image_documents(spark, sf, "new"), target)
    return documents.explode_documents(spark.read.parquet(target))


# --- text and search ----------------------------------------------------------------


@query
def sanitize_queries(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.corpus(spark, sf)
    return docs.select("doc_id", sanitize_query(F.concat(F.lit(" - "), F.col("name"), F.lit(" -"))).alias("query"))


@query
def search_requests(spark: SparkSession, sf: str) -> DataFrame:
    return req.judge_requests(b.conversation_requests(spark, sf))


@query
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    words = indexes.analysed(b.corpus(spark, sf), "doc_id", "name")
    return indexes.posting_rows(words).select(
        "doc_id", "doc_len", "term", F.col("tf").cast("bigint").alias("tf"),
        F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"),
    )


@query
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics alone, so nothing of the index is written."""
    index = indexes.build_index(b.corpus(spark, sf), "doc_id", "name")
    n_docs = index.totals.select("n_docs").scalar()
    return indexes.term_statistics(index).withColumn("n_docs", n_docs)


def _words(requests: DataFrame, sanitize: bool = True) -> DataFrame:
    valid = req.valid_requests(requests)
    text = sanitize_query("query") if sanitize else F.col("query")
    return req.query_tokens(valid.select("query_id", text.alias("text")))


@query
def fuzzy_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the documents close to a word of the benchmark texts, all of them. Nothing else of the index is made."""
    terms = settled(indexes.term_counts(indexes.analysed(b.corpus(spark, sf), "doc_id", "name")))
    words = settled(_words(b.passages(spark, sf)).select("qterm").distinct())
    found = typos.fuzzy_terms(words, terms)
    return found.select("qterm", "term", "edits")


@query
def search_match(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as given, typo-tolerant words only."""
    docs = b.corpus(spark, sf)
    index = indexes.scratch_index(docs, "doc_id", "name")
    return text_search.search(b.passages(spark, sf), index, docs, "match").select("query_id", "rank", "doc_id", "score")


@query
def search_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a whole benchmark text."""
    index = indexes.scratch_index(b.corpus(spark, sf), "doc_id", "name")
    words = settled(_words(b.passages(spark, sf), sanitize=False))
    slots = settled(text_search.phrase_slots(words, index))
    return text_search.phrase_matches(slots, index).select("query_id", "doc_id", "freq")


@query
def search_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Part names found while they are typed."""
    index = indexes.scratch_index(b.names(spark, sf), "doc_id", "name")
    words = settled(_words(b.name_requests(spark, sf, b.TYPED_REQUESTS)))
    slots = settled(text_search.prefix_slots(words, index))
    return text_search.phrase_matches(slots, index).select("query_id", "doc_id", "freq")


@query
def search_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Misspelt part names, all three clauses."""
    docs = b.names(spark, sf)
    index = indexes.scratch_index(docs, "doc_id", "name")
    found = text_search.search(b.name_requests(spark, sf), index, docs)
    return found.select("query_id", "rank", "doc_id", "score", "name")


@query
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts over the long documents, all three clauses."""
    docs = b.corpus(spark, sf)
    index = indexes.scratch_index(docs, "doc_id", "name")
    return text_search.search(b.passages(spark, sf), index, docs).select("query_id", "rank", "doc_id", "score")


def _followed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The older documents, what the feed changed in them, and all of them afterwards."""
    images = b.images(spark, sf, settled(b.keyed_measures(spark, sf)))
    old = settled(documents.build_documents(images["old_items"], images["old_measures"], item_class=b.CLASS, mapping=b.MAPPING))
    actions = settled(changes.last_actions(changes.route_events(changes.parse_events(b.feed(spark, sf)))))
    changed = settled(changes.document_changes(
        actions, images["new_items"], images["new_measures"], item_class=b.CLASS, mapping=b.MAPPING,
    ))
    return old, changed, settled(changes.apply_changes(old, changed).select(F.col("item_id").alias("doc_id"), "name"))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("item_id").alias("doc_id"), "name")


@query
def search_after_events(spark: SparkSession, sf: str) -> DataFrame:
    """Part names searched after the feed: the older documents are indexed, and the index follows the changes."""
    old, changed, docs = _followed(spark, sf)
    index = indexes.scratch_index(_named(old), "doc_id", "name")
    before = old.join(changed.select("item_id"), "item_id", "left_semi")
    index = indexes.updated(index, _named(before), _named(changed.where("NOT deleted")))
    found = text_search.search(b.name_requests(spark, sf, b.TYPED_REQUESTS), index, docs)
    return found.select("query_id", "rank", "doc_id", "score", "name")


@query
def search_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The search of ``search_after_events`` on an index to which the changes were appended in three batches."""
    old, changed, docs = _followed(spark, sf)
    path = scratch_dir(spark)
    indexes.save_index(_named(old), "doc_id", "name", path)
    for batch in range(3):
        part = changed.where(F.pmod(F.xxhash64("item_id"), F.lit(3)) == batch)
        before = old.join(part.select("item_id"), "item_id", "left_semi")
        segments.append_segment(spark, path, batch, _named(before), _named(part.where("NOT deleted")))
    found = text_search.search(b.name_requests(spark, sf, b.TYPED_REQUESTS), segments.load_segments(spark, path), docs)
    return found.select("query_id", "rank", "doc_id", "score", "name")


@query
def shape_results(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of typed part names among the documents, with their measures, a row per measure."""
    docs = settled(_documents(spark, sf)).withColumnRenamed("item_id", "doc_id")
    index = indexes.scratch_index(docs, "doc_id", "name")
    hits = text_search.search(b.name_requests(spark, sf, b.TYPED_REQUESTS), index, docs)
    shaped = documents.shape_hits(hits)
    return shaped.select("query_id", "rank", "name", F.explode_outer("nutrients").alias("m")).select(
        "query_id", "rank", "name", F.col("m.type").alias("type"), F.col("m.amount").alias("amount")
    )


# --- changes ----------------------------------------------------------------------


@query
def derive_events(spark: SparkSession, sf: str) -> DataFrame:
    images = b.images(spark, sf)
    events = changes.table_events(
        images["old_items"], images["new_items"], images["old_measures"], images["new_measures"], b.CLASS
    )
    return changes.with_payload(events).groupBy("table", "op", "item_id", "payload").agg(F.count(F.lit(1)).alias("n"))


@query
def derive_events_by_digests(spark: SparkSession, sf: str) -> DataFrame:
    """The events of ``derive_events``, from the rows whose digests differ between the images."""
    images = b.images(spark, sf)
    events = changes.table_events_by_digests(
        *[settled(images[f"{which}_{table}"]) for table in ("items", "measures") for which in ("old", "new")], b.CLASS
    )
    return changes.with_payload(events).groupBy("table", "op", "item_id", "payload").agg(F.count(F.lit(1)).alias("n"))


@query
def parse_events(spark: SparkSession, sf: str) -> DataFrame:
    return changes.parse_events(b.feed(spark, sf)).select("seq", "table", "op", "item_id", "reject_reason")


@query
def route_events(spark: SparkSession, sf: str) -> DataFrame:
    routed = changes.route_events(changes.parse_events(b.feed(spark, sf)))
    return routed.select("seq", "item_id", "action")


@query
def last_actions(spark: SparkSession, sf: str) -> DataFrame:
    return changes.last_actions(changes.route_events(changes.parse_events(b.feed(spark, sf))))


@query
def event_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every routed event after a batch in which the items whose id is divisible by three failed."""
    routed = changes.route_events(changes.parse_events(b.feed(spark, sf))).withColumn("attempt", F.pmod("seq", F.lit(5)).cast("int"))
    failed = routed.where("item_id % 3 = 0").select("item_id", F.lit("not reachable").alias("error")).distinct()
    return changes.settle_events(routed, failed).select("seq", "item_id", "attempt", "outcome")


@query
def event_outcomes_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """The outcomes of ``event_outcomes`` from a stream with the state of each item."""

    def attempt(item_id: int, action: str) -> str | None:
        return "not reachable" if item_id % 3 == 0 else None

    target = scratch_dir(spark)
    schema = b.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    feed = events.selectExpr("event_id AS seq", f"{b.PAYLOAD} AS payload")
    routed = changes.route_events(changes.parse_events(feed)).withColumn("attempt", F.pmod("seq", F.lit(5)).cast("int"))
    with keyed_state(spark):
        found = event_states(routed, EventState(attempt))
        writer = found.writeStream.format("parquet").option("path", f"{target}/outcomes").option("checkpointLocation", f"{target}/checkpoint")
        read_all(writer.outputMode("append").trigger(availableNow=True).start())
    done = spark.read.schema(found.schema).parquet(f"{target}/outcomes")
    return done.where("NOT retried").select("seq", "item_id", "attempt", "outcome")


def _observed(spark: SparkSession, sf: str) -> Loaded:
    raw = (b.raw_items(spark, sf), b.raw_measures(spark, sf), b.raw_reference(spark, sf))
    return scratch_load(*raw, item_class=b.CLASS, mapping=b.MAPPING)


@query
def observed_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of ``load_counters``, seen while the tables are loaded."""
    return _observed(spark, sf).counters


@query
def observed_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return _observed(spark, sf).funnel


@query
def observed_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.report_lines(_observed(spark, sf).checks).select("source", "line")


@query
def retry_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as one that failed, tried as often before as its value says."""
    attempts = F.floor(F.col("value") / 10).cast("int")
    failed = b.table(spark, sf, "events").select(F.col("event_id").alias("seq"), attempts.alias("attempt"))
    return changes.split_failures(failed)


@query
def apply_events(spark: SparkSession, sf: str) -> DataFrame:
    """The older documents after the feed, read against the newer tables."""
    images = b.images(spark, sf, settled(b.keyed_measures(spark, sf)))
    actions = settled(changes.last_actions(changes.route_events(changes.parse_events(b.feed(spark, sf)))))
    changed = settled(changes.document_changes(
        actions, images["new_items"], images["new_measures"], item_class=b.CLASS, mapping=b.MAPPING,
    ))
    old = documents.build_documents(images["old_items"], images["old_measures"], b.CLASS, b.MAPPING)
    return documents.explode_documents(changes.apply_changes(old, changed))
