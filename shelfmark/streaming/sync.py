"""Documents kept current from the change feed.

Every micro-batch writes what it changed into its own folder of a log; a batch that is
run again overwrites that folder, so events may arrive more than once. Readers take the
last entry of each document.

Layout below the target folder::

    base/                  documents of the last full build or compaction
    log/batch_id=N/        item_id, name, nutrients, deleted
    rejects/batch_id=N/    payloads that are not events, with the reason
    retry/batch_id=N/      events whose item failed, with attempt, outcome and the time from which they are due

An item that fails does not take its batch with it: the batch is halved by a hash of the item until
the failing items are alone. If the tables cannot be read at all, every event of the batch waits.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from shelfmark.fixed import MAX_RETRIES, RETRY_INTERVAL
from shelfmark.operators.changes import (
    changes_by,
    document_changes,
    last_actions,
    parse_events,
    route_events,
    settle_events,
)
from shelfmark.operators.documents import write_documents
from shelfmark.operators.index import SearchIndex, updated
from shelfmark.operators.skew import latest
from shelfmark.operators.store import CatalogueStore
from shelfmark.schemas import DOCUMENTS
from shelfmark.session import settled

LOG = StructType([*DOCUMENTS.fields, StructField("deleted", BooleanType())])
REJECTS = "seq BIGINT, payload STRING, reject_reason STRING"
RETRY = "seq BIGINT, payload STRING, attempt INT, error STRING, outcome STRING, due DOUBLE"

Tables = Callable[[SparkSession], tuple[DataFrame, DataFrame] | CatalogueStore]


@dataclass
class DocumentSync:
    """``tables`` returns the current (items, measures), or the store that keeps them; it is asked once per micro-batch.

    Of a store a micro-batch reads the buckets of its items alone.
    """

    target: str
    tables: Tables
    options: dict = field(default_factory=dict)
    max_retries: int = MAX_RETRIES
    retry_interval: float = RETRY_INTERVAL
    clock: Callable[[], float] = time.time

    def rebuild(self, documents: DataFrame) -> None:
        """Start from a full build."""
        write_documents(documents, f"{self.target}/base")

    def start(self, feed: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """Follow the feed every ``interval``; without one, read what is there and stop.

        With an interval a timer beside the feed starts batches while it is quiet, so events that wait come due.
        """
        if interval:
            ticks = feed.sparkSession.readStream.format("rate").load().where("value < 0")
            feed = feed.select("seq", "payload").unionByName(
                ticks.select(F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("payload"))
            )
        writer = feed.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint)
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return writer.trigger(**trigger).start()

    def handle(self, events: DataFrame, batch_id: int) -> None:
        """One micro-batch: new events and those due again, against one reading of the tables."""
        spark = events.sparkSession
        # Read once: rejects, changes and outcomes start from the parsed events.
        parsed = settled(parse_events(events.select("seq", "payload")))
        parsed.where("reject_reason IS NOT NULL").select("seq", "payload", "reject_reason").write.mode(
            "overwrite"
        ).parquet(f"{self.target}/rejects/batch_id={batch_id}")

        now = self.clock()
        waiting = self._waiting(spark, batch_id)
        fresh = route_events(parsed).select("seq", "payload", "item_id", "action", F.lit(0).alias("attempt"))
        # An event tried again is always a refresh: a deleted item is gone from the tables,
        # and an item that came back since must not be deleted by the older event.
        again = route_events(parse_events(waiting.where(F.col("due") <= now).select("seq", "payload", "attempt"))).select(
            "seq", "payload", "item_id", F.lit("refresh").alias("action"), "attempt"
        )
        routed = settled(fresh.unionByName(again))
        log = f"{self.target}/log/batch_id={batch_id}"
        spark.createDataFrame([], LOG).write.mode("overwrite").parquet(log)
        failed = self._apply(spark, settled(last_actions(routed)), log)
        outcomes = settle_events(routed, failed, self.max_retries).where("outcome <> 'done'")
        later = outcomes.withColumn("due", F.lit(now + self.retry_interval)).select("seq", "payload", "attempt", "error", "outcome", "due")
        kept = waiting.where(F.col("due") > now)
        later.unionByName(kept).write.mode("overwrite").parquet(f"{self.target}/retry/batch_id={batch_id}")

    def _apply(self, spark: SparkSession, actions: DataFrame, log: str) -> DataFrame:
        """Writes the documents of ``actions`` to ``log``; (item_id, error) of the items that failed."""
        failures = spark.createDataFrame([], "item_id BIGINT, error STRING")
        if actions.isEmpty():
            return failures
        try:
            current = self.tables(spark)
        except Exception as error:  # noqa: BLE001 - whatever failed, its events are kept for another try
            return actions.select("item_id", F.lit(str(error)).alias("error"))

        def changed(mine: DataFrame) -> DataFrame:
            if isinstance(current, CatalogueStore):
                return changes_by(mine, lambda ids: current.documents_for(ids, **self.options))
            return document_changes(mine, *current, **self.options)

        parts = [(1, 0)]
        while parts:
            modulus, rest = parts.pop()
            mine = actions.where(F.pmod(F.xxhash64("item_id"), F.lit(modulus)) == rest)
            if modulus > 1 and mine.isEmpty():
                continue
            try:
                changes = settled(changed(mine).select(*LOG.names))
            except Exception as error:  # noqa: BLE001
                if modulus >= 1 << 40 or len(mine.limit(2).collect()) == 1:
                    failures = failures.union(mine.select("item_id", F.lit(str(error)).alias("error")))
                else:
                    parts += [(2 * modulus, rest), (2 * modulus, rest + modulus)]
                continue
            changes.write.mode("append").parquet(log)
        return settled(failures)

    def retry_pending(self, spark: SparkSession, batch_id: int) -> None:
        """A micro-batch without new events, for events that wait while the feed is quiet."""
        self.handle(spark.createDataFrame([], "seq BIGINT, payload STRING"), batch_id)

    def current(self, spark: SparkSession) -> DataFrame:
        """(item_id, name, nutrients): the base and the log, last entry per document."""
        base = _read(spark, f"{self.target}/base", DOCUMENTS)
        log = _read(spark, f"{self.target}/log", StructType([*LOG.fields]).add("batch_id", LongType()))
        last = latest(log, "item_id", "batch_id")
        untouched = base.join(last.select("item_id"), "item_id", "left_anti")
        return untouched.unionByName(last.where("NOT deleted").select(*DOCUMENTS.names))

    def rejects(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.target}/rejects", _with_batch(spark, REJECTS))

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.target}/retry", _with_batch(spark, RETRY)).where("outcome = 'dead'")

    def compact(self, spark: SparkSession, path: str) -> None:
        """Write the current documents to ``path``, to be the base of a fresh target."""
        write_documents(self.current(spark), path)

    def index(self, spark: SparkSession, base: SearchIndex) -> SearchIndex:
        """The search index of the current documents, from one of the base; only changed documents are split into words."""
        log = _read(spark, f"{self.target}/log", StructType([*LOG.fields]).add("batch_id", LongType()))
        last = settled(latest(log, "item_id", "batch_id"))
        old = _read(spark, f"{self.target}/base", DOCUMENTS).join(last.select("item_id"), "item_id", "left_semi")
        new = last.where("NOT deleted")
        return updated(base, *[df.select(F.col("item_id").alias("doc_id"), "name") for df in (old, new)])

    def _waiting(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Events the batch before this one left for another try, due or not; it took over those of earlier ones."""
        before = _read(spark, f"{self.target}/retry/batch_id={batch_id - 1}", spark.createDataFrame([], RETRY).schema)
        return before.where("outcome = 'retry'")


def _with_batch(spark: SparkSession, schema: str) -> StructType:
    return spark.createDataFrame([], schema).schema.add("batch_id", LongType())


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
