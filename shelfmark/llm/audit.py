"""Filter interaction audit: what every order of a set of filters removes, from one lattice of states.

A state is the set of filters applied so far, an edge applies one more. What an edge removes depends on the
state alone, not on the order in which it was reached, so all orders are read from the edges of one lattice. The number
of orders through an edge is the number of ways to reach its state (counted forward from the empty state) times the
number of ways to leave the next one (counted backward from the full state); with these weights the edges of a filter add up to
its Shapley value times the number of orders.

The documents are read once, into a bit for each filter that a document fails, and counted by part and bits; the
lattice is worked out on those counts, at most 2**n rows for each part.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import settled, table
from shelfmark.operators.skew import with_membership

NAMES = "ABCDE"

#: Fixed: runs of anything but blanks, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = r"[#$%&*|]"


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """(orders that reach each state from the empty one, orders that leave it to the full one)."""
    states = 1 << n
    reach, leave = [0] * states, [0] * states
    reach[0] = leave[states - 1] = 1
    for s in range(states):
        for f in range(n):
            if not s >> f & 1:
                reach[s | 1 << f] += reach[s]
    for s in reversed(range(states)):
        for f in range(n):
            if not s >> f & 1:
                leave[s] += leave[s | 1 << f]
    return reach, leave


def failures(text: Column) -> list[Column]:
    """Whether a text fails each of the filters that look at the text alone; the words are split once."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, upper = F.size(words).cast("long"), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PERCENT * n,
        100 * upper.cast("long") > UPPER_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, a row per part and set of filters.

    Bit i of ``mask`` is filter i of ``NAMES``; the last is that the text is identical to that of a smaller doc_id. A null
    doc_id comes after all others, so such a row is a copy only of rows that have one, and rows that share a doc_id are not copies of
    each other. A null text is an empty one and a null language the empty string. A document is good or
    toxic where any of its labels says so; labels without doc_id count for none.

    Equal texts fail the same other filters, so copies need no join of their own: of each text the rows of the smallest doc_id
    are found by an aggregate and taken off the count of all. A text that a third of the rows hold leaves each task once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [fails.cast("int") * (1 << i) for i, fails in enumerate(failures(text))]
    base = bits[0]
    for bit in bits[1:]:
        base = base.bitwiseOR(bit)
    rows = settled(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("hash"),
        base.alias("base"),
    ))
    for flag, column in (("good", "quality"), ("toxic", "toxic")):
        rows = with_membership(rows, labels.where(F.col(column) == 1).select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", flag)
    kinds = ["part", "base", "good", "toxic"]
    by_id = settled(rows.groupBy("hash", "doc_id", *kinds).agg(F.count(F.lit(1)).alias("n")))
    first = by_id.groupBy(F.col("hash").alias("h")).agg(F.min("doc_id").alias("first"))
    originals = by_id.join(first, (F.col("hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("first")))
    copy = 1 << len(bits)
    moved = F.explode(F.array(
        F.struct(F.col("base").alias("mask"), F.col("n").alias("n")),
        F.struct((F.col("base") + copy).alias("mask"), (-F.col("n")).alias("n")),
    ))
    all_ = by_id.select(*kinds, F.struct((F.col("base") + copy).alias("mask"), F.col("n").alias("n")).alias("x"))
    both = all_.unionByName(originals.select(*kinds, moved.alias("x")))
    count = lambda of: F.sum(F.when(of, F.col("x.n")).otherwise(0)).cast("long")
    cells = both.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").cast("long").alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic")
    )
    return cells.where("n > 0")


def _constants(rows: list[dict], schema: str) -> Column:
    """A row for each of a fixed list."""
    return F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))


def edges(cells: DataFrame, n: int) -> DataFrame:
    """(part, state, filter, orders, kept, removed, redundant, good_lost, toxic_lost, unique_fails, shapley), a row per edge.

    ``cells`` is what ``judged`` returns for ``n`` filters. ``orders`` is the number of orders through the edge, ``shapley`` the sum over all
    orders of what the filter removes.
    """
    reach, leave = path_counts(n)
    states = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    listed = [{"state": s, "filter": f, "orders": reach[s] * leave[s | 1 << f]} for s, f in states]
    rows = cells.select("*", _constants(listed, "state:int,filter:int,orders:bigint"))
    bit = F.expr("shiftleft(1, filter)")
    fails, before = (F.col("mask").bitwiseAND(bit) != 0), (F.col("mask").bitwiseAND(F.col("state")) != 0)
    of = lambda which, what: F.sum(F.when(which, F.col(what)).otherwise(0)).cast("long")
    counted = rows.groupBy("part", "state", "filter", "orders").agg(
        of(~fails & ~before, "n").alias("kept"),
        of(fails & ~before, "n").alias("removed"),
        of(fails & before, "n").alias("redundant"),
        of(fails & ~before, "good").alias("good_lost"),
        of(fails & ~before, "toxic").alias("toxic_lost"),
    )
    whole = Window.partitionBy("part", "filter")
    last = F.col("state") == F.lit((1 << n) - 1) - bit
    return counted.select(
        "*",
        F.max(F.when(last, F.col("removed"))).over(whole).alias("unique_fails"),
        F.sum(F.col("orders") * F.col("removed")).over(whole).alias("shapley"),
    )


def steps(found: DataFrame, names: str) -> DataFrame:
    """A row for each part, order and step: the edge taken there. ``found`` is what ``edges`` returns; n! orders are listed."""
    taken = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            taken.append({"filter_order": "".join(names[i] for i in order), "step": step, "state": state, "filter": f})
            state |= 1 << f
    spark = found.sparkSession
    listed = spark.range(1).select(_constants(taken, "filter_order:string,step:int,state:int,filter:int"))
    return found.join(F.broadcast(listed), ["state", "filter"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Every order of the five filters over every part, zeros included; see ``judged`` for odd rows. No documents give no rows.
    """
    found = settled(edges(settled(judged(docs, labels)), len(NAMES)))
    return steps(found, NAMES).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same from the definition: every order is applied to the documents, counted by the filters they fail.
OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
failed AS (
  SELECT d.part,
    [len(w) < 100,
     100 * len(list_distinct(w)) < 80 * len(w),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
     regexp_matches(text, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text) IS NOT NULL)] AS fails,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM cut d),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS seq, list_aggregate(list_transform([a.i, b.i, c.i, d.i, e.i], lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
walked AS (
  SELECT part, filter_order, step, seq[step] AS f, n, good, toxic, fails[seq[step]] AS here,
    list_bool_or(list_transform(seq[1:step - 1], lambda x: fails[x])) IS TRUE AS before,
    len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM cells, orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT here AND NOT before), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (here AND NOT before), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (here AND before), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (here AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT before), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (here AND NOT before), 0)::BIGINT AS toxic_lost
  FROM walked GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM counted
"""
