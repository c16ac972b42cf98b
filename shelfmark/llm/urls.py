"""URL rules looked up in Bloom filter cascades.

A rule is a host and a path prefix; its key is the two in a row, such as ``example.org/es/``. The keys
that could be a rule for a URL are known: each suffix of its host with each prefix of its path that is
as long as some rule's path. A cascade tells listed keys from all other keys of the corpus without
error: level 0 holds the listed keys, level 1 the corpus's other keys that level 0 passes by mistake,
level 2 the listed keys that level 1 passes, and so on until a level makes no mistake on that universe.
Judging a page is a few bit tests; nothing is joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import mixed, settled, table

# Bits for each key of a level and tests for each key: about 2 % of other keys pass.
BITS = 8
TESTS = 5

# The largest filter sent to executors, in bits. More listed keys are split by hash into slices,
# each a cascade of its own and a pass of its own in the same stage.
MOST_BITS = 1 << 28

# A level leaves a fiftieth of the keys of the one before the last.
MOST_LEVELS = 64

# Up to so many different lengths of rule paths are looked at by name; beyond them a URL's path is cut at every length, which finds the same rules.
NAMED_PATH_LENGTHS = 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path; both empty for null and where ``://`` is missing."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, r"^[^?#]*", 0)


def keys(host: Column, path: Column, lengths: list[int] | None) -> Column:
    """The keys that could be a rule, the longest first, of equal ones that of the longer host; without ``lengths`` for paths of any length.

    A URL has as many keys as its host has parts times the lengths that its path reaches.
    """
    parts = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."),
    )
    if lengths is None:
        paths = F.sequence(F.lit(0), F.length(path))
    else:
        paths = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    pairs = F.flatten(
        F.transform(hosts, lambda h: F.transform(paths, lambda n: F.struct(
            (F.length(h) + n).alias("size"), F.length(h).alias("host"), F.concat(h, F.substring(path, F.lit(1), n)).alias("key")
        )))
    )
    ordered = F.transform(F.sort_array(pairs, asc=False), lambda p: p["key"])
    return F.when(host == "", F.array().cast("array<string>")).otherwise(ordered)


def hashes(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b"))


def bits_of(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """(tests, keys): the places of each key in a level."""
    salt = np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x, y = mixed(a.view(np.uint64) + salt), mixed(b.view(np.uint64) + salt) | np.uint64(1)
    return np.stack([(x + np.uint64(i) * y) % np.uint64(size) for i in range(TESTS)]).astype(np.int64)


def passing(words: np.ndarray, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    at = bits_of(a, b, level, len(words) * 64)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)


def listed(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys the cascade lists: the first level that a key fails tells its side."""
    answer, left = np.full(len(a), len(levels) % 2 == 1), np.arange(len(a))
    for i, words in enumerate(levels):
        passed = passing(words, a[left], b[left], i)
        answer[left[~passed]] = i % 2 == 1
        left = left[passed]
    return answer


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))


def _level(rows: DataFrame, level: int, n: int) -> np.ndarray:
    """A filter over (a, b) rows: places found in tasks, combined by word, gathered as at most MOST_BITS bits."""
    words = max(1, -(-n * BITS // 64))

    def go(batches):
        for batch in batches:
            at = np.unique(bits_of(*_columns(batch), level, words * 64))
            one = np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(one.view(np.int64))], names=["word", "bits"])

    out = np.zeros(words, np.uint64)
    found = rows.mapInArrow(go, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _through(rows: DataFrame, words: np.ndarray, level: int) -> DataFrame:
    """The (a, b) rows that pass a level."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def go(batches):
        for batch in batches:
            yield batch.filter(pa.array(passing(shared.value, *_columns(batch), level)))

    return rows.mapInArrow(go, "a bigint, b bigint")


def cascade(keys_: DataFrame, universe: DataFrame) -> list[np.ndarray]:
    """The levels for the keys ``keys_`` among those of ``universe``, both rows of (a, b).

    The universe is read once, through level 0; what passes is made distinct and the listed keys are
    taken out. All further levels are built from that. Keys need not be in the universe.
    """
    known = settled(keys_.distinct())
    n = known.count()
    if not n:
        return []
    levels = [_level(known, 0, n)]
    mistaken = _through(universe, levels[0], 0).distinct().join(known, ["a", "b"], "left_anti")
    now, other = settled(mistaken), known
    while n := now.count():
        if len(levels) == MOST_LEVELS:
            raise ValueError("listed and other keys share their 128-bit hashes")
        levels.append(_level(now, len(levels), n))
        now, other = settled(_through(other, levels[-1], len(levels) - 1)), now
    return levels


def _judged(rows: DataFrame, shared, verdict: str, part: int, parts: int) -> DataFrame:
    """Looks up the keys of a slice: ``best`` becomes the first listed place where that is earlier."""

    def go(batches):
        for batch in batches:
            lists = batch.column("hashes")
            flat, at = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            a, b = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            hit = np.flatnonzero(listed(shared.value, a, b) & (b % parts == part))
            best = batch.column("best").to_numpy(zero_copy_only=False).copy()
            names = batch.column("verdict").to_pylist()
            for r, place in zip(row[hit].tolist(), (hit - at[row[hit]]).tolist(), strict=True):
                if best[r] < 0 or place < best[r]:
                    best[r], names[r] = place, verdict
            new = {"best": pa.array(best, pa.int32()), "verdict": pa.array(names, pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(go, rows.schema)


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """(row, host, path, rule, verdict): the longest rule that fits each URL, and what it says.

    ``rules`` are rows of (host, path, verdict), the verdict ``allow`` or ``block``; a rule fits its
    host and all subdomains if the path starts with its path. Of rules with equal keys' lengths the
    one with the longer host wins; a rule listed both ways blocks. Where no key is listed the rule
    is null and the verdict ``otherwise``. ``row`` holds all columns of the page. A null URL or one
    without ``://`` has an empty host, which no rule fits. Rules without a host are passed over.
    """
    spark = pages.sparkSession
    rules = settled(rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''"))
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").limit(NAMED_PATH_LENGTHS + 1).collect()]
    if len(lengths) > NAMED_PATH_LENGTHS:
        lengths = None
    host, path = host_path(F.col(url))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    found = keys(F.col("host"), F.col("path"), lengths)
    universe = rows.select(F.explode(found).alias("key")).select(hashes(F.col("key")).alias("h")).select("h.*")
    total = rules.count()
    parts = max(1, -(-total * BITS // MOST_BITS))
    out = rows.withColumn("hashes", F.transform(found, hashes)).withColumn("best", F.lit(-1)).withColumn("verdict", F.lit(None).cast("string"))
    blocked = rules.where("verdict = 'block'").select("host", "path")
    kinds = {"block": blocked, "allow": rules.where("verdict = 'allow'").select("host", "path").exceptAll(blocked)}
    for verdict, own in kinds.items():
        ab = own.select(hashes(F.concat("host", "path")).alias("h")).select("h.*")
        for part in range(parts):
            mine = lambda df, p=part: df.where(F.pmod("b", F.lit(parts)) == p)
            shared = spark.sparkContext.broadcast(cascade(mine(ab), mine(universe)))
            out = _judged(out, shared, verdict, part, parts)
    rule = F.when(F.col("best") >= 0, F.element_at(keys(F.col("host"), F.col("path"), lengths), F.col("best") + 1))
    return out.select("row", "host", "path", rule.alias("rule"), F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


#: Fixed: the rules of the query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    values = ", ".join("('{}', '{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in r)) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, rules_of(spark, RULES)).select("row.page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
named AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM named, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT n.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM named n LEFT JOIN fits f ON f.page_id = n.page_id AND k = 1
"""
