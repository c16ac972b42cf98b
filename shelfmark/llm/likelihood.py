"""Subword lattice likelihood: the probability of a text over all its segmentations into known pieces.

The pieces are those of an existing vocabulary, and the single bytes, so any text has a segmentation. Each piece
has a probability of its own, and a text is its words, each begun by the vocabulary's word mark, and an
end. No piece goes over a word's begin, so the probability of a text is the product of those of its words, and
that of a word is summed over all paths of its lattice by a forward recursion on logarithms.

The scores that come with the vocabulary are ranks; they give the first weights (as 1 / rank), which ``ROUNDS``
of expectation and maximisation over all training words then fit. Words are counted by blocks of documents, and
each distinct word is scored once; a block gets back just its own words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import byte_values, mixed, powers, settled, table

ROUNDS = 2
SMOOTHING = 0.1
MARK = "▁".encode()

# A block holds documents of about so many bytes; a task holds one block and the words in it.
BLOCK_BYTES = 16 << 20

# Words scored at a time, and the most bytes of lattice rows held for them.
AT_ONCE = 100_000
CELLS = 1 << 19

_BASE = 0xD1342543DE82EF95


@dataclass
class Pieces:
    """Pieces as hashes in order, with their lengths and natural log probabilities; the last is the end's."""

    keys: np.ndarray
    lengths: np.ndarray
    logp: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.sizes = np.unique(self.lengths)

    def edges(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For words of one length (rows of bytes): (length, row, begin, piece) of every piece in them."""
        m, n = words.shape
        values = byte_values(fold=False, seed=11)[words] * powers(_BASE, n)
        sums = np.zeros((m, n + 1), np.uint64)
        np.cumsum(values, axis=1, out=sums[:, 1:])
        inverse = powers(pow(_BASE, -1, 1 << 64), n)
        for size in self.sizes[self.sizes <= n].tolist():
            h = mixed((sums[:, size:] - sums[:, : n + 1 - size]) * inverse[: n + 1 - size] + np.uint64(size))
            row, begin = np.nonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
            found = h[row, begin]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[at] == found
            yield size, row[hit], begin[hit], at[hit]

    def lattice(self, words: np.ndarray) -> tuple[np.ndarray, list]:
        """(rows, length + 1) log probability of reaching each place, and the edges."""
        m, n = words.shape
        steps = [(size, np.full((m, n), -np.inf), row, begin, piece) for size, row, begin, piece in self.edges(words)]
        for _, weight, row, begin, piece in steps:
            weight[row, begin] = self.logp[piece]
        reach = np.full((m, n + 1), -np.inf)
        reach[:, 0] = 0
        for j in range(1, n + 1):
            ways = [reach[:, j - size] + weight[:, j - size] for size, weight, *_ in steps if size <= j]
            reach[:, j] = np.logaddexp.reduce(ways) if len(ways) > 1 else ways[0]
        return reach, steps

    def expected(self, words: np.ndarray, count: np.ndarray, out: np.ndarray) -> None:
        """Adds to ``out`` how often each piece is expected in the words, each there ``count`` times."""
        reach, steps = self.lattice(words)
        m, n = words.shape
        back = np.full((m, n + 1), -np.inf)
        back[:, n] = 0
        for i in range(n - 1, -1, -1):
            ways = [back[:, i + size] + weight[:, i] for size, weight, *_ in steps if i + size <= n]
            back[:, i] = np.logaddexp.reduce(ways) if len(ways) > 1 else ways[0]
        for size, _, row, begin, piece in steps:
            share = np.exp(reach[row, begin] + self.logp[piece] + back[row, begin + size] - reach[row, n])
            out += np.bincount(piece, weights=share * count[row], minlength=len(out))


def piece_hash(piece: bytes) -> int:
    data = np.frombuffer(piece, np.uint8)
    total = (byte_values(fold=False, seed=11)[data] * powers(_BASE, len(data))).sum(dtype=np.uint64)
    return int(mixed(np.array([total]) + np.uint64(len(data)))[0])


def vocabulary(path: str) -> Pieces:
    """The text pieces of a sentencepiece model that lower-cased words can hold, all bytes, and the end."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 1e-7 for b in range(256)}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).encode()
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or MARK in piece[1:] or piece != piece.lower():
            continue
        weight[piece] = 1 / (10 + max(0.0, min(1e6, -model.get_score(i))))
    order = sorted(weight, key=piece_hash)
    p = np.array([weight[x] for x in order] + [1 / 500])
    return Pieces(np.array([piece_hash(x) for x in order], np.uint64), np.array([len(x) for x in order]), np.log(p / p.sum()))


def same_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes with the mark before them) of the words, those of one length at a time."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        n = int(sizes[order[lo]]) + len(MARK)
        step = max(1, CELLS // n)
        for a in range(lo, hi, step):
            some = order[a : min(a + step, hi)]
            flat = np.frombuffer(b"".join(MARK + words[i] for i in some.tolist()), np.uint8)
            yield some, flat.reshape(len(some), n)


def _gathered(batches) -> Iterator[pa.Table]:
    """Tables of about AT_ONCE rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks, tabs and line ends, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def in_training(doc_id: Column, modulus: int = 7, held: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus != held


def block_of(blocks: int) -> Column:
    """The block of a row, by doc_id and text: rows that share a doc_id, or have none, are spread by their texts."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))


def fitted(counts: DataFrame, pieces: Pieces, ends: int) -> Pieces:
    """Probabilities from the pieces expected in all training words, (word, c). A fixed number of sums is gathered."""
    for _ in range(ROUNDS):
        shared = counts.sparkSession.sparkContext.broadcast(pieces)

        def expect(batches):
            total = np.zeros(len(shared.value.keys))
            for part in _gathered(batches):
                words, c = part.column(0).to_pylist(), part.column(1).to_numpy().astype(float)
                for places, rows in same_length(words):
                    shared.value.expected(rows, c[places], total)
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["piece", "n"])

        sums = counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(len(pieces.keys) + 1, SMOOTHING)
        np.add.at(n, sums["piece"].to_numpy(np.int64), sums["n"].to_numpy())
        n[-1] += ends
        pieces = Pieces(pieces.keys, pieces.lengths, np.log(n / n.sum()))
    return pieces


def scored(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    A null text is an empty one: its end alone. ``base_score`` is that of single words with one added to each count,
    ``score`` the lattice's; both are log10. A repeated row counts and is scored each time; a null doc_id is
    a text of its own. Without training rows all counts are zero and the first weights score.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = in_training(F.col("doc_id"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(training.cast("long")).alias("ends")).first()
    ends, blocks = size["ends"] or 0, max(1, -(-(size["bytes"] or 0) // BLOCK_BYTES))
    dealt = docs.withColumn("block", block_of(blocks)).withColumn("training", training)

    def count(key, part):
        learnt, other = Counter(), set()
        for chunk in part.to_batches(max_chunksize=256):
            for text, own in zip(chunk.column("text").to_pylist(), chunk.column("training").to_pylist(), strict=True):
                (learnt if own else other).update(words_of(text))
        words = list(learnt) + list(other.difference(learnt))
        c = np.zeros(len(words), np.int64)
        c[: len(learnt)] = list(learnt.values())
        return pa.table({"block": pa.array(np.full(len(words), key[0].as_py())), "word": pa.array(words, pa.binary()), "c": pa.array(c)})

    rows = settled(dealt.select("block", "training", "text").groupBy("block").applyInArrow(count, "block bigint, word binary, c bigint"))
    counts = settled(rows.groupBy("word").agg(F.sum("c").alias("c")))
    total = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = (total["n"] or 0) + ends, (total["v"] or 0) + (ends > 0)
    model = fitted(counts, pieces, ends) if n else pieces
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches):
        for part in _gathered(batches):
            words = part.column(0).to_pylist()
            out = np.zeros(len(words))
            for places, data in same_length(words):
                out[places] = shared.value.lattice(data)[0][:, -1]
            yield from part.append_column("logp", pa.array(out)).to_batches()

    weighed = counts.mapInArrow(weigh, "word binary, c bigint, logp double")
    replies = rows.select("block", "word").join(weighed, "word").select("block", "word", "c", "logp")
    floor, end_logp = np.log10(n + v + 1) if n else 0.0, float(model.logp[-1])

    def finish(key, part, known):
        out = [[] for _ in range(5)]
        c, logp = known.column("c").to_numpy(), known.column("logp").to_numpy()
        base = np.log10(c + 1) - floor
        at = dict(zip(known.column("word").to_pylist(), range(len(c)), strict=True))
        for chunk in part.to_batches(max_chunksize=256):
            for doc_id, text in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist(), strict=True):
                places = np.fromiter(map(at.__getitem__, words_of(text)), np.int64)
                row = (
                    doc_id,
                    len(places) + 1,
                    int((c[places] > 0).sum()) + (ends > 0),
                    float(base[places].sum() + np.log10(ends + 1) - floor),
                    float((logp[places].sum() + end_logp) / np.log(10)),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        return pa.table([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=names)

    schema = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    done = dealt.select("block", "doc_id", "text").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)
    return done.select(
        "doc_id", (~training).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def pieces_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), vocabulary(pieces_path()))
