"""Packing into sequences of a fixed number of tokens: first-fit decreasing in random groups.

Documents are tokenised and cut at every full sequence; a full piece is a sequence of its own. The
rests are dealt at random into groups of about ``GROUP`` documents, and in each group placed in order
of decreasing length into the first sequence with room, found by descending a tournament tree of the
room left. Only lengths and checksums are moved between machines, never tokens.
"""

from __future__ import annotations

import os
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import raw, row_chunks, settled, table

LENGTH = 2048
END = 1
GROUP = 8192

# A worker keeps the ids of up to twice so many words, and of twice so many heads of words, about 200 bytes each.
KEPT_WORDS = 200_000
KEPT_HEADS = 500_000

# Texts of about so many bytes are split into words at a time, and so many new words are encoded in a row.
CHUNK = 1 << 20
IN_A_ROW = 4096

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, otherwise the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Kept:
    """A dictionary of the last entries: at ``size`` it becomes the older one, from which entries come back as they are asked for."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.new[key] = found
        return found

    def turn(self) -> None:
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new


class Tokens:
    """Ids of whole texts as little-endian 32-bit integers, each blank-separated word encoded once.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its words in a
    row; it also parts letters from marks, so a word of letters with marks after it is its two parts in a row. A head, the
    letters in their normal form, is one word to the tokenizer's model and goes there at once; all else takes the whole way.
    """

    MARKS = "!#$%&()*+,-./:;=?@[]^_`{|}~"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.heads = Kept(KEPT_WORDS), Kept(KEPT_HEADS)
        self.marks: dict[str, bytes] = {"": b""}
        self.letters = _byte_letters()

    def encode(self, words: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(c.ids, "<u4").tobytes() for c in codes]

    @staticmethod
    def head(base: str) -> str | None:
        """The tokenizer's normal form of a run of letters; None where it may be no single word of it."""
        if base.isascii():
            return base.lower() if base.isalpha() else None
        # The tokenizer lowers each letter by itself, Python a final capital sigma by its place.
        if "\u03a3" in base or not base.isalpha():
            return None
        low = unicodedata.normalize("NFC", base).lower()
        return low if low.isalpha() else None

    def encode_head(self, head: str) -> bytes:
        shown = head if head.isascii() else head.encode().decode("latin-1").translate(self.letters)
        return np.asarray([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Makes all of ``words`` known."""
        known, get, marks = self.words.new, self.heads.get, self.marks
        plain = []
        for w in words:
            if self.words.get(w) is not None:
                continue
            base = w.rstrip(self.MARKS)
            head = self.head(base)
            if head is None:
                plain.append(w)
                continue
            ids = get(head)
            if ids is None:
                ids = self.heads.new[head] = self.encode_head(head)
            tail = w[len(base) :]
            if tail not in marks:
                if len(marks) > IN_A_ROW:
                    marks = self.marks = {"": b""}
                marks[tail] = self.encode([tail])[0]
            known[w] = ids + marks[tail]
        for i in range(0, len(plain), IN_A_ROW):
            some = plain[i : i + IN_A_ROW]
            known.update(zip(some, self.encode(some), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.words.turn()
        self.heads.turn()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        distinct = set().union(*split)
        self.learn(distinct.difference(self.words.new))
        get = self.words.new.__getitem__
        return [b"".join(map(get, words)) for words in split]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One tokenizer and its known words for a worker process."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


class Room:
    """A tournament tree over the room left in each of ``n`` bins; a node holds the larger of its two."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with room, and takes that room."""
        node, best = 1, self.best
        while node < self.leaves:
            node *= 2
            if best[node] < need:
                node += 1
        found = node - self.leaves
        best[node] -= need
        node //= 2
        while node:
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
            node //= 2
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length; equal lengths go in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, used = Room(len(lengths), capacity), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        b = room.first(int(lengths[i]))
        bins[i], offsets[i] = b, used[b]
        used[b] += lengths[i]
    return bins, offsets


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """A row for each full piece and each rest of a document. A null text is an empty one: its end alone."""
    end = np.array([END], "<u4").tobytes()

    def go(batches):
        encode = tokens(path)
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            _, at = raw(batch.column(1))
            for lo, hi in row_chunks(at, CHUNK):
                out = [[] for _ in names]
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                for doc_id, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        part = ids[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(go, PIECES)


def packed(docs: DataFrame, path: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    Sequences with rests have odd ids, full pieces even ones. A repeated row is packed as often as it
    is there; a null doc_id is a document like others; no documents give no rows.
    """
    cut = settled(pieces(docs, path, length))
    rests = cut.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // group))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        number = int(frame["_group"].iloc[0])
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), length)
        return frame.drop(columns="_group").assign(sequence_id=2 * ((number << 32) + bins) + 1, offset=offsets)

    dealt = rests.withColumn("_group", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(groups)))
    full = cut.where(F.col("length") == length).select(
        "*", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(dealt.groupBy("_group").applyInPandas(place, f"{PIECES}, sequence_id bigint, offset bigint"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
