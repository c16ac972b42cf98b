"""Steps of text search that work on whole columns of numbers, where rows would be many times those that come in or go out.

Each gets batches of a task's rows and gives batches; what it holds is bounded by its constants and not by the rows of the task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from shelfmark.fixed import MAX_SIZE

# Rows of documents that are added up at once, about; a document's rows are never parted.
CHUNK_ROWS = 500_000

# Pairs of a request and a document, and products of a row with its requests, held at once.
CHUNK_PAIRS = 1 << 22
CHUNK_PRODUCTS = 1 << 20

# Scores are ranked after rounding to six places; so much less may still be equal.
TIE = 2e-6


def best_of_documents(rows: DataFrame, lists: pa.Table, sizes: np.ndarray) -> DataFrame:
    """(_q, doc_id, score), summed, of the pairs that may be among the ``sizes[_q]`` best of request ``_q``, with ties.

    ``rows`` (doc_id, _t, _q, value) come sorted by doc_id, all rows of a document in one task. A row with ``_q`` adds
    ``value`` to that request, one with ``_t`` adds ``value`` times the weight to each request in the list of ``_t``
    in ``lists`` (_t, list of (_q, w)). Pairs that no row names are not given.
    """
    order = np.argsort(lists.column("_t").to_numpy(), kind="stable")
    column = lists.column("list").combine_chunks().take(pa.array(order))
    flat = column.flatten()
    ids = lists.column("_t").to_numpy()[order]
    starts = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy()))).astype(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(
        (ids, starts, flat.field("_q").to_numpy().astype(np.int32), flat.field("w").to_numpy(), np.minimum(sizes, MAX_SIZE))
    )

    def go(batches):
        table = _Added(*shared.value)
        for chunk in _whole_documents(batches):
            yield from table.best(chunk)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "_t", "_q", "value").mapInArrow(go, f"_q int, doc_id {kind}, score double")


def _whole_documents(batches) -> Iterator[pa.Table]:
    """Tables of about CHUNK_ROWS rows with all rows of their documents, which come one after another."""
    held, n = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += len(batch)
        if n < CHUNK_ROWS:
            continue
        now = pa.concat_tables(held)
        code = _codes(now.column(0))
        cut = int(np.searchsorted(code, code[-1]))
        if cut:
            yield now.slice(0, cut)
        held, n = [now.slice(cut)], len(now) - cut
    if n:
        yield pa.concat_tables(held)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each row, the same for equal values (null is one), upwards from 0 as they first come."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


class _Added:
    """The scores of documents, a table of documents and requests."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, requests: np.ndarray, weights: np.ndarray, sizes: np.ndarray):
        self.ids, self.starts, self.requests, self.weights, self.sizes = ids, starts, requests, weights, sizes

    def best(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        code = _codes(rows.column(0))
        value = rows.column(3).to_numpy()
        own = rows.column(2).combine_chunks()
        direct = own.is_valid().to_numpy(zero_copy_only=False)
        request = own.fill_null(0).to_numpy()
        term = np.searchsorted(self.ids, rows.column(1).combine_chunks().fill_null(0).to_numpy())
        each = max(1, CHUNK_PAIRS // max(1, len(self.sizes)))
        for first in range(0, int(code[-1]) + 1, each):
            lo, hi = np.searchsorted(code, [first, first + each])
            some = slice(int(lo), int(hi))
            n = int(code[hi - 1]) - first + 1
            score, met = self._table(n, code[some] - first, value[some], direct[some], request[some], term[some])
            doc, q = np.nonzero(self._kept(score, met))
            # The first row of each document holds its id.
            at = np.searchsorted(code, first + doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q.astype(np.int32)), rows.column(0).take(pa.array(at)).combine_chunks(), pa.array(score[doc, q])],
                names=["_q", "doc_id", "score"],
            )

    def _table(self, n, code, value, direct, request, term) -> tuple[np.ndarray, np.ndarray]:
        width = len(self.sizes)
        key = code[direct].astype(np.int64) * width + request[direct]
        # Of no rows at all, the counts would be whole numbers.
        score = np.bincount(key, value[direct], n * width).astype(np.float64, copy=False)
        met = np.zeros(n * width, bool)
        met[key] = True
        code, value, term = code[~direct], value[~direct], term[~direct]
        count = self.starts[term + 1] - self.starts[term] if len(term) else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        lo = 0
        while lo < len(term):
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + CHUNK_PRODUCTS, "right")))
            c = count[lo:hi]
            place = np.repeat(self.starts[term[lo:hi]] - (ends[lo:hi] - c - done), c) + np.arange(int(c.sum()))
            # The rows come by document, so only the part of the table that they touch is added to.
            a, b = int(code[lo]) * width, (int(code[hi - 1]) + 1) * width
            key = np.repeat(code[lo:hi].astype(np.int64) * width - a, c) + self.requests[place]
            score[a:b] += np.bincount(key, np.repeat(value[lo:hi], c) * self.weights[place], b - a)
            met[a:b][key] = True
            lo = hi
        return score.reshape(n, width), met.reshape(n, width)

    def _kept(self, score: np.ndarray, met: np.ndarray) -> np.ndarray:
        n = len(score)
        ranked = np.sort(np.where(met, score, -np.inf), axis=0)
        size = np.clip(self.sizes, 0, n)
        last = ranked[np.clip(n - size, 0, n - 1), np.arange(len(size))]
        return met & (size > 0) & (score >= last - TIE)


# Keys are sums of their letters' numbers times powers of an odd number; equal ones are compared letter by letter afterwards.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)

# Bits of a key that say where in the table of all keys it is looked for.
KEY_BITS = 22


def pairs_of_dropped(terms: DataFrame, wanted: list[str], most: int, asked_two: int, term_two: int) -> DataFrame:
    """(qterm, term, df): pairs of ``wanted`` and ``terms`` (term, df) that are equal after some letters are dropped, each once, and a few others.

    From a wanted term of three letters on and a term of two one letter may be dropped, from ``asked_two`` and ``term_two``
    letters on two. Terms of more than ``most`` letters are passed over.
    """
    by_length = {}
    for i, q in enumerate(wanted):
        by_length.setdefault(len(q), []).append(i)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n, some in by_length.items():
        own = np.array(some)
        for key in _dropped([wanted[i] for i in some], n, n > 2, n >= asked_two):
            keys.append(key)
            owners.append(own)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys, kind="stable")
    shared = terms.sparkSession.sparkContext.broadcast((wanted, keys[order], owners[order]))

    def go(batches):
        names, keys, owners = shared.value
        names = pa.array(names, pa.string())
        there = np.zeros(1 << KEY_BITS, bool)
        there[_place(keys)] = True
        for batch in batches:
            words = batch.column(0).to_pylist()
            length = np.array([len(w) for w in words], np.int64)
            found = [np.zeros(0, np.int64)]
            for n in np.unique(length[(length > 0) & (length <= most)]).tolist():
                rows = np.flatnonzero(length == n)
                for key in _dropped([words[i] for i in rows.tolist()], n, n > 1, n >= term_two):
                    at = np.flatnonzero(there[_place(key)])
                    lo, hi = (np.searchsorted(keys, key[at], side) for side in ("left", "right"))
                    c = hi - lo
                    owner = owners[np.repeat(hi - np.cumsum(c), c) + np.arange(int(c.sum()))]
                    found.append(np.repeat(rows[at], c) * len(names) + owner)
            pairs = np.unique(np.concatenate(found))
            row = pa.array(pairs // max(1, len(names)))
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(pairs % max(1, len(names)))), batch.column(0).take(row), batch.column(1).take(row)], names=["qterm", "term", "df"]
            )

    return terms.select("term", "df").mapInArrow(go, f"qterm string, term string, df {terms.schema['df'].dataType.simpleString()}")


def _place(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _dropped(words: list[str], n: int, one: bool, two: bool) -> Iterator[np.ndarray]:
    """Keys of words of ``n`` letters: whole, and without each letter or any two where asked."""
    letters = np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n).T.astype(np.uint64)
    letters = (letters ^ (letters >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
    letters ^= letters >> np.uint64(31)
    powers = np.cumprod(np.array([1] + [BASE] * (n - 1), np.uint64))
    # sums[i]: of the letters before place i. Letters behind a dropped one move a place down.
    sums = np.concatenate([np.zeros((1, len(words)), np.uint64), np.cumsum(letters * powers[:, None], axis=0, dtype=np.uint64)])
    down = [np.uint64(pow(UNBASE, i, 1 << 64)) for i in range(3)]
    yield sums[n]
    for i in range(n if one else 0):
        yield sums[i] + (sums[n] - sums[i + 1]) * down[1]
        for j in range(i + 1, n if two else 0):
            yield sums[i] + (sums[j] - sums[i + 1]) * down[1] + (sums[n] - sums[j + 1]) * down[2]


# Words that are folded at once, about.
CHUNK_WORDS = 1 << 20


def folded(words: DataFrame) -> DataFrame:
    """(term, doc_id, doc_len, positions): the distinct words of each row of ``words`` (doc_id, doc_len, words) and where they stand."""

    def go(batches):
        for batch in batches:
            at, lo = batch.column(2).offsets.to_numpy(), 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_WORDS, "right")) - 1)
                yield _fold(batch.slice(lo, hi - lo))
                lo = hi

    kind = words.schema["doc_id"].dataType.simpleString()
    return words.select("doc_id", "doc_len", "words").mapInArrow(go, f"term string, doc_id {kind}, doc_len int, positions array<int>")


def _fold(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column(2)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    row = np.repeat(np.arange(len(batch)), ends - starts)
    place = np.arange(len(row)) - starts[row]
    coded = lists.flatten().dictionary_encode()
    key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate((first, [len(key)])).astype(np.int32))
    of, term = pa.array(row[order[first]]), coded.indices.take(pa.array(order[first]))
    return pa.RecordBatch.from_arrays(
        [coded.dictionary.take(term), batch.column(0).take(of), batch.column(1).take(of), pa.ListArray.from_arrays(offsets, pa.array(place[order].astype(np.int32)))],
        names=["term", "doc_id", "doc_len", "positions"],
    )


# Executors get no files of this package, so its functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
