"""Odd tables for the operators' tests."""

import pyarrow as pa
import pyarrow.parquet as pq

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
SHARED = "the quick onyx goblin jumps over the lazy dwarf while seven wizards judge the sphinx of black quartz and vow " * 2
ROWS = [
    (1, SHARED + "alpha one\nA line that is long enough to count, number one.\nshort"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, SHARED + "beta two\nA line that is long enough to count, number two.\nshort"),
    (6, SHARED + "alpha one\nA line that is long enough to count, number one.\nshort"),
    (6, SHARED + "alpha one\nA line that is long enough to count, number one.\nshort"),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "é" * 70 + " ñandú 日本語 \u2003 \x1c end"),
    (10, "ab" * 400),
    (None, SHARED + "alpha one\nA line that is long enough to count, number one.\nshort"),
    (11, "One two  three"),
    (12, "one TWO\tthree"),
]


def write_tables(folder, documents=ROWS, pages=(), labels=(), benchmark=()):
    """The tables of a scale folder, documents and pages with columns whose names operators use themselves."""
    clash = {"row": pa.int64(), "spans": pa.string(), "lines": pa.string(), "items": pa.string(), "slot": pa.string(), "score": pa.string(), "n_words": pa.string(), "kept": pa.string()}

    def put(name, columns, kinds, rows, extra=None):
        rows = [(*r, *[None] * (len(columns) - len(r))) for r in rows]
        arrays = {c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))}
        arrays |= {c: pa.array([None] * len(rows), k) for c, k in (extra or {}).items()}
        pq.write_table(pa.table(arrays), f"{folder}/{name}.parquet")

    wide = [(i, t, "en", "s", None if t is None else len(t)) for i, t in documents]
    put("documents", ["doc_id", "text", "lang", "source", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()], wide, clash)
    put("pages", ["page_id", "url", "html"], [pa.int64(), pa.string(), pa.string()], pages, {"row": pa.int64(), "host": pa.string(), "best": pa.string()})
    put("labels", ["doc_id", "quality", "toxic"], [pa.int64(), pa.int32(), pa.int32()], labels)
    put("benchmark", ["item_id", "text"], [pa.int64(), pa.string()], benchmark)
    return str(folder)
