"""The quality classifier's parts against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zlib

from shelfmark.llm import packing, quality

from llm_tables import ROWS

TEXTS = [t for _, t in ROWS] + ["A short line\nand " + "a line of more than thirty characters and some\n" * 2 + "\r\nEND!!", "x" * 300 + " " + "x" * 300 + "\n" + "y" * 400, "$$$ && a1 \x00\x7f"]


def plain_statistics(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = re.findall(rb"[^\n\r]+", data)
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    n, counts = max(len(data), 1), Counter(data)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / len(sizes) if sizes else 0.0
    found = Counter(w.translate(lower) for w in words)
    odd = set(quality._classes["symbol"]) | {ord("!")}
    out = {
        "log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(words)), "word_mean": mean,
        "word_spread": math.sqrt(max(sum(s * s for s in sizes) / len(sizes) - mean * mean, 0)) if sizes else 0.0,
        "distinct_words": len(found) / max(len(words), 1), "top_word": max(found.values(), default=0) / max(len(words), 1),
        "symbol_ends": sum(w[-1] in odd for w in words) / max(len(words), 1),
        "line_mean": math.log1p(sum(map(len, lines)) / max(len(lines), 1)),
        "distinct_lines": len({x.translate(lower) for x in lines}) / max(len(lines), 1),
        "short_lines": sum(len(x) < 30 for x in lines) / max(len(lines), 1),
        "entropy": -sum(c / n * math.log2(c / n) for c in counts.values()),
    }
    out |= {name: sum(counts[b] for b in members) / n for name, members in quality._classes.items()}
    return [out[s] for s in quality.STATISTICS]


def test_statistics_by_hand():
    got = quality.batch_statistics(pa.array(TEXTS, pa.string()))
    assert np.allclose(got, [plain_statistics(t) for t in TEXTS], atol=1e-6)


def test_model_is_the_ridge_of_all_training_rows(shipped):
    """Means, features, normal equations and calibration, worked out in one piece."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["good", "prose", "BUY", "$$$", "now!!", "and"], rng.integers(1, 40)))) for i in range(200)]
    labels = [(i, int(t.count("$") < 2)) for i, t in rows if i % 2] + [(1, 1), (3, None), (10**6, 1)]
    docs = shipped.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    model = quality.fitted(quality.measured(docs), shipped.createDataFrame(labels, "doc_id BIGINT, quality INT"))
    x = quality.batch_statistics(pa.array([t for _, t in rows]))
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.spread, np.maximum(x.std(axis=0), 1e-9))
    train = [(i, y) for i, y in labels if y is not None and i < 200 and zlib.crc32(str(i).encode()) % 5]
    z, y = model.cosines(x[[i for i, _ in train]]), np.array([y for _, y in train], float)
    penalty = quality.RIDGE * len(y) * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    assert np.allclose(z @ np.linalg.solve(z.T @ z + penalty, z.T @ y), z @ model.weights, atol=1e-6)
    assert (np.diff(model.value) >= 0).all()
    score = model.score(x)
    assert ((score >= 0) & (score <= 1)).all() and score[[i for i, v in train if v]].mean() > score[[i for i, v in train if not v]].mean()


def test_cosines_come_near_the_gaussian_kernel():
    """The product of two rows of random features is the kernel of their distance, up to the error of 384 features."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, len(quality.STATISTICS)))
    model = quality.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = model.cosines(x)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2) / x.shape[1]
    assert np.abs(z @ z.T - np.exp(-far / 2)).max() < 0.25


def test_padding_is_bounded():
    """First-fit leaves at most one sequence of a group half empty, so padding is under half, and far less for mixed sizes."""
    rng = np.random.default_rng(7)
    for sizes in (rng.integers(1, 2048, 3000), rng.integers(1100, 1300, 500), rng.integers(1, 50, 5000)):
        bins, _ = packing.first_fit_decreasing(sizes, 2048)
        used = np.bincount(bins, weights=sizes)
        assert (used <= 2048).all() and (used * 2 <= 2048).sum() <= 1
    sizes = rng.integers(1, 2048, 8192)
    bins, _ = packing.first_fit_decreasing(sizes, 2048)
    assert (bins.max() + 1) * 2048 <= 1.02 * sizes.sum() + 2048
