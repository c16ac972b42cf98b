"""The filter audit against a walk through every order, on odd rows."""

import re
from collections import Counter
from itertools import permutations
from math import factorial

import pytest

from shelfmark.llm import audit

from llm_tables import ROWS

GOOD = " ".join(f"w{i}" for i in range(120))
EXTRA = [
    (20, GOOD, "en"), (21, GOOD, "en"), (21, GOOD, "en"), (22, GOOD + " $", "de"), (23, GOOD.upper(), None), (24, "one two", ""),
    (25, "dup " * 150, "fr"), (26, "dup " * 150, "fr"), (None, GOOD, "en"), (None, "only here", "en"), (None, "only here", "en"), (27, GOOD + " #", "de"),
]
LABELS = [(20, 1, 0), (21, 1, 1), (21, None, None), (22, 0, 1), (None, 1, 1), (25, 1, None), (26, 0, 1)]


def failed(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = t in least and (i is None or i > least[t])
        yield i, part or "", [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]


def by_hand(rows, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    docs = list(failed(rows))
    out, removed_in_all = [], Counter()
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        for order in permutations(range(5)):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if x[f]]
                left = [(i, x) for i, x in left if not x[f]]
                removed_in_all[part, f] += len(gone)
                out.append((part, "".join("ABCDE"[k] for k in order), step, f, len(left), len(gone), sum(x[f] for _, x in mine) - len(gone),
                            sum(x[f] and sum(x) == 1 for _, x in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
    return {r[:3] + r[4:] + (removed_in_all[r[0], r[3]],) for r in out}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_audit(spark, monkeypatch, limit):
    from shelfmark.operators import skew

    monkeypatch.setattr(audit, "with_membership", lambda *a: skew.with_membership(*a, limit))
    rows = [(i, t, "xx") for i, t in ROWS] + EXTRA
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id BIGINT, quality INT, toxic INT")
    found = audit.audit(docs, labels).collect()
    assert len(found) == 600 * len({p or "" for *_, p in rows})
    assert {tuple(r) for r in found} == by_hand(rows, LABELS)


def test_paths():
    for n in (1, 3, 5):
        reach, leave = audit.path_counts(n)
        assert reach == [factorial(s.bit_count()) for s in range(1 << n)]
        assert leave == [factorial(n - s.bit_count()) for s in range(1 << n)]


def test_shapley_adds_up_to_what_all_filters_remove(spark):
    """Efficiency: over all filters the Shapley values of a part are what the whole set removes, in every order."""
    docs = spark.createDataFrame([(i, t, "xx") for i, t in ROWS], "doc_id BIGINT, text STRING, lang STRING")
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    rows = audit.audit(docs, labels).where("filter_order = 'ABCDE'").collect()
    kept = min(r["kept"] for r in rows)
    assert sum(r["shapley"] for r in rows) == 120 * (len(ROWS) - kept)


def test_copies_need_no_join_by_text(spark):
    """The text's hash is a join key only together with the doc_id, so copies of one text do not meet in a task."""
    docs = spark.createDataFrame([(i, "same", "en") for i in range(300)], "doc_id BIGINT, text STRING, lang STRING")
    cells = audit.judged(docs, spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT"))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("doc_id" in line for line in joins)
    assert {(r["mask"], r["n"]) for r in cells.collect()} == {(0b10001, 299), (0b00001, 1)}
