"""Personal data: base spans against the plain patterns, the estimates against a plain version, and what is added."""

import hashlib
import math
import random
import re

import pytest

from shelfmark.llm import pii, queries

from llm_tables import ROWS, write_tables

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(p[-400:]) for p in m[0].split(".")) > 255:
                continue
            if kind == "card" and not (14 <= len(number) <= 19 and luhn(number)):
                continue
            if kind == "phone" and not 10 <= len(number) <= 15:
                continue
            out.append((m.start(), list(PLAIN).index(kind), kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def card(rng, ok=True):
    while True:
        number = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(number) == ok:
            return number


def planted(seed=5, n=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéñ") for _ in range(rng.randint(2, 7)))
    kinds = [
        lambda: f"{word()}.{rng.randint(0, 99)}@mail{rng.randint(0, 9)}.example.com",
        lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: card(rng), lambda: card(rng, False), lambda: " ".join(re.findall("....", card(rng))),
        lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
        lambda: f'token = "{rng.getrandbits(160):040x}"',
        lambda: str(rng.randint(0, 10**rng.randint(1, 20))),
    ]
    return [(1000 + i, " ".join(rng.choice(kinds)() if rng.random() < 0.2 else word() for _ in range(rng.randint(1, 60)))) for i in range(n)]


ODD = [
    (1, "a@b c@d.e_f@g.h.i @x.y a@b@c.d é.x@y.z. q@-.-"), (2, "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3 " + "0" * 500 + "1.1.1.1"),
    (3, "😀 +1 (843) 555-7672 170.106.47.218 and +1 234"), (4, "4111 1111 1111 1111 12 4111111111111111 4111-1111-1111-1111"), (5, None), (6, ""),
    (None, "me@example.com"), (None, "me@example.com"), (7, "x" * 2_000 + "@ " + "9" * 2_000 + " " + "1." * 2_000 + " +" + "1 " * 2_000), (8, "a.b@c" + ".d" * 2_000),
]


def spans_of(df):
    return [(r["row"]["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["base"]]) for r in df.collect()]


def test_base_spans_are_those_of_the_plain_patterns(shipped, tmp_path):
    rows = ODD + planted() + [r[:2] for r in ROWS]
    folder = write_tables(tmp_path, documents=rows)
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in queries.QUERIES["op13_personal_data"](shipped, folder).collect())
    want = []
    for i, text in rows:
        spans = base_spans(text)
        want.append((str(i), *[sum(k == kind for k, _, _ in spans) for kind in PLAIN], hashlib.sha256(told(spans).encode()).hexdigest()))
    assert got == sorted(want)


def test_spans_keep_the_base_and_add_what_the_strict_patterns_lost(spark):
    rng = random.Random(9)
    lost = [
        (1, "call +1 (843) 555-7672 170.106.47.218 now", "+1 (843) 555-7672"), (2, f"paid {card(rng)} 170.106.47.218 now", None),
        (3, "write to jane.doe (at) mail.example.com please", "jane.doe (at) mail.example.com"), (4, "ring (843) 555-7672 today", "(843) 555-7672"),
    ]
    docs = spark.createDataFrame([r[:2] for r in lost] + planted(), "doc_id BIGINT, text STRING")
    texts = {i: t for i, t, *_ in [*lost, *planted()]}
    found = {i: (base, added) for i, base, added in spans_of(pii.personal_data(docs))}
    for i, text in texts.items():
        base, added = found[i]
        assert base == base_spans(text)
        for kind, a, b in added:
            assert not any(k == kind and a < e and s < b for k, s, e in base)
            if kind == "card":
                assert luhn(re.sub("[^0-9]", "", text[a:b]))
    for i, text, what in lost:
        taken = [text[a:b] for _, a, b in found[i][1]]
        assert (what in taken) if what else any(re.fullmatch("[0-9]{16}", t) for t in taken), (i, taken)


def test_decoys_are_left_alone(spark):
    """Numbers that fail their check, and digits inside other tokens, are not added, however many there are."""
    rng = random.Random(3)
    rows = [(i, f"the {card(rng, False)} and token = \"{rng.getrandbits(160):040x}\" v1.2.300.4 of {rng.randint(1, 10**9)}") for i in range(200)]
    added = [x for _, _, more in spans_of(pii.personal_data(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))) for x in more]
    assert not added
    assert not [x for _, _, more in spans_of(pii.personal_data(spark.createDataFrame(rows[:1], "doc_id BIGINT, text STRING"))) for x in more]


def test_estimates_by_hand(spark):
    """The same rounds over single candidates, with plain numbers."""
    docs = spark.createDataFrame(planted(8, 200), "doc_id BIGINT, text STRING")
    loose = pii.candidates(pii.placed(pii.found_in(docs, ["doc_id"]))).collect()
    rows = [(r["kind"], r["votes"].asDict(), r["features"]) for r in loose]
    weights = pii.vote_weights({})
    for _ in range(pii.ROUNDS):
        counts = {}
        for kind, votes, _ in rows:
            p = 1 / (1 + math.exp(-weights[f"{kind}|prior"] - sum(weights[f"{kind}|{n}|{v}"] for n, v in votes.items())))
            true, false, each = counts.get(kind, (0.0, 0.0, {}))
            for key in votes.items():
                a, b = each.get(key, (0.0, 0.0))
                each[key] = (a + p, b + 1 - p)
            counts[kind] = (true + p, false + 1 - p, each)
        weights = pii.vote_weights(counts)
    cells = spark.createDataFrame(loose).groupBy("kind", "votes", "features").count().withColumnRenamed("count", "n")
    got = pii.reliabilities(cells)
    assert got.keys() == weights.keys() and all(got[k] == pytest.approx(weights[k], abs=1e-9) for k in weights)
    odds = pii.classifier(cells, got)
    for kind in {k for k, _, _ in rows}:
        mine = [(1 / (1 + math.exp(-weights[f"{kind}|prior"] - sum(weights[f"{kind}|{n}|{v}"] for n, v in votes.items()))), f) for k, votes, f in rows if k == kind]
        true = sum(p for p, _ in mine)
        false = len(mine) - true
        for feature in {x for _, f in mine for x in f}:
            t = sum(p for p, f in mine if feature in f)
            n = sum(feature in f for _, f in mine)
            share = pii.SMOOTH * n / len(mine)
            assert odds[f"{kind}|{feature}"] == pytest.approx(math.log((t + share) / (true + pii.SMOOTH) / ((n - t + share) / (false + pii.SMOOTH))), abs=1e-9)


def test_very_long_words_and_many_matches_take_linear_time(spark):
    """A text of words and numbers of hundreds of thousands of characters: no pattern and no window is quadratic in it."""
    text = "x" * 300_000 + "@ " + "9" * 300_000 + " " + "1.1.1.1 " * 30_000 + "+" + "1 " * 100_000 + "a.b@c" + ".d" * 100_000
    [(_, base, _)] = spans_of(pii.personal_data(spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")))
    assert sum(k == "ip" for k, *_ in base) == 30_000 and sum(k == "email" for k, *_ in base) == 1


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(planted(2, 20), "doc_id BIGINT, text STRING")
    plan = pii.personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
