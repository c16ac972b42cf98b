import datetime
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import parsing
from shelfmark.functions.text import sanitize_query, tokens
from shelfmark.operators.typos import fuzzy_terms


def values(spark, column, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i INT, t STRING").select("i", column.alias("v")).orderBy("i")
    return [r.v for r in df.collect()]


def test_clean_text_strips_every_unicode_space(spark):
    texts = [None, "", "   ", " a b\t", "  x　", "\x1c\x1fy\x85", "z"]
    assert values(spark, parsing.clean_text("t"), texts) == [(t or "").strip() for t in texts]
    assert values(spark, parsing.blank_to_null("t"), texts) == [(t or "").strip() or None for t in texts]


def test_safe_int(spark):
    texts = [None, "", " 7 ", "x", "7.0", "1e3", "+5", "-5", "1_000", "12L", "9223372036854775807", "9223372036854775808"]
    assert values(spark, parsing.safe_int("t"), texts) == [
        None, None, 7, None, None, None, 5, -5, None, None, 9223372036854775807, None,
    ]


def test_safe_double(spark):
    texts = ["", "0", "1e3", "abc", "1.5d", "1.5f", "0x1p3", ".5", "5.", "-2.5", "inf", "-Infinity", "1e400", "1_0.5", "+nan"]
    inf = math.inf
    assert values(spark, parsing.safe_double("t"), texts) == [
        None, 0.0, 1000.0, None, None, None, None, 0.5, 5.0, -2.5, inf, -inf, inf, None, None,
    ]
    assert math.isnan(values(spark, parsing.safe_double("t"), [" NaN "])[0])
    assert values(spark, parsing.safe_double("t", finite_only=True), ["nan", "inf", "1e400", "2"]) == [None, None, None, 2.0]


def test_safe_date(spark):
    texts = ["2024-01-05", "2024-1-5", "2024", "2024-02-30", "bad", "", None, " 2024-12-31 ", "2024-01-05T10:00:00", "0000-01-01"]
    day = datetime.date
    assert values(spark, parsing.safe_date("t"), texts) == [
        day(2024, 1, 5), None, None, None, None, None, None, day(2024, 12, 31), None, None,
    ]


SANITISED = {
    "Rye": "Rye",
    "\trye bread\n": "rye bread",
    "oats (rolled), 10.5% fat-free": "oats (rolled), 10.5% fat-free",
    "o'clock tea": "o'clock tea",
    "rye \u2003 bread": "rye bread",
    " ": "",
    "rye&bread=2": "rye bread 2",
    "x/y|z": "x y z",
    "rye - - oats -": "rye - oats",
    "- rye": "rye",
    "#@!": "",
    "a - - b": "a - b",
    "--a": "-a",
    "a -- b": "a -- b",
    "a- b": "a- b",
    "café": "caf",
}


def test_sanitizer_cases(spark):
    assert values(spark, sanitize_query("t"), list(SANITISED)) == list(SANITISED.values())
    assert values(spark, sanitize_query("t"), [None]) == [""]
    assert values(spark, sanitize_query("t", unicode=True), ["café+crème"]) == ["café crème"]


def by_hand(text):
    """The documented steps, one character at a time."""
    allowed = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789,-.%'()")
    s = "".join(c if c in allowed or c.isspace() else " " for c in text.strip())
    out, i = [], 0
    while i < len(s):
        alone = s[i : i + 3]
        if len(alone) == 3 and alone[1] == "-" and alone[0].isspace() and alone[2].isspace():
            out.append(" ")
            i += 3
        elif s[i] == "-" and i in (0, len(s) - 1):
            out.append(" ")
            i += 1
        else:
            out.append(s[i])
            i += 1
    return " ".join("".join(out).split())


def test_sanitizer_on_random_text(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1 -- -,.%'()+;*é\t \x1c") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert values(spark, sanitize_query("t"), texts) == [by_hand(t) for t in texts]


def test_tokens(spark):
    texts = ["Don't 3.5 U.S. 1,000 café", None, "", "pan-fried, (raw)", "a.1 1.a x_y 'q'", "éte"]
    assert values(spark, tokens("t"), texts) == [
        ["don't", "3.5", "u.s", "1,000", "café"], [], [], ["pan", "fried", "raw"], ["a", "1", "1", "a", "x_y", "q"], ["éte"],
    ]


def test_a_very_long_token_is_no_problem(spark):
    text = "ab1." * 200_000
    assert values(spark, F.size(tokens("t")), [text]) == [len(re.findall("ab1", text))]


def distance(a, b):
    """Edits by breadth-first search over strings, at most two."""
    def step(words, letters):
        out = set()
        for w in words:
            for i in range(len(w) + 1):
                out |= {w[:i] + c + w[i:] for c in letters}
                if i < len(w):
                    out.add(w[:i] + w[i + 1 :])
                    out |= {w[:i] + c + w[i + 1 :] for c in letters}
                if i + 1 < len(w):
                    out.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
        return out

    if a == b:
        return 0
    one = step({a}, set(b))
    if b in one:
        return 1
    # Two edits: some string lies one edit from both.
    return 2 if one & step({b}, set(a) | set(b)) else 3


def wrong(rng, word, times):
    for _ in range(times):
        i, kind = rng.randrange(max(1, len(word))), rng.randrange(4)
        c = rng.choice("abcé")
        word = [
            word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :],
            word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :],
        ][kind]
    return word


@pytest.mark.parametrize("sizes", [(1, 2, 3, 4), (5, 6, 7), (14, 15, 16, 17, 18, 24)])
def test_typo_pairs_equal_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    words = {"".join(w) for n in sizes if n < 4 for w in itertools.product("abé", repeat=n)}
    for n in sizes:
        for _ in range(4):
            word = "".join(rng.choice("abcdé") for _ in range(n))
            words |= {word, *(wrong(rng, word, rng.choice((1, 2, 2, 3))) for _ in range(5))}
    words = sorted(w for w in words if w)
    limit = {w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2 for w in words}
    want = set()
    for a, b in itertools.product(words, repeat=2):
        if abs(len(a) - len(b)) <= limit[a]:
            d = distance(a, b)
            if d <= limit[a]:
                want.add((a, b, d))
    terms = spark.createDataFrame([(w, 1) for w in words], "term STRING, df BIGINT")
    found = fuzzy_terms(terms.select(F.col("term").alias("qterm")), terms, max_expansions=None)
    assert {(r.qterm, r.term, r.edits) for r in found.collect()} == want
