"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier decides.

Two kinds of patterns look at every text. The strict ones give the base spans, which always stand. The loose ones give candidates: also forms
that the strict ones do not know (a national telephone number, a masked address), and parts of a match that a strict
pattern took too far and then had to drop, as a telephone number with an address of a machine behind it. Five labelers vote on each
candidate, for, against or not at all: the strict pattern, a check of its structure, lists of names and codes (gazetteers), the
words around it, and the characters at its ends. Expectation maximisation over the vote patterns estimates how often each labeler says what
of true and of false spans, and so how likely each candidate is true. On these a naive Bayes classifier over votes and
shape is trained, and the candidates that it takes for true and that touch no base span of their kind are added.

All of it is SQL functions: texts are read once, what is kept of them are the matches and a few characters around; the
statistics are aggregates with a bounded number of rows, and their results come back as literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import settled, table

KINDS = ("email", "ip", "card", "phone")

# The strict patterns. Where a match begins inside a run of its own characters, it would have begun at the run's start; the
# look-behind says so, which with the possessive quantifiers keeps every pattern linear in the text. A number under 14 digits is no card.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_AT = r"(?:@|\x20?[\[({<](?i:at)[\])}>]\x20?|\x20(?i:at)\x20|\x20@\x20)"
_DOT = r"(?:\.|\x20?[\[({<](?i:dot)[\])}>]\x20?|\x20(?i:dot)\x20)"
LOOSE = {
    "email": rf"(?:(?<![\p{{L}}\p{{N}}._%+-])|\G)[\p{{L}}\p{{N}}._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}(?:(?:\.|\[\.\]|\x20\.\x20)[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}(?:[\x20-][0-9]{3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{14,19})(?![0-9])",
    "phone": (
        r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}"
        r"|\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|(?<![0-9][\x20.-])[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])"
    ),
}

LABELERS = ("pattern", "check", "gazetteer", "context", "ends")

# How sure each labeler is before any text is seen: the share of its votes that are right, worth so many candidates. A labeler says nothing of
# half of the spans.
BEFORE = {"pattern": 0.9, "check": 0.95, "gazetteer": 0.7, "context": 0.75, "ends": 0.75}
WORTH = 20.0
ROUNDS = 12

# A feature is taken to be as frequent among true and false candidates as among all, as if seen among so many of each.
SMOOTH = 5.0

LEFT, RIGHT = 32, 8

#: Fixed: top-level domains, calling codes, first digits of card issuers.
DOMAINS = "com org net edu gov mil int info biz name io co ai app dev eu de fr es it nl be ch at uk us ca mx br ar au nz jp cn in kr ru pl cz se no fi dk pt ie gr tr za".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38|62)"

#: Fixed: words beside personal data of each kind, and words beside numbers that are none.
CUES = {
    "email": "mail e-mail email contact write correo courriel adresse kontakt",
    "ip": "ip host server address login client addr",
    "card": "card visa mastercard amex credit debit karte tarjeta carte",
    "phone": "phone tel telephone call mobile fax cell telefon anruf telefono llamar appeler",
}
AGAINST = "token secret key password sha hash uuid isbn issn doi version build commit order invoice serial"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    return F.call_function("luhn_check", digits(text))


def octets(text: Column) -> Column:
    return text.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")


def is_valid(kind: Column, text: Column) -> Column:
    """Whether a strict match stands."""
    n = F.length(digits(text))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", octets(text))
        .when(kind == "card", n.between(14, 19) & luhn(text))
        .otherwise(n.between(10, 15))
    )


def found_in(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(row, place, spans): what the patterns match in each document, written once.

    A span has its kind, whether it is loose, its number, how many characters lie between it and the one before, its text and the
    characters around it. ``place`` tells rows apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text.alias("text"), F.monotonically_increasing_id().alias("place"))
    number = F.col("text").rlike("[0-9]")
    may_hold = {
        "email": F.col("text").contains("@") | F.col("text").rlike(r"(?i)[\[({<\x20]at[\])}>\x20]"),
        "ip": number, "card": number, "phone": number,
    }
    names = [(k, loose, p) for loose, patterns in ((False, STRICT), (True, LOOSE)) for k, p in patterns.items()]
    hits = rows.select("*", *[
        F.when(may_hold[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"hits{i}") for i, (k, _, p) in enumerate(names)
    ])
    cut = hits.select("*", *[F.when(F.size(f"hits{i}") > 0, F.split("text", p, -1)).alias(f"cut{i}") for i, (_, _, p) in enumerate(names)])

    def spans(i: int, kind: str, loose: bool) -> Column:
        pieces = F.col(f"cut{i}")
        return F.transform(F.when(pieces.isNotNull(), F.col(f"hits{i}")), lambda m, j: F.struct(
            F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), j.alias("number"), F.length(F.get(pieces, j)).alias("gap"),
            F.substring(F.get(pieces, j), -LEFT, LEFT).alias("left"), m.alias("text"), F.substring(F.get(pieces, j + 1), 1, RIGHT).alias("right"),
        ))

    none = F.array().cast("array<struct<kind:string,loose:boolean,number:int,gap:int,left:string,text:string,right:string>>")
    all_ = F.concat(*[F.coalesce(spans(i, k, loose), none) for i, (k, loose, _) in enumerate(names)])
    return settled(cut.select("row", "place", all_.alias("spans")))


def placed(found: DataFrame) -> DataFrame:
    """(place, kind, loose, start, end, left, text, right, stands, twin, touches), a row per span, written once.

    Starts and ends are code points. ``stands``: a strict match that holds. For a loose one, ``twin``: the strict match there has the same bounds
    and was dropped; ``touches``: it overlaps one that stands. A window holds the spans of one kind of one document.
    """
    rows = found.select("place", F.inline("spans"))
    upto = Window.partitionBy("place", "kind", "loose").orderBy("number")
    before = F.sum(F.length("text")).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    start = F.sum("gap").over(upto.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(before, F.lit(0))
    bounded = rows.select("*", start.alias("start")).withColumn("end", F.col("start") + F.length("text"))
    stands = ~F.col("loose") & is_valid(F.col("kind"), F.col("text"))
    along = Window.partitionBy("place", "kind")
    so_far = along.orderBy("start", "loose").rowsBetween(Window.unboundedPreceding, 0)
    to_come = along.orderBy(F.desc("start"), F.desc("loose")).rowsBetween(Window.unboundedPreceding, 0)
    marked = bounded.withColumn("stands", stands)
    strict = F.last(F.when(~F.col("loose"), F.struct("start", "end", "stands")), ignorenulls=True).over(so_far)
    last_end = F.max(F.when(F.col("stands"), F.col("end"))).over(so_far)
    next_start = F.min(F.when(F.col("stands"), F.col("start"))).over(to_come)
    seen = marked.select("*", strict.alias("strict"), last_end.alias("last_end"), next_start.alias("next_start"))
    same = (F.col("strict.start") == F.col("start")) & (F.col("strict.end") == F.col("end")) & ~F.col("strict.stands")
    touches = (F.col("last_end") > F.col("start")) | (F.col("next_start") < F.col("end"))
    no = F.lit(False)
    return settled(seen.select(
        "place", "kind", "loose", "start", "end", "left", "text", "right", "stands",
        F.coalesce(same, no).alias("twin"), F.coalesce(touches, no).alias("touches"),
    ))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def _cue(words: str) -> str:
    return rf"(?i)(?<![\p{{L}}])(?:{'|'.join(words.split())})(?![\p{{L}}])"


def candidates(spans: DataFrame) -> DataFrame:
    """The loose spans with ``votes``, one for each labeler, and ``features``, both over fixed small sets of values."""
    kind, text = F.col("kind"), F.col("text")
    number, v6 = digits(text), text.contains(":")
    label = F.lower(F.regexp_extract(text, r"([A-Za-z0-9-]+)$", 1))
    code = F.regexp_extract(text, r"^\+([0-9]+)", 1)
    plain_ip = F.regexp_replace(text, r"[^0-9.]", "")
    check = (
        F.when(kind == "email", ~text.rlike(r"(?:^[.-]|\.\.|[.@-]@|@-|-$)") & (F.length(text) <= 254))
        .when(kind == "ip", v6 | octets(plain_ip))
        .when(kind == "card", luhn(text))
        .otherwise(F.length(number).between(10, 15))
    )
    listed = (
        F.when(kind == "email", _vote(label.isin(DOMAINS), ~label.isin(DOMAINS)))
        .when(kind == "ip", _vote(v6 | text.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[^0-9]"), text.rlike("^(?:0|2[3-9])")))
        .when(kind == "card", _vote(number.rlike(ISSUERS), F.lit(False)))
        .otherwise(_vote(code.isin(CALLING), (code != "") & ~F.substring(code, 1, 1).isin("1", "7") & ~F.substring(code, 1, 2).isin(CALLING)))
    )
    around = F.concat_ws(" ", "left", "right")
    cue = F.coalesce(*[F.when(kind == k, around.rlike(_cue(w))) for k, w in CUES.items()])
    joined = F.col("left").rlike(r"[\p{L}\p{N}_\"'=/]$") | F.col("right").rlike(r"^[\p{L}\p{N}_\"'=/]")
    votes = F.struct(
        _vote(F.col("touches"), F.col("twin")).alias("pattern"),
        _vote(check, ~check).alias("check"),
        listed.alias("gazetteer"),
        _vote(cue, around.rlike(_cue(AGAINST))).alias("context"),
        _vote(~joined, joined).alias("ends"),
    )
    voted = spans.where("loose").select("place", "kind", "start", "end", "touches", "left", "text", "right", votes.alias("votes"))
    side = lambda c, at: F.when(F.length(c) == 0, "none").when(F.col(c).rlike(rf"\p{{L}}$" if at else rf"^\p{{L}}"), "letter").when(F.col(c).rlike(r"[0-9]$" if at else r"^[0-9]"), "digit").when(F.col(c).rlike(r"\s$" if at else r"^\s"), "blank").otherwise("sign")  # noqa: E731, E501
    shape = F.concat_ws(
        "", F.when(F.col("text").contains(" "), "blank"), F.when(F.col("text").contains("-"), "dash"), F.when(F.col("text").contains("("), "bracket"), F.when(F.col("text").contains("+"), "plus")
    )
    features = F.array(
        *[F.concat(F.lit(f"{name}="), F.col(f"votes.{name}").cast("string")) for name in LABELERS],
        F.concat(F.lit("digits="), F.least(F.length(digits(F.col("text"))), F.lit(20)).cast("string")),
        F.concat(F.lit("shape="), shape),
        F.concat(F.lit("before="), side("left", True)),
        F.concat(F.lit("after="), side("right", False)),
    )
    return voted.select("place", "kind", "start", "end", "touches", "votes", features.alias("features"))


def _table(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])


def _vote_key(name: str) -> Column:
    return F.concat("kind", F.lit(f"|{name}|"), F.col(f"votes.{name}").cast("string"))


def posterior(weights: dict[str, float]) -> Column:
    """How likely a candidate is true, from its votes: ``weights`` has the log odds of each kind and of each vote."""
    known = _table(weights)
    odds = F.element_at(known, F.concat("kind", F.lit("|prior")))
    for name in LABELERS:
        odds = odds + F.element_at(known, _vote_key(name))
    return 1 / (1 + F.exp(-odds))


def vote_weights(counts: dict[str, tuple[float, float, dict[tuple[str, int], tuple[float, float]]]]) -> dict[str, float]:
    """Log odds from expected counts, per kind (true, false, {(labeler, vote): (true, false)}); what was believed before counts as ``WORTH`` candidates."""
    weights = {}
    for kind in KINDS:
        true, false, votes = counts.get(kind, (0.0, 0.0, {}))
        weights[f"{kind}|prior"] = math.log((true + 1) / (false + 1))
        for name in LABELERS:
            right = BEFORE[name]
            for vote in (-1, 0, 1):
                a, b = votes.get((name, vote), (0.0, 0.0))
                for_true, for_false = {1: (right / 2, (1 - right) / 2), -1: ((1 - right) / 2, right / 2), 0: (0.5, 0.5)}[vote]
                weights[f"{kind}|{name}|{vote}"] = math.log((a + WORTH * for_true) / (true + WORTH) / ((b + WORTH * for_false) / (false + WORTH)))
    return weights


def reliabilities(cells: DataFrame) -> dict[str, float]:
    """The weights of the votes by expectation maximisation. ``cells``: kind, votes, n, at most 3**5 rows per kind.

    A round is one aggregate over the cells with a row for each kind.
    """
    weights = vote_weights({})
    kinds = cells.groupBy("kind", "votes").agg(F.sum("n").cast("double").alias("n"))
    for _ in range(ROUNDS):
        p = kinds.select("*", posterior(weights).alias("p"))
        sums = [F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))]
        keys = [(name, vote) for name in LABELERS for vote in (-1, 0, 1)]
        for name, vote in keys:
            there = F.when(F.col(f"votes.{name}") == vote, F.col("n")).otherwise(0.0)
            sums += [F.sum(there * F.col("p")), F.sum(there * (1 - F.col("p")))]
        counts = {}
        for kind, true, false, *rest in p.groupBy("kind").agg(*sums).collect():  # a row per kind
            counts[kind] = (true, false, {k: (rest[2 * i], rest[2 * i + 1]) for i, k in enumerate(keys)})
        weights = vote_weights(counts)
    return weights


def classifier(cells: DataFrame, weights: dict[str, float]) -> dict[str, float]:
    """Log odds of each kind and feature, from the expected true and false candidates that have it; a row for each value of a feature."""
    p = cells.select("*", posterior(weights).alias("p"))
    of = lambda rows, *keys: rows.groupBy("kind", *keys).agg(F.sum(F.col("n") * F.col("p")).alias("t"), F.sum(F.col("n") * (1 - F.col("p"))).alias("f"))
    totals = {r["kind"]: (r["t"], r["f"]) for r in of(p).collect()}
    odds = {f"{k}|prior": math.log((t + 1) / (f + 1)) for k, (t, f) in totals.items()}
    for kind, feature, t, f in of(p.select("*", F.explode("features").alias("feature")), "feature").collect():
        true, false = totals[kind]
        share = SMOOTH * (t + f) / (true + false)
        odds[f"{kind}|{feature}"] = math.log((t + share) / (true + SMOOTH) / ((f + share) / (false + SMOOTH)))
    return odds


def span_odds(odds: dict[str, float]) -> Column:
    known = _table(odds)
    return F.aggregate(
        "features", F.element_at(known, F.concat("kind", F.lit("|prior"))),
        lambda total, x: total + F.coalesce(F.try_element_at(known, F.concat(F.col("kind"), F.lit("|"), x)), F.lit(0.0)),
    )


def personal_data(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(row, spans), a row per document: ``spans`` by start, then kind as in ``KINDS``, each (start, kind, end, base).

    ``row`` holds the columns ``carry``, all by default, so no name can clash. Starts and ends are code points, ends exclusive. ``base`` spans are the
    strict matches that stand; the others were added. A null text is an empty one; each row is judged by itself, so
    repeated rows and rows without doc_id have their own spans. No candidate of a kind leaves its labelers as they were believed before.
    """
    found = found_in(docs, docs.columns if carry is None else carry)
    spans = placed(found)
    loose = settled(candidates(spans))
    cells = settled(loose.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")))
    chosen = loose.where("NOT touches")
    if not cells.isEmpty():
        odds = classifier(cells, reliabilities(cells))
        chosen = chosen.where(span_odds(odds) > 0)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    both = spans.where("stands").select("place", "kind", "start", "end", F.lit(True).alias("base")).unionByName(
        chosen.select("place", "kind", "start", "end", F.lit(False).alias("base"))
    )
    lists = both.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("start", number.alias("number"), "kind", "end", "base"))).alias("list"))
    out = F.transform("list", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
    none = F.array().cast("array<struct<start:bigint,kind:string,end:bigint,base:boolean>>")
    return found.select("row", "place").join(lists, "place", "left").select("row", F.coalesce(out, none).alias("spans"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("row.doc_id", *map(of, KINDS), F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))
