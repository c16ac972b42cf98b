"""Near terms: what is computed, and pairs around the edges of both kinds of key."""

from pyspark.sql import functions as F

from shelfmark.operators.typos import fuzzy_terms


def test_a_pair_is_compared_once(spark, capsys):
    words = spark.createDataFrame([("haddock",)], "qterm STRING")
    terms = spark.createDataFrame([("hadock", 1), ("ahddokc", 2), ("paddocks", 3), ("milk", 4)], "term STRING, df BIGINT")
    found = fuzzy_terms(words, terms)
    assert {(r.term, r.edits) for r in found.collect()} == {("hadock", 1), ("ahddokc", 2), ("paddocks", 2)}
    capsys.readouterr()
    found.explain()
    # A filter on what was computed reads it and does not compute it again.
    filters = [line for line in capsys.readouterr().out.splitlines() if "Filter " in line]
    assert filters and not any("levenshtein(" in line for line in filters)


def test_both_kinds_of_key(spark):
    long = "abcdefghijklmnopqrst"
    terms = {long[:n] for n in range(1, 20)} | {long[:n - 1] + "zz" for n in range(3, 19)} | {"ba" + long[2:n] for n in range(3, 19)}
    terms = spark.createDataFrame([(t, 1) for t in terms], "term STRING, df BIGINT")
    found = fuzzy_terms(terms.select(F.col("term").alias("qterm")), terms)
    q, t = F.col("qterm"), F.col("term")
    allowed = F.when(F.length(q) <= 2, 0).when(F.length(q) <= 5, 1).otherwise(2)
    pairs = terms.select(F.col("term").alias("qterm")).crossJoin(terms.select("term"))
    # Without swaps, so a lower bound of what must be found.
    plain = {tuple(r) for r in pairs.where(F.levenshtein(q, t) <= allowed).select("qterm", "term").collect()}
    got = {(r.qterm, r.term) for r in found.collect()}
    assert plain <= got and ("abcdefghijklmnop", "bacdefghijklmnop") in got
    assert all(abs(len(a) - len(b)) <= 2 for a, b in got) and found.count() == len(got)
