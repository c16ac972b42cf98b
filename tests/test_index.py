"""How the tables of the search index are made."""

from shelfmark.operators import index as indexes

DOCS = "doc_id BIGINT, name STRING"


def plan_of(df, capsys):
    df.collect()
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_words_are_folded_within_their_document(spark, capsys):
    docs = spark.createDataFrame([(1, "b a b"), (2, "a"), (3, None), (4, "+ +")], DOCS)
    folded = indexes.posting_rows(indexes.analysed(docs, "doc_id", "name"))
    rows = sorted((r.term, r.doc_id, r.doc_len, r.tf, r.positions) for r in folded.collect())
    assert rows == [("a", 1, 3, 1, [1]), ("a", 2, 1, 1, [0]), ("b", 1, 3, 2, [0, 2])]
    # Rows are exchanged by term only where an id is held by several of them, here none.
    final = plan_of(folded, capsys).split("Initial Plan")[0]
    assert "hashpartitioning(term" not in final


def test_documents_that_share_an_id_or_have_none_count_together(spark):
    docs = spark.createDataFrame([(1, "b a"), (1, "a b"), (1, "a"), (None, "c c"), (None, "d c"), (2, "a")], DOCS)
    folded = indexes.posting_rows(indexes.analysed(docs, "doc_id", "name"))
    rows = {(r.term, r.doc_id, r.doc_len): (r.tf, r.positions) for r in folded.collect()}
    assert rows == {
        ("a", 1, 2): (2, [0, 1]), ("b", 1, 2): (2, [0, 1]), ("a", 1, 1): (1, [0]),
        ("c", None, 2): (3, [0, 1, 1]), ("d", None, 2): (1, [0]), ("a", 2, 1): (1, [0]),
    }


def test_term_counts_need_no_postings(spark, capsys):
    docs = spark.createDataFrame([(1, "b a b"), (2, "a"), (3, None), (5, "c b"), (5, "b c"), (None, "a c"), (None, "a c"), (5, "c")], DOCS)
    words = indexes.analysed(docs, "doc_id", "name")
    counts = {(r.term, r.df, r.cf) for r in indexes.term_counts(words).collect()}
    assert counts == {(r.term, r.df, r.cf) for r in indexes.term_rows(indexes.posting_rows(words)).collect()}
    assert counts == {("a", 3, 4), ("b", 2, 4), ("c", 3, 5)}
    terms = indexes.build_index(docs.where("doc_id < 5"), "doc_id", "name").terms
    assert "collect_list" not in plan_of(terms, capsys).split("Initial Plan")[0]
