"""Columns of users that share a name with something else that an operator reads or makes."""

from reelspark.llm import quality
from reelspark.llm.substring_dedup import without_passages


def test_a_length_that_is_no_number_plays_no_part(spark):
    rows = [(k, "good words here " * (k % 5 + 1) if k % 2 else "zz qq " * (k % 7 + 1), f"{k} characters") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    plain = {r.doc_id: r.score for r in quality.score(docs.drop("n_chars"), quality.fit(docs.drop("n_chars"), labels)).collect()}
    assert got == plain
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, s in got.items() if s >= quality.THRESHOLD)


def test_numbers_of_any_type_are_lengths(spark):
    docs = spark.createDataFrame([(k, "a b c " * k) for k in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id long, quality int")
    scores = []
    for kind in ("int", "double", "decimal(10,0)"):
        typed = docs.selectExpr("*", f"cast(length(text) as {kind}) as n_chars")
        model = quality.fit(typed, labels)
        scores.append(sorted((r.doc_id, r.score) for r in quality.score(typed, model).collect()))
        assert quality.keep_good(typed, model).count() <= 8
    assert scores[0] == scores[1] == scores[2]


def test_passages_leave_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "ab cd", 5, [1], "x"), (2, None, None, None, None), (3, "é ef", 6, [], "y")], "doc_id long, text string, __id int, __spans array<int>, passage_id string")
    passages = spark.createDataFrame([(1, 0, 3), (3, 2, 9)], "doc_id long, start int, end int")
    got = without_passages(docs, passages)
    assert got.schema == docs.schema
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(1, "cd", 5, [1], "x"), (2, None, None, None, None), (3, "é", 6, [], "y")]
