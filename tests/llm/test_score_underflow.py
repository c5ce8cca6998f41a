from millrace.llm import queries


def test_a_score_of_zero_drops_no_row_of_the_exact_rule(spark, rows, monkeypatch):
    scored = spark.createDataFrame([(1, "x", 1, 5, 2, 100, 0.0), (2, "x", 900, 900, 2, 100, 1.0), (3, "y", 1, 6, 2, 100, 0.0)], "docno long, term string, tf long, total long, df long, records long, score double")
    monkeypatch.setattr(queries, "load", lambda *_: None)
    monkeypatch.setattr(queries, "distinctive_terms", lambda _: scored)
    assert rows(queries.p3_found(spark, "")) == [(1, "x"), (2, "x")]
