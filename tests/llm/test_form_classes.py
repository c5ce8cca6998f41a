from millrace.llm.queries import QUERIES


def test_queries_and_keywords_share_a_class(spark, tmp_path):
    asked = [(3, "Кezos"), (2, "Кezos"), (4, "Kezos"), (5, "kezos"), (6, None), (7, " ")]
    spark.createDataFrame(asked, "query_id long, queries string").write.parquet(f"{tmp_path}/spell_correction.parquet")
    spark.createDataFrame([(1, "Kezos"), (1, "Kezos"), (9, None), (8, "rare")], "key_id long, keys string").write.parquet(f"{tmp_path}/correctme.parquet")
    got = {r.original: r for r in QUERIES["p4_forms"](spark, str(tmp_path)).collect()}
    seen = {k: (r.form, [tuple(s) for s in r.sources], r.spellings, r.n_rows) for k, r in got.items()}
    assert seen == {
        "Кezos": ("Kezos", [("query", 2, 2)], 2, 5),
        "Kezos": ("Kezos", [("keyword", 2, 1), ("query", 1, 4)], 2, 5),
        "kezos": ("kezos", [("query", 1, 5)], 1, 1),
        " ": ("", [("query", 1, 7)], 1, 1),
        "rare": ("rare", [("keyword", 1, 8)], 1, 1),
    }
    assert got["Кezos"].class_id == got["Kezos"].class_id and len({r.class_id for r in got.values()}) == 4
