from tessera.plans import catalog


def test_text_only_search_takes_whole_items(spark, tmp_path):
    item = "one two three four five six seven eight"
    docs = [(1, "eight alone"), (2, "nothing of it"), (3, "seven words before eihgt"), (4, f"some {item} more"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = catalog.queries()["text_only_search"](spark, str(tmp_path)).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.rank)][0] == 4
    assert {r.doc_id for r in rows} == {1, 3, 4}
