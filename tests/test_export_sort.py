from quire.sources.tables import OPEN_FILES, write_exports


def test_exports_are_written_without_sorting_texts(spark, tmp_path):
    rows = [(i, ("txt", "md")[i % 2], f"f{i}", f"text {i}\n") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, format string, file_name string, content string")
    before, path = spark.conf.get(OPEN_FILES), str(tmp_path / "exports")
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    write_exports(table.repartition(3), path)
    runs = [store.executionsList().apply(i) for i in range(seen, store.executionsCount())]
    plans = [r.physicalPlanDescription() for r in runs]
    assert any("InsertIntoHadoopFsRelation" in p for p in plans)
    assert not any("Sort" in p for p in plans)
    read = spark.read.parquet(path).select("doc_id", "format", "file_name", "content").collect()
    assert sorted(map(tuple, read)) == rows
    assert spark.conf.get(OPEN_FILES) == before
