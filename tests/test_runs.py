import pytest
from pyspark.sql import functions as F

from quire.plans import panel
from quire.plans.runs import Runs, content_key


def table(spark, rows):
    return spark.createDataFrame(rows, "k bigint, v string")


def test_key_follows_the_rows_and_nothing_else(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "c")]
    one = table(spark, rows)
    key = content_key(one)
    assert content_key(table(spark, rows[::-1]).repartition(3)) == key
    assert content_key(one.select("v", "k")) == key
    others = [rows[:3], rows + rows[:1], [*rows[:3], (3, "d")], []]
    assert len({key, *(content_key(table(spark, r)) for r in others)}) == 5
    assert content_key(one.withColumnRenamed("v", "w")) != key


def test_stages_run_once_for_the_same_inputs(spark, tmp_path):
    calls = []

    def double(rows, by):
        calls.append(by)
        return rows.withColumn("k", F.col("k") * by)

    def flow(rows, by):
        runs = Runs(spark, str(tmp_path))
        first = runs.stage("first", double, runs.source(rows), by=by)
        second = runs.stage("second", lambda rows: rows.where("k > 2"), first)
        return runs.ran, sorted(r.k for r in second.rows.collect())

    rows = table(spark, [(1, "a"), (2, "b")])
    assert flow(rows, 2) == (["first", "second"], [4])
    assert flow(rows.repartition(2), 2) == ([], [4])
    assert flow(rows, 3) == (["first", "second"], [3, 6])
    assert flow(table(spark, [(5, "a")]), 2) == (["first", "second"], [10])
    assert calls == [2, 3, 2]


def test_a_stage_that_broke_off_is_written_anew(spark, tmp_path):
    rows = table(spark, [(1, "a")])

    def broken(rows):
        rows.write.mode("append").parquet(f"{tmp_path}/half")
        return rows.withColumn("k", F.raise_error(F.lit("broken off")).cast("bigint"))

    runs = Runs(spark, str(tmp_path / "runs"))
    kept = runs.stage("kept", lambda r: r, runs.source(rows))
    with pytest.raises(Exception, match="broken off"):
        runs.stage("late", broken, kept)
    again = Runs(spark, str(tmp_path / "runs"))
    kept = again.stage("kept", lambda r: r, again.source(rows))
    late = again.stage("late", lambda r: r, kept)
    assert again.ran == ["late"] and late.rows.count() == 1


def test_panel_goes_on_after_extraction(spark, tmp_path):
    uploads = spark.createDataFrame(
        [(1, "a.pdf", "application/pdf", 100), (2, "b.exe", "", 5)],
        "doc_id bigint, file_name string, mime_type string, size_bytes bigint",
    )
    text = "A readable page of text with several ordinary words in it, and one more."
    pages = spark.createDataFrame([(1, 1, text)], "doc_id bigint, page_number int, text string")
    none = pages.where("false")
    images = none.select("doc_id", "text")
    down = {"on": True}

    def complete(asked):
        if down["on"]:
            raise ConnectionError("the model is down")
        payload = F.to_json(F.struct(F.lit("ok").alias("summary")))
        return asked.select(
            "request_id", "attempt", F.lit(200).alias("status"),
            F.to_json(F.struct(F.array(F.struct(
                F.lit("stop").alias("finish_reason"), F.struct(payload.alias("content")).alias("message")
            )).alias("choices"))).alias("body"), "json_mode",
        )

    def run(length):
        runs = Runs(spark, str(tmp_path))
        try:
            return runs.ran, panel.panel_run(runs, uploads, pages, none, images, length, complete, "t").rows.collect()
        except ConnectionError:
            return runs.ran, None

    assert run("short") == (["extract", "summarize"], None)
    down["on"] = False
    ran, rows = run("short")
    assert ran == ["summarize", "entries"] and [r.summary.summary for r in rows] == ["ok"]
    assert run("short")[0] == []
    assert run("long")[0] == ["summarize", "entries"]
