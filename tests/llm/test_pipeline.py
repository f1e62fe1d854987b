"""The corpus pipeline on planted cases, and its registration."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quire.llm import queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randrange(3, 9))) for _ in range(900)]

    def prose(k):
        return " ".join(rng.choices(words, k=k))

    folder = tmp_path_factory.mktemp("corpus")
    docs, labels = {}, []
    for i in range(700):
        bad = i % 7 == 0
        text = prose(60).split()
        for _ in range(4 * bad):
            text.insert(rng.randrange(len(text)), "vileword")
        docs[i] = " ".join(text[:30]) + "\n" + " ".join(text[30:])
        labels.append((i, int(bad), int(bad)))
    passage = prose(70)
    for i in range(1000, 1020):
        docs[i] = prose(40) + "\n" + passage + "\n" + prose(40)
    for i in range(1100, 1120):
        docs[i] = docs[1]  # exact copies
    items = [(i, prose(30)) for i in range(20)]
    for i in range(1200, 1210):
        docs[i] = prose(50) + " " + items[i - 1200][1] + " " + prose(20)
    docs[1300], docs[1301] = None, ""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return docs, passage, str(folder)


def test_stages_catch_what_is_planted(spark, corpus):
    docs, passage, folder = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        frame.write.parquet(f"{folder}/out/{name}")
        frame = spark.read.parquet(f"{folder}/out/{name}")
        if name != "packing":
            assert frame.columns == columns
            seen[name] = {r["doc_id"]: r for r in frame.collect()}
    toxic = {i for i in range(700) if i % 7 == 0}
    assert set(docs) - set(seen["toxicity"]) == toxic
    lines = seen["line_dedup"]
    assert set(lines) == set(seen["toxicity"])
    assert [i for i, r in lines.items() if passage in (r["text"] or "")] == [1000]
    assert all(r["n_chars"] == len(r["text"] or "") for r in lines.values())
    assert all(lines[i]["text"] == "" for i in range(1100, 1120))
    assert all(lines[i]["text"] == docs[i] for i in range(700) if i % 7)
    near = set(seen["near_duplicates"])
    assert near == set(lines) - set(range(1101, 1120)) - {1300, 1301}
    assert near - set(seen["decontamination"]) == set(range(1200, 1210))
    packed = {r["doc_id"] for r in frame.select("doc_id").distinct().collect()}
    assert packed == set(seen["decontamination"])


def test_run_applies_the_stages(spark, corpus):
    _, _, folder = corpus
    got = corpus_pipeline.run(spark, folder)
    want = spark.read.parquet(f"{folder}/out/packing")
    assert sorted(got.drop("sequence_id", "offset").collect()) == sorted(
        want.drop("sequence_id", "offset").collect()
    )


def test_every_operator_is_registered():
    names = list(queries.registered())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert {"pipeline", *names} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    from pathlib import Path

    import duckdb

    from check import rows_of

    folder = Path("/root/testdata/sf0.001")
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.registered()[name](spark, str(folder))
    cur = con.execute(queries.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())
