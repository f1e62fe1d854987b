import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.infill import WideIndex, infill_documents, restored, token_ends

# form and n clash with names of the result.
SCHEMA = "doc_id long, text string, n string, form string"
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def documents():
    rng = random.Random(11)
    signs = ["a", "b", " ", "\n", "\t", "é", "漢", "🙂", ".", "<", "P>", "<S>", "\x85", "\xa0", "S>"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 40))) for _ in range(400)]
    texts += ["x " * 300_000, "漢" * 100_000, " \n", "<P", "a<", "only", "<M>", "\x0b\x0c lead"]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)]
    return rows + [(900, None, None, None), (901, "", "a", "b"), (None, "no id here", "a", "b"),
                   (-5, "less than nothing", "a", "b"), rows[0], rows[0]]


def by_hand(doc_id, text, unit, rate, spm, seed):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = TOKEN.findall(text) if unit == "token" else list(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


@pytest.mark.parametrize("unit,rate,spm,seed", [
    ("token", 50, 80, 42), ("char", 100, 50, 7), ("token", 0, 80, 42), ("char", 100, 0, 1),
])
def test_outputs_are_those_by_hand(spark, unit, rate, spm, seed):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = infill_documents(df, unit, rate, spm, seed)
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted((by_hand(i, t, unit, rate, spm, seed) for i, t, *_ in rows), key=repr)
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == want
    texts = sorted(t or "" for _, t, *_ in rows)
    assert sorted(r["back"] for r in got) == texts


def test_index_holds_only_wide_characters():
    text = "aé漢🙂b" * 50
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    wide = WideIndex(data)
    assert len(wide.byte_at) == 150
    cuts = np.arange(len(text) + 1)
    want = [len(text[:c].encode()) for c in cuts]
    assert wide.to_bytes(cuts).tolist() == want
    assert wide.to_chars(np.array(want)).tolist() == cuts.tolist()
    plain = WideIndex(np.frombuffer(b"plain", dtype=np.uint8))
    assert len(plain.byte_at) == 0 and plain.to_bytes(np.arange(6)).tolist() == list(range(6))


def test_tokens_end_where_the_pattern_says():
    for text in ("", " ", "a", " a", "a ", "a b\n", "  é  漢\t"):
        at, want = 0, []
        for token in TOKEN.findall(text):
            at += len(token.encode())
            want.append(at)
        assert token_ends(np.frombuffer(text.encode(), dtype=np.uint8)).tolist() == want


def test_bytes_that_are_no_text_pass_through(spark):
    df = spark.range(40).selectExpr(
        "id AS doc_id", "cast(unhex('61FF20C3416262') AS string) AS text"
    )
    out = infill_documents(df, "token", 100)
    back = out.select(F.hex(F.encode(restored(F.col("output"), F.col("form")), "UTF-8")))
    assert {r[0] for r in df.select(F.hex(F.encode("text", "UTF-8"))).collect()} == {
        r[0] for r in back.collect()
    }


def test_empty_table_and_wrong_unit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert infill_documents(empty).collect() == []
    with pytest.raises(ValueError, match="token or char"):
        infill_documents(empty, "line")
