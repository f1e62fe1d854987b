"""The registered queries of these operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quire.llm import langid, lm, toxicity
from quire.llm.bestfit import pack_whole_documents
from quire.llm.decontaminate import decontaminate
from quire.llm.fuzzylines import deduplicate_similar_lines
from quire.llm.infill import infill_documents, restored
from quire.llm.packing import pack_documents
from quire.llm.pii import personal_data
from quire.llm.simhash import near_duplicates
from quire.llm.syncmers import compare_edited
from quire.llm.trie import prefix_trie
from quire.llm.warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int):
    """crc32 of the id's text, modulo `by`."""
    return F.crc32(F.col("doc_id").cast("string")) % by


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(4) == 2
    model = langid.learn(docs.filter(~held_out))
    return langid.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(3) == 1
    model = toxicity.learn(docs, labels.filter(~held_out))
    return toxicity.score_documents(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(7) == 2
    counts, model = lm.learn(docs.filter(~held_out))
    return lm.score_texts(docs, counts, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_similar_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text"
    )


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    return prefix_trie(
        table(spark, sf_dir, "conversations"),
        base=conv_id - conv_id % 5,
        head=F.crc32(conv_id.cast("string")) % 9,
    )


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill_documents(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_whole_documents(table(spark, sf_dir, "documents"), with_ids=False)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_pii, op2_language, op3_decontamination, op4_toxicity, op5_packing,
        op6_language_model, op7_simhash, op8_lines, op9_syncmers, op10_warc,
        op11_prefix_trie, op12_infill, op13_best_fit,
    )
    return {fn.__name__: fn for fn in own}


OP3 = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width,
    array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p
        FROM i WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM iw),
dw AS (
  SELECT doc_id, width, p, array_to_string(list_slice(w, p, p + width - 1), ' ') AS win
  FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS p
        FROM d, widths WHERE len(w) >= width)),
m AS (SELECT doc_id, p, width, item_id FROM dw JOIN iw USING (width, win)),
pos AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(p, p + width - 1)) AS q FROM m) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP10 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
    max(page_id) OVER (PARTITION BY sha1(h), strlen(h)) AS answer
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND answer <> page_id THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 1000 AND answer <> page_id THEN answer END AS refers_to,
  true AS complete
FROM q
"""

# crc32 bit by bit: eight steps a character, over at most 20 characters.
OP11 = """
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS step, CAST(4294967295 AS BIGINT) AS v
  FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT conv_id, s, step + 1,
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
  FROM (SELECT conv_id, s, step,
    CASE WHEN step % 8 = 0 THEN xor(v, CAST(ascii(s[step // 8 + 1]) AS BIGINT)) ELSE v END AS x
    FROM crc WHERE step < 8 * length(s))),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM crc WHERE step = 8 * length(s)),
r AS (
  SELECT c.conv_id, t.p AS o, 0 AS k, role, text FROM c JOIN t ON t.conv_id = c.base AND t.p <= h
  UNION ALL
  SELECT c.conv_id, t.p AS o, 1 AS k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > h),
n AS (
  SELECT conv_id, row_number() OVER w AS depth, text,
    sha256(string_agg(sha256(role) || sha256(text), '') OVER w) AS key,
    count(*) OVER (PARTITION BY conv_id) AS whole
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k, o)),
m AS (
  SELECT conv_id, depth, key, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS up,
    CAST(strlen(text) AS BIGINT) AS size, depth = whole AS ends FROM n
  UNION ALL
  SELECT conv_id, 0, '', NULL, 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
nodes AS (
  SELECT depth, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * min(size) AS saved, count(*) FILTER (ends) = count(*) AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY depth, key),
above AS (
  SELECT a.depth, a.key, b.saved, b.leaf FROM nodes b JOIN m x ON x.conv_id = b.conv_id
    AND x.depth <= b.depth JOIN nodes a ON a.depth = x.depth AND a.key = x.key),
sums AS (
  SELECT depth, key, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
  FROM above GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL)
SELECT nodes.conv_id, depth, parent.conv_id AS parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes JOIN sums USING (depth, key) LEFT JOIN kids USING (depth, key)
LEFT JOIN (SELECT depth + 1 AS depth, key AS up, conv_id FROM nodes) AS parent USING (depth, up)
"""

OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''),
      '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n,
    [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h FROM d),
p AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(list_slice(w, 1, least(h[1] % (n + 1), h[2] % (n + 1))), '') AS a,
    array_to_string(list_slice(w, least(h[1] % (n + 1), h[2] % (n + 1)) + 1,
      greatest(h[1] % (n + 1), h[2] % (n + 1))), '') AS m,
    array_to_string(list_slice(w, greatest(h[1] % (n + 1), h[2] % (n + 1)) + 1, n), '') AS s
  FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

SQL = {
    "op3_decontamination": OP3, "op10_warc": OP10,
    "op11_prefix_trie": OP11,
    "op12_infill": OP12,
}
