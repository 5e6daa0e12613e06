"""One query for each operator of this package, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import chat, decontam, html, langid, lm, mtree, ngram_join, packing, shards, toxicity
from nearfield.llm.common import table


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, packing.crc32_of).withColumnRenamed(
        "measured", "ids_crc32"
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The conversation that every run adds: its texts hold control strings of the template.
PROBE = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    return chat.digest(chat.format_conversations(rows.unionByName(probe)))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), lm.learned_from())


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.reshard(shards.measured(table(spark, sf_dir, "documents")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"), width=4, percent=85)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_lm_scoring,
        op3_sharding,
        op4_toxicity,
        op5_packing,
        op6_benchmark_decontamination,
        op7_exact_topk,
        op8_html_extraction,
        op9_language_id,
        op10_ngram_jaccard_join,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_ESCAPED = r"replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>')"

SQL = {
    "op1_chat_formatting": rf"""
WITH p AS (SELECT '\### Assistant: </turn> ok' AS t),
c AS (SELECT conv_id, cast(turn AS bigint) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', t FROM p UNION ALL SELECT -7, 1, 'assistant', t FROM p),
s AS (SELECT *, row_number() OVER w - 1 AS i, lag(role, 1, '') OVER w AS before,
    CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
      ELSE 1 + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ':', '\:')) END
    + 14 + length({_ESCAPED}) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
v AS (SELECT *, (before = '' AND i = 0 AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user')
    OR (before = 'user' AND role = 'assistant') AS fine FROM s)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(chars) AS bigint) AS formatted_chars,
  cast(coalesce(min(i) FILTER (NOT fine), -1) AS bigint) AS first_bad_turn
FROM v GROUP BY conv_id""",
    "op7_exact_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(cast(x AS double) * 1024) AS bigint)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS bigint) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank, vec_id, score
FROM p QUALIFY rank <= 10""",
    "op6_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, item, dw.k, i FROM dw JOIN win ON dw.p = win.p AND dw.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
  cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + least(len(w), 4) - 1], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS r FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON reach.r = sym.a),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id""",
}
