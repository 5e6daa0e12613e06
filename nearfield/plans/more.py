"""Queries over access paths, the update cycle and named indexes, with their SQL; see `catalog` for the conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.catalogue import Catalogue
from nearfield.functions import vectors as V
from nearfield.functions.dsl import Query, unparse
from nearfield.index import VectorIndex
from nearfield.operators import access as A
from nearfield.operators import clustering as C
from nearfield.operators import evaluation as E
from nearfield.operators import graph as G
from nearfield.operators import lifecycle as L
from nearfield.operators import maintenance as M
from nearfield.operators import quantization as Q
from nearfield.operators.kernels import knn, nearest_centers
from nearfield.plans.catalog import _GRAPH, _REC, NEAR, K, asked, book, centers, dot, emb, knn_sql, l2, long, query, r6, rounded


def kd_sql(depth: int) -> str:
    """CTEs r0 to r{depth} (vec_id, embedding, path) and the splits s0 to s{depth - 1}."""
    parts = ["r0 AS (SELECT vec_id, embedding, '' AS path FROM embeddings)"]
    for i in range(depth):
        parts.append(f"""f{i} AS (SELECT path, dim, avg(v) AS m, var_pop(v) AS s FROM (SELECT path, unnest(embedding)::double AS v, unnest(range(len(embedding))) AS dim FROM r{i}) GROUP BY path, dim),
s{i} AS (SELECT path, dim, m AS cut FROM f{i} QUALIFY row_number() OVER (PARTITION BY path ORDER BY s DESC, dim) = 1),
r{i + 1} AS (SELECT vec_id, embedding, path || CASE WHEN embedding[dim + 1]::double > cut THEN '1' ELSE '0' END AS path FROM r{i} JOIN s{i} USING (path))""")
    return ", ".join(parts)


@query(f"WITH {kd_sql(3)} SELECT vec_id, path FROM r3")
def kd_paths(spark: SparkSession, d: str) -> DataFrame:
    return G.kd_paths(emb(spark, d), 3)


def _walked(depth: int) -> str:
    parts = ["b0 AS (SELECT vec_id AS query_id, embedding AS q, '' AS path, 0.0::double AS bound FROM embeddings WHERE vec_id % 50 = 0)"]
    for i in range(depth):
        x = "q[dim + 1]::double"
        parts.append(f"""b{i + 1} AS (SELECT query_id, q, path || side AS path, bound + CASE WHEN ({x} > cut) = (side = '1') THEN 0.0 ELSE ({x} - cut) * ({x} - cut) END AS bound
 FROM b{i} JOIN s{i} USING (path), (VALUES ('0'), ('1')) t(side))""")
    return ", ".join(parts)


@query(f"""WITH {kd_sql(3)}, {_walked(3)}, ch AS (SELECT query_id, q, path FROM b3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bound, path) <= 3)
SELECT query_id, vec_id, rnk, round(d, 6) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rnk FROM (
 SELECT query_id, vec_id, {l2("embedding", "q")} AS d FROM ch JOIN r3 USING (path))) WHERE rnk <= 10""")
def kd_search(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(A.kd_search(e, asked(e), K, 3, 3))


def _tpt_sql() -> str:
    every = []
    for tree in range(2):
        parts = [f"t{tree}_0 AS (SELECT vec_id, embedding, '' AS leaf FROM embeddings)"]
        for level in range(3):
            weights = "[" + ", ".join(f"{w!r}::double" for w in G.random_projection(64, 0, tree, level).tolist()) + "]"
            parts.append(f"""t{tree}_{level + 1} AS (SELECT vec_id, embedding, leaf || CASE WHEN p > avg(p) OVER (PARTITION BY leaf) THEN '1' ELSE '0' END AS leaf
 FROM (SELECT *, list_sum(list_transform(list_zip(embedding, {weights}), lambda z: z[1]::double * z[2])) AS p FROM t{tree}_{level}))""")
        every.append(", ".join(parts))
    return f"WITH {', '.join(every)} " + " UNION ALL ".join(f"SELECT vec_id, {t} AS tree, leaf FROM t{t}_3" for t in range(2))


@query(_tpt_sql())
def tpt_partition(spark: SparkSession, d: str) -> DataFrame:
    return G.tpt_leaves(emb(spark, d), 64, trees=2, depth=3)


def bkt_sql(branches: int = 4, leaf: int = 64, depth: int = 4) -> str:
    """CTEs h0 to h{depth} (vec_id, embedding, path)."""
    parts = ["h0 AS (SELECT vec_id, embedding, '' AS path FROM embeddings)"]
    for i in range(depth):
        parts.append(f"""o{i} AS (SELECT path FROM h{i} GROUP BY path HAVING count(*) > {leaf}),
e{i} AS (SELECT path, embedding AS c, row_number() OVER (PARTITION BY path ORDER BY md5('{i}:' || vec_id), vec_id) AS b FROM h{i} SEMI JOIN o{i} USING (path) QUALIFY b <= {branches}),
h{i + 1} AS (SELECT vec_id, embedding, path FROM h{i} ANTI JOIN o{i} USING (path) UNION ALL SELECT vec_id, embedding, path || '/' || b FROM (
 SELECT x.vec_id, x.embedding, x.path, b FROM h{i} x JOIN e{i} y ON x.path = y.path QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY {l2("x.embedding", "y.c")}, b) = 1))""")
    return ", ".join(parts)


@query(f"WITH {bkt_sql()} SELECT vec_id, path FROM h4")
def bkt_paths(spark: SparkSession, d: str) -> DataFrame:
    return C.hierarchical(emb(spark, d), branches=4, leaf=64, depth=4)


@query("SELECT vec_id AS center_id FROM embeddings ORDER BY md5('0:' || vec_id), vec_id LIMIT (SELECT round(0.2 * count(*))::bigint FROM embeddings)")
def head_select_random(spark: SparkSession, d: str) -> DataFrame:
    return C.random_heads(emb(spark, d), 0.2).select("center_id")


_HEADS = """, z AS (SELECT path, count(*) AS size FROM h4 GROUP BY path), th AS (SELECT a, b FROM (SELECT a, b, abs(coalesce(sum(CASE WHEN size >= a THEN ceil(size / b) END), 0) - 0.2 * (SELECT count(*) FROM embeddings)) AS gap
 FROM z, range(2, 11) s(a), range(2, 65) t(b) GROUP BY a, b) ORDER BY gap, a, b LIMIT 1)
SELECT vec_id AS center_id FROM h4 JOIN z USING (path), {th} QUALIFY row_number() OVER (PARTITION BY path ORDER BY md5('0:' || vec_id), vec_id) <= ceil(size / b) AND size >= a"""


@query(f"WITH {bkt_sql()}" + _HEADS.replace("{th}", "th"))
def head_select_dynamic(spark: SparkSession, d: str) -> DataFrame:
    """Heads from the leaves of a tree, thresholds searched so that a fifth of the rows are heads."""
    return L.dynamic_heads(C.hierarchical(emb(spark, d), branches=4, leaf=64, depth=4), 0.2)


@query(f"WITH {bkt_sql()}" + _HEADS.replace("{th}", "(SELECT 3 AS a, 10 AS b)"))
def head_select_static(spark: SparkSession, d: str) -> DataFrame:
    return L.heads_by_thresholds(C.hierarchical(emb(spark, d), branches=4, leaf=64, depth=4), 3, 10)


@query("""SELECT 'delete' AS op, vec_id FROM (SELECT vec_id FROM embeddings WHERE label < 5 ORDER BY md5('0:delete:' || vec_id), vec_id LIMIT 20)
UNION ALL SELECT 'insert', vec_id FROM (SELECT vec_id FROM embeddings WHERE label >= 5 ORDER BY md5('0:insert:' || vec_id), vec_id LIMIT 20)""")
def update_trace(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return M.trace(e.filter("label < 5"), e.filter("label >= 5"), 20)


@query("SELECT op, vec_id FROM (SELECT vec_id FROM embeddings ORDER BY md5('0:' || vec_id), vec_id LIMIT 30), (VALUES ('delete'), ('insert')) t(op)")
def stress_trace(spark: SparkSession, d: str) -> DataFrame:
    return L.stress_trace(emb(spark, d), 30)


@query("""WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY md5('0:' || vec_id)) - 1 AS p FROM embeddings)
SELECT cast(floor((p - 200) / 20) + 1 AS bigint) AS day, 'insert' AS op, vec_id FROM n WHERE p >= 200 AND p < 300
UNION ALL SELECT cast(floor(p / 20) + 1 AS bigint), 'delete', vec_id FROM n WHERE p < 100""")
def steady_state(spark: SparkSession, d: str) -> DataFrame:
    """Five days of twenty deletes and inserts."""
    return L.workload(emb(spark, d), 200, 5, 20)


@query(f"SELECT query_id, vec_id, rnk, dist FROM ({knn_sql(l2('b.embedding', 'q.embedding'), '(SELECT * FROM embeddings WHERE vec_id < 16)', 4)})")
def tree_search(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(A.tree_search(e.filter("vec_id < 16"), asked(e), 4))


_TWICE = "(SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 10000, embedding FROM embeddings WHERE vec_id % 7 = 0)"


def _twice(e: DataFrame, shift: int = 10000) -> DataFrame:
    return e.unionByName(e.filter("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + shift))


@query(knn_sql(l2("b.embedding", "q.embedding"), _TWICE))
def knn_distinct_expanded(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(A.distinct_knn(_twice(e), asked(e), K))


@query(f"SELECT b.vec_id AS query_id, min(a.vec_id) AS vec_id FROM {_TWICE} a, {_TWICE} b WHERE a.embedding = b.embedding GROUP BY b.vec_id HAVING min(a.vec_id) <> b.vec_id")
def self_check(spark: SparkSession, d: str) -> DataFrame:
    """Copies under a larger id find the row that they are a copy of."""
    from nearfield.operators import search

    return search.self_check(_twice(emb(spark, d)))


@query("""SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 6) + 0.0 AS dist
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def distance_to_id(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    targets = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), (F.col("vec_id") + 1).alias("vec_id"))
    return rounded(A.distance_to(e, targets))


@query(f"""WITH {NEAR}, post AS (SELECT vec_id, center_id FROM near WHERE rnk <= 2 AND vec_id >= 16 UNION ALL SELECT center_id, center_id FROM cent),
pr AS (SELECT vec_id AS query_id, center_id FROM near WHERE vec_id % 50 = 0 AND rnk <= 4), cand AS (SELECT DISTINCT query_id, vec_id FROM pr JOIN post USING (center_id))
SELECT query_id, vec_id, rnk, round(d, 6) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rnk FROM (
 SELECT query_id, c.vec_id, {l2("b.embedding", "q.embedding")} AS d FROM cand c JOIN embeddings b ON b.vec_id = c.vec_id JOIN embeddings q ON q.vec_id = query_id)) WHERE rnk <= 10""")
def spann_search(spark: SparkSession, d: str) -> DataFrame:
    """Heads are in no list; those that are probed are candidates themselves."""
    e = emb(spark, d)
    c = centers(e)
    heads = e.filter("vec_id < 16").select(F.col("vec_id").alias("center_id"), "vec_id")
    return rounded(A.spann_search(e, nearest_centers(e.filter("vec_id >= 16"), c, 2), heads, asked(e), c, K, 4))


@query(f"""WITH {NEAR}, post AS (SELECT vec_id, center_id FROM near WHERE rnk <= 2),
pr AS (SELECT vec_id AS query_id, center_id, cast(floor((rnk - 1) / 2) + 1 AS bigint) AS page FROM near WHERE vec_id % 50 = 0 AND rnk <= 6),
f AS (SELECT query_id, page, p.vec_id FROM pr JOIN post p USING (center_id)),
n AS (SELECT query_id, page, sum(count(*)) OVER (PARTITION BY query_id ORDER BY page) >= 150 AS relaxed_mono FROM f GROUP BY query_id, page),
g AS (SELECT query_id, vec_id, min(page) AS page FROM f GROUP BY query_id, vec_id)
SELECT query_id, page, vec_id, relaxed_mono, round(d, 6) + 0.0 AS dist, row_number() OVER (PARTITION BY query_id, page ORDER BY d, vec_id) AS pos FROM (
 SELECT g.*, {l2("b.embedding", "q.embedding")} AS d FROM g JOIN embeddings b ON b.vec_id = g.vec_id JOIN embeddings q ON q.vec_id = query_id) JOIN n USING (query_id, page)""")
def spann_iterator(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    c = centers(e)
    return rounded(A.spann_pages(e, nearest_centers(e, c, 2), asked(e), c, 2, 3, 150))


@query(f"""WITH g AS ({_GRAPH}), one AS ({knn_sql(l2("b.embedding", "q.embedding"))}),
two AS (SELECT DISTINCT query_id, dst AS vec_id FROM one JOIN g ON g.src = one.vec_id ANTI JOIN one o ON o.query_id = one.query_id AND o.vec_id = dst)
SELECT query_id, 1::bigint AS page, rnk AS pos, vec_id, dist FROM one UNION ALL
SELECT query_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id), vec_id, round(d, 6) + 0.0 FROM (
 SELECT t.*, {l2("b.embedding", "q.embedding")} AS d FROM two t JOIN embeddings b ON b.vec_id = t.vec_id JOIN embeddings q ON q.vec_id = query_id)""")
def knn_from_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(A.from_nearest(e, G.exact_graph(e, 8), asked(e), K))


def _field_sql(a: int, b: int, index: int) -> str:
    return f"""SELECT q.vec_id AS query_id, b.vec_id, {index} AS i, row_number() OVER (PARTITION BY q.vec_id ORDER BY {l2(f"b.embedding[{a}:{b}]", f"q.embedding[{a}:{b}]")}, b.vec_id) AS turn
 FROM embeddings b, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY turn <= 60"""


@query(f"""WITH s AS ({_field_sql(1, 32, 0)} UNION ALL {_field_sql(33, 64, 1)}), f AS (SELECT query_id, vec_id, min((turn, i)) AS seen FROM s GROUP BY query_id, vec_id),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY seen, vec_id) <= 60),
c AS (SELECT l.query_id, l.vec_id, 0.7 * {l2("b.embedding[1:32]", "q.embedding[1:32]")} + 0.3 * {l2("b.embedding[33:64]", "q.embedding[33:64]")} AS s
 FROM l JOIN embeddings b ON b.vec_id = l.vec_id JOIN embeddings q ON q.vec_id = l.query_id)
SELECT query_id, vec_id, round(s, 6) + 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS rnk FROM c QUALIFY rnk <= 10""")
def multi_index_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two indexes read in turn until sixty rows are seen."""
    e = emb(spark, d)
    rows = e.select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    q = asked(e).select("query_id", F.slice("query", 1, 32).alias("qa"), F.slice("query", 33, 32).alias("qb"))
    return rounded(A.lock_step_scan(rows, q, {"a": "qa", "b": "qb"}, [0.7, 0.3], K, 60), "score")


def _named(dist: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS index_name, (query_id / 50)::bigint AS query_id, rnk, vec_id, dist FROM ({knn_sql(dist, f"(SELECT * FROM embeddings WHERE label % 2 = {n})", 5)}) WHERE query_id IN (0, 50)"""
        for n, name in enumerate(("even", "odd"))
    )


@query(_named(l2("b.embedding", "q.embedding")))
def query_strings(spark: SparkSession, d: str) -> DataFrame:
    """Two query strings against two named indexes."""
    e = emb(spark, d)
    named = {n: VectorIndex.build(e.filter(f"label % 2 = {k}").drop("label"), metric="l2") for k, n in enumerate(("even", "odd"))}
    rows = e.filter("vec_id IN (0, 50)").orderBy("vec_id").collect()
    texts = [unparse(Query(list(r.embedding), {"indexname": "even,odd", "resultnum": "5"})) for r in rows]
    return rounded(Catalogue(spark, named).execute(*texts)).select("index_name", "query_id", "rnk", "vec_id", "dist")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 100")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).filter("vec_id < 100").select("vec_id", "label")


@query(r"""SELECT doc_id, (i - 1)::bigint AS line, strlen(l[i]) AS length, (coalesce(list_sum(list_transform(l[1 : i - 1], lambda x: strlen(x) + 1)), 0))::bigint AS "offset"
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def metadata_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The parts of a text between line ends, with their first bytes."""
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return V.offsets(rows, "doc_id", "text")


@query(f"""WITH {NEAR}, x AS (SELECT center_id, unnest(embedding)::double AS v, unnest(range(len(embedding))) AS pos FROM near JOIN embeddings USING (vec_id) WHERE rnk = 1)
SELECT center_id, pos, cast(trunc(avg(v) * 127) AS integer) AS value FROM x GROUP BY center_id, pos""")
def rounded_centers(spark: SparkSession, d: str) -> DataFrame:
    """Means of centres as bytes: cut towards zero, as a cast does."""
    e = emb(spark, d)
    found = C.means(e, C.assign(e, centers(e))).select("center_id", F.posexplode("center").alias("pos", "x"))
    return long(found.select("center_id", "pos", (F.col("x") * 127).cast("int").alias("value")), "pos")


@query("SELECT doc_id, strlen(text) AS n, true AS same FROM documents WHERE text IS NOT NULL")
def zstd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts through a compressor with a trained dictionary, and back."""
    from nearfield.functions.compression import compressed, decompressed, trained

    rows = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text", F.col("text").cast("binary").alias("raw"))
    dictionary = trained(rows, "raw", "doc_id")
    back = decompressed(compressed(rows, "raw", dictionary), "raw", dictionary)
    return back.select("doc_id", F.octet_length("raw").cast("long").alias("n"), (F.col("raw") == F.col("text").cast("binary")).alias("same"))


@query("""WITH l AS (SELECT event_id AS seq, user_id AS key, CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'put' ELSE 'merge' END AS op, event_type AS value FROM events),
r AS (SELECT key, max(seq) AS reset FROM l WHERE op <> 'merge' GROUP BY key)
SELECT key, string_agg(value, '|' ORDER BY seq) AS value FROM l LEFT JOIN r USING (key) WHERE op <> 'delete' AND (reset IS NULL OR seq >= reset) GROUP BY key""")
def key_value_state(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_id") % 5 == 0, "delete").when(F.col("event_id") % 5 == 1, "put").otherwise("merge")
    log = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), F.col("event_type").alias("value"))
    return L.key_values(log)


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 21 = 0")
def log_replay(spark: SparkSession, d: str) -> DataFrame:
    """Deletes, and inserts of some of them again, replayed over a table."""
    e = emb(spark, d).select("vec_id", "label")
    gone = e.filter("vec_id % 7 = 0").select(F.lit(1).alias("seq"), F.lit("delete").alias("op"), "vec_id", "label")
    back = e.filter("vec_id % 21 = 0").select(F.lit(2).alias("seq"), F.lit("insert").alias("op"), "vec_id", "label")
    old = e.select(F.lit(0).alias("seq"), F.lit("delete").alias("op"), "vec_id", "label")
    return L.replayed(e, gone.unionByName(back).unionByName(old), 0)


_COMPACT = """a AS (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0), k AS (SELECT count(*) AS n FROM a),
h AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings, k WHERE vec_id % 7 = 0 AND vec_id < n),
t AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS r FROM a, k WHERE vec_id >= n),
mp AS (SELECT vec_id AS old_id, vec_id AS new_id FROM a, k WHERE vec_id < n UNION ALL SELECT t.vec_id, h.vec_id FROM h JOIN t USING (r))"""


@query(f"WITH {NEAR}, {_COMPACT} SELECT new_id AS vec_id, center_id FROM near JOIN mp ON old_id = vec_id WHERE rnk <= 2")
def spann_refine(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return L.refined(e, nearest_centers(e, centers(e), 2), e.filter("vec_id % 7 = 0"))


@query(f"WITH {NEAR}, p AS (SELECT vec_id, center_id FROM near WHERE rnk = 1 UNION ALL SELECT vec_id + 10000, center_id FROM near WHERE rnk = 1 AND vec_id % 7 = 0) SELECT center_id, count(*) AS n, count(*) > 40 AS oversize FROM p GROUP BY center_id")
def posting_append(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    lists = C.assign(e, centers(e)).select("vec_id", "center_id")
    new = lists.filter("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 10000)
    every, over, _ = L.appended(lists, new, 40)
    flags = over.withColumn("over", F.lit(True))
    return every.groupBy("center_id").agg(F.count("*").alias("n")).join(flags, "center_id", "left").select("center_id", "n", F.coalesce("over", F.lit(False)).alias("oversize"))


@query(f"WITH {NEAR} SELECT label % 16 AS center_id, count(*) AS n, count(*) FILTER (label % 16 <> center_id) AS broken FROM near WHERE rnk = 1 GROUP BY 1")
def broken_assumption(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    found = L.broken_assumption(e.select("vec_id", (F.col("label") % 16).alias("center_id")), e, centers(e))
    return found


@query("SELECT count(*) + (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0) AS rows, count(*) + (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0) AS vectors, 0::bigint AS over_limit FROM embeddings")
def maintain_cycle(spark: SparkSession, d: str) -> DataFrame:
    """After appends, moves, splits and merges every row is in one list and no list is over its limit. Appended rows have
    ids of their own: 10,000 is added, or what goes beyond the largest id of a larger table."""
    e = emb(spark, d)
    shift = max(10000, (e.agg(F.max("vec_id")).first()[0] or 0) + 1)
    lists = C.assign(e, centers(e)).select("vec_id", "center_id")
    new = lists.filter("vec_id % 7 = 0").select((F.col("vec_id") + shift).alias("vec_id"), (F.col("center_id") + F.when(F.col("vec_id") % 2 == 0, 900).otherwise(0)).alias("center_id"))
    done = L.maintained(lists, new, _twice(e, shift), 200, 20, rounds=8)
    sizes = done.groupBy("center_id").count()
    over = sizes.filter("count > 200").agg(F.count("*").alias("over_limit"))
    return done.agg(F.count("*").alias("rows"), F.count_distinct("vec_id").alias("vectors")).join(F.broadcast(over))


@query(f"""WITH {NEAR}, p AS (SELECT vec_id, center_id FROM near WHERE rnk = 1), z AS (SELECT center_id, count(*) AS n FROM p GROUP BY center_id)
SELECT (SELECT count(*) FROM p) AS rows, (SELECT count(*) FROM p) AS vectors, greatest(80, (SELECT max(n) FROM z)) AS most_allowed, true AS fits""")
def merge_small(spark: SparkSession, d: str) -> DataFrame:
    """No row is lost, and a list that took others in stays under the limit."""
    e = emb(spark, d)
    table = e.filter("vec_id < 16").select(F.col("vec_id").alias("center_id"), F.col("embedding").alias("center"))
    before = C.assign(e, centers(e)).select("vec_id", "center_id")
    after = M.merge_small(before, table, 25, 80)
    largest = before.groupBy("center_id").count().agg(F.greatest(F.lit(80), F.max("count")).alias("most_allowed"))
    sizes = after.groupBy("center_id").count().agg(F.max("count").alias("most"))
    total = after.agg(F.count("*").alias("rows"), F.count_distinct("vec_id").alias("vectors"))
    both = total.join(F.broadcast(largest)).join(F.broadcast(sizes))
    return both.select("rows", "vectors", "most_allowed", (F.col("most") <= F.col("most_allowed")).alias("fits"))


@query(f"WITH {NEAR}, z AS (SELECT center_id, count(*) AS n FROM near WHERE rnk = 1 GROUP BY center_id) SELECT (SELECT count(*) FROM embeddings) AS rows, (SELECT count(*) FROM z WHERE n > 40) AS new_lists, (SELECT count(*) FROM z WHERE n <= 40) AS kept_lists")
def split_oversize(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    before = C.assign(e, centers(e))
    after = M.split(before, e, 40, 1000)
    sizes = before.groupBy("center_id").count().filter("count <= 40").select("center_id")
    kept = after.join(sizes, "center_id").agg(F.count_distinct("center_id").alias("kept_lists"))
    new = F.count_distinct(F.when(F.col("center_id") >= 1000, F.col("center_id"))).alias("new_lists")
    return after.agg(F.count_distinct("vec_id").alias("rows"), new).join(F.broadcast(kept))


@query("SELECT count(*) AS rows, 16::bigint AS lists, true AS fits FROM embeddings")
def hard_capacity_assign(spark: SparkSession, d: str) -> DataFrame:
    """Every row has one place and no centre more than its limit."""
    e = emb(spark, d)
    limit = -(-e.count() // 16) + 8
    sizes = C.capacity_assign(e, centers(e), limit).groupBy("center_id").count()
    return sizes.agg(F.sum("count").alias("rows"), F.count("*").alias("lists"), (F.max("count") <= limit).alias("fits"))


@query("SELECT count(*) AS rows, 8::bigint AS lists, true AS better FROM embeddings")
def kmeans_train(spark: SparkSession, d: str) -> DataFrame:
    """Eight centres that are nearer to their rows than those it began with."""
    from nearfield.operators.kernels import collected_centers

    e = emb(spark, d)
    first = C.assign(e, collected_centers(C.initial_centers(e, 8))).agg(F.sum("dist").alias("first"))
    found = C.assign(e, C.kmeans(e, 8, factor=0.0, rounds=8).centers)
    own = found.agg(F.count("*").alias("rows"), F.count_distinct("center_id").alias("lists"), F.sum("dist").alias("total"))
    return own.join(F.broadcast(first)).select("rows", "lists", (F.col("total") < F.col("first")).alias("better"))


@query("SELECT count(*) AS rows, true AS better FROM embeddings")
def pq_train(spark: SparkSession, d: str) -> DataFrame:
    """A trained codebook reconstructs better than one of whole rows."""
    e = emb(spark, d)
    error = lambda b: Q.encode(e, b, keep=("embedding",)).select(V.l2("embedding", Q.reconstructed("codes", Q.literal(b))).alias("x"))
    plain = error(book(e)).agg(F.sum("x").alias("plain"))
    own = error(Q.train(e, 16, 16)).agg(F.count("*").alias("rows"), F.sum("x").alias("total"))
    return own.join(F.broadcast(plain)).select("rows", (F.col("total") < F.col("plain")).alias("better"))


@query("SELECT count(*) AS queries, true AS found FROM embeddings WHERE vec_id % 50 = 0")
def graph_walk(spark: SparkSession, d: str) -> DataFrame:
    """A walk finds nine tenths of the true neighbours at least. Of copies one has edges; the walk knows the others."""
    e = emb(spark, d)
    per = E.recall(G.walk(G.exact_graph(G.distinct(e), 16), e, asked(e), K), knn(e, asked(e), K), K)
    return per.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("found"))


@query("SELECT count(*) AS nodes, 0::bigint AS loops, 0::bigint AS wrong, true AS bounded FROM embeddings")
def graph_refine(spark: SparkSession, d: str) -> DataFrame:
    """Every row has edges, at most eight, none to itself, each with its true distance."""
    e = emb(spark, d)
    leaves = G.tpt_leaves(e, 64, trees=2, depth=3, leaf_rows=2000)
    edges = G.refined(G.leaf_graph(e, leaves, 8, 2000), e, 16, 8)
    left, right = e.select(F.col("vec_id").alias("src"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("y"))
    checked = edges.join(left, "src").join(right, "dst")
    wrong = F.sum(F.when(F.abs(V.l2("x", "y") - F.col("dist")) > 1e-6, 1).otherwise(0)).alias("wrong")
    loops = F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(0)).alias("loops")
    return checked.agg(F.count_distinct("src").alias("nodes"), loops, wrong, (F.max("pos") <= 8).alias("bounded"))


@query(f"SELECT min(nprobe) AS nprobe FROM (SELECT nprobe, avg(recall) AS mean FROM ({_REC} SELECT nprobe, recall FROM per) GROUP BY nprobe) WHERE mean >= 0.5")
def auto_tune(spark: SparkSession, d: str) -> DataFrame:
    """The least budget that reaches a recall."""
    from nearfield.plans.catalog import QUERIES

    return E.least_budget(QUERIES["param_sweep"](spark, d), "nprobe", 0.5)


@query("""WITH s AS (SELECT event_type, value, ts, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, max(value) FILTER (i = floor(n * 0.95)) AS p95,
 max(value) FILTER (i = floor(n * 0.99)) AS p99, round(count(*) / greatest(1e-6, epoch(max(ts)) - epoch(min(ts))), 9) AS per_second FROM s GROUP BY event_type""")
def latency_report(spark: SparkSession, d: str) -> DataFrame:
    found = E.latency(spark.read.parquet(f"{d}/events.parquet"), "value", "ts", "event_type")
    return found.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6), "per_second": F.round("per_second", 9)})


@query(f"SELECT * EXCLUDE (d), d > max(d) FILTER (rnk <= 8) OVER (PARTITION BY query_id) AS relaxed_mono FROM ({knn_sql(l2('b.embedding', 'q.embedding'), k=16, extra=', d')})")
def knn_relaxed_monotone(spark: SparkSession, d: str) -> DataFrame:
    """Rows popped beyond the worst of the eight best."""
    from nearfield.operators import search

    e = emb(spark, d)
    return rounded(search.relaxed(knn(e, asked(e), 16), 128))


@query(f"""SELECT vec_id, round({dot('x', 'y')}, 6) + 0.0 AS similarity, round((1.0 - {dot('x', 'y')}) * 16129, 4) + 0.0 AS byte_distance FROM (
 SELECT vec_id, embedding AS x, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings) WHERE y IS NOT NULL""")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each row and the next of its label, and its distance on the byte scale; vectors have length one."""
    from pyspark.sql import Window

    pair = emb(spark, d).withColumn("y", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("y IS NOT NULL")
    similarity = V.similarity_of(V.cosine("embedding", "y"))
    byte = F.round(V.distance_of(similarity, V.BASE["byte"]), 4) + F.lit(0.0)
    return pair.select("vec_id", r6(similarity).alias("similarity"), byte.alias("byte_distance"))
