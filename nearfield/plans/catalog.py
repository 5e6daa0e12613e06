"""Queries over the test tables, one for each operator, and DuckDB SQL that gives the same rows.

Queries are the rows whose id is divisible by 50; deleted rows those divisible by 7; fixed centres the rows below 16,
and a codebook of 16 sub-spaces is their parts. Distances are rounded to six digits, and 0.0 is added against -0.0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import clustering as C
from nearfield.operators import evaluation as E
from nearfield.operators import graph as G
from nearfield.operators import maintenance as M
from nearfield.operators import quantization as Q
from nearfield.operators import search as S
from nearfield.operators.kernels import collected_centers, knn, nearest_centers

K = 10
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{{", "{").replace("}}", "}") if "{{" in sql else sql
        return f

    return add


def emb(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def asked(e: DataFrame) -> DataFrame:
    return e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def centers(e: DataFrame) -> C.Centers:
    return collected_centers(e.filter("vec_id < 16").select(F.col("vec_id").alias("center_id"), F.col("embedding").alias("center")))


def book(e: DataFrame) -> np.ndarray:
    return Q.codebook_of(centers(e)[1], 16)


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names or ("dist",)})


def long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- SQL pieces -----------------------------------------------------------------------------------------------------


def l2(x: str, y: str) -> str:
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"


def dot(x: str, y: str) -> str:
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1]::double * z[2]::double))"


def cos(x: str, y: str) -> str:
    return f"(1.0 - {dot(x, y)})"


def knn_sql(dist: str, rows: str = "embeddings", k: int = K, extra: str = "") -> str:
    return f"""SELECT query_id, vec_id, rnk, dist{extra} FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rnk, round(d, 6) + 0.0 AS dist FROM (
  SELECT q.vec_id AS query_id, b.*, {dist} AS d FROM {rows} b, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rnk <= {k}"""


CENT = "cent AS (SELECT vec_id AS center_id, embedding AS c FROM embeddings WHERE vec_id < 16)"
NEAR = f"""{CENT}, near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, center_id) AS rnk FROM (
 SELECT vec_id, center_id, label, {l2("embedding", "c")} AS d FROM embeddings, cent))"""

# --- S1: scalars ----------------------------------------------------------------------------------------------------


def _pairwise(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Each row against the next one of its label."""
        e = emb(spark, d)
        order = Window.partitionBy("label").orderBy("vec_id")
        pair = e.select("vec_id", "embedding", F.lead("embedding").over(order).alias("other")).filter("other IS NOT NULL")
        return pair.select("vec_id", r6(V.METRICS[metric](F.col("embedding"), F.col("other"))).alias("dist"))

    return run


def _pairwise_sql(dist: str) -> str:
    return f"""SELECT vec_id, round({dist}, 6) + 0.0 AS dist FROM (
 SELECT vec_id, embedding AS x, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings) WHERE y IS NOT NULL"""


for _name, _metric, _dist in (("dist_l2", "l2", l2("x", "y")), ("dist_cosine", "cosine", cos("x", "y")), ("dist_inner_product", "ip", cos("x", "y"))):
    QUERIES[_name], SQL[_name] = _pairwise(_metric), _pairwise_sql(_dist)


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_extendedprice, l_discount, l_tax] AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round(n[1], 6) + 0.0 AS a, round(n[2], 6) + 0.0 AS b, round(n[3], 6) + 0.0 AS c, round(n[4], 6) + 0.0 AS d
FROM (SELECT l_orderkey, l_linenumber, list_transform(x, lambda e: e / sqrt({dot("x", "x")})) AS n FROM v)""")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as vectors of length one."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    x = V.normalized(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    rows = rows.select("l_orderkey", "l_linenumber", x.alias("x"))
    return rows.select("l_orderkey", "l_linenumber", *[r6(F.col("x")[k]).alias(n) for k, n in enumerate("abcd")])


@query(f"""WITH t AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings WHERE vec_id % 7 = 0)
SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a, t b WHERE a.vec_id % 50 = 0 AND {l2("a.embedding", "b.embedding")} < 1e-6""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    again = e.filter("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return S.within(e.unionByName(again), asked(e), V.SAME).select("query_id", "vec_id")


@query("""SELECT vec_id, cast(len(embedding) AS bigint) AS n, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) + 0.0 AS total FROM embeddings""")
def parse_vector_text(spark: SparkSession, d: str) -> DataFrame:
    """Vectors to text and back."""
    e = emb(spark, d).select("vec_id", V.formatted("embedding").alias("t")).select("vec_id", V.parsed("t").alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return e.select("vec_id", F.size("x").cast("long").alias("n"), (F.round(total, 5) + 0.0).alias("total"))


@query("SELECT doc_id, base64(encode(text)) AS b64, cast(strlen(text) AS bigint) AS n FROM documents")
def base64_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.base64(F.encode("text", "utf-8")).alias("b64"))
    # Spark breaks lines after 76 characters unless told not to
    plain = F.regexp_replace("b64", r"\s", "")
    return rows.select("doc_id", plain.alias("b64"), F.octet_length(F.unbase64(plain)).cast("long").alias("n"))


@query("""SELECT event_id, cast(list_reduce(list_transform(range(0, cast(length(h) / 2 AS bigint)), lambda i: cast('0x' || substr(h, cast(2 * i + 1 AS bigint), 2) AS integer)),
 lambda a, b: xor(a, b)) AS integer) AS checksum FROM (SELECT event_id, hex(encode(event_type || event_id)) AS h FROM events)""")
def xor_checksum(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", V.checksum(F.encode(F.concat("event_type", F.col("event_id").cast("string")), "utf-8")).alias("checksum"))


@query("""WITH s AS (SELECT vec_id, embedding AS x, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings),
p AS (SELECT vec_id, x, y, list_filter(range(64), lambda i: x[i + 1] > 0) AS a, list_filter(range(64), lambda i: y[i + 1] > 0) AS b FROM s WHERE y IS NOT NULL)
SELECT vec_id, cast(list_sum(list_transform(range(64), lambda i: CASE WHEN (x[i + 1] > 0) <> (y[i + 1] > 0) THEN 1 ELSE 0 END)) AS integer) AS hamming,
 round(1.0::double - len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))), 6) + 0.0 AS jaccard FROM p""")
def set_distances(spark: SparkSession, d: str) -> DataFrame:
    """The signs of each row's components as bits and as a set, against the next row of its label."""
    pair = emb(spark, d).withColumn("y", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("y IS NOT NULL")
    bits = lambda c: F.transform(c, lambda v: v > 0)
    places = lambda c: F.filter(F.transform(c, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    return pair.select(
        "vec_id", V.hamming(bits("embedding"), bits("y")).alias("hamming"), r6(V.jaccard(places("embedding"), places("y"))).alias("jaccard")
    )


@query("SELECT event_id, event_type FROM events WHERE event_id >= 100 ORDER BY event_id LIMIT 50")
def key_range_scan(spark: SparkSession, d: str) -> DataFrame:
    from nearfield.sources.formats import key_range

    return key_range(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"), "event_id", 100, 50)


# --- S2: exact search -----------------------------------------------------------------------------------------------


@query(knn_sql(l2("b.embedding", "q.embedding")))
def exact_knn_l2(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(knn(e, asked(e), K))


@query(knn_sql(cos("b.embedding", "q.embedding")))
def exact_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(knn(e, asked(e), K, "cosine"))


@query(knn_sql(cos("b.embedding", "q.embedding")))
def exact_knn_ip(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(knn(e, asked(e), K, "ip"))


@query(knn_sql(l2("b.embedding", "q.embedding"), "(SELECT * FROM embeddings WHERE label IN (1, 3))"))
def knn_filtered_label(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(S.filtered_knn(e, asked(e), K, F.col("label").isin(1, 3)))


@query(knn_sql(l2("b.embedding", "q.embedding"), extra=", label"))
def knn_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(S.with_payload(knn(e, asked(e), K), e.select("vec_id", "label")))


@query(knn_sql(l2("b.embedding", "q.embedding"), "(SELECT * FROM embeddings WHERE vec_id % 7 <> 0)"))
def knn_excluding_deleted(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(knn(S.live(e, e.filter("vec_id % 7 = 0")), asked(e), K))


@query(f"SELECT * FROM ({knn_sql(l2('b.embedding', 'q.embedding'), k=20)}) WHERE rnk > 10")
def knn_page_2(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(S.page(e, asked(e), 10, 2))


_TWO = f"""SELECT *, 'even' AS index_name FROM ({knn_sql(l2('b.embedding', 'q.embedding'), "(SELECT * FROM embeddings WHERE label % 2 = 0)")})
UNION ALL SELECT *, 'odd' FROM ({knn_sql(l2('b.embedding', 'q.embedding'), "(SELECT * FROM embeddings WHERE label % 2 = 1)")})"""


def _two(e: DataFrame) -> DataFrame:
    return S.multi_index({"even": e.filter("label % 2 = 0"), "odd": e.filter("label % 2 = 1")}, asked(e), K)


@query(_TWO)
def knn_multi_index_union(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_two(emb(spark, d)))


@query(f"SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY dist, index_name, vec_id) AS rnk) FROM ({_TWO}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, index_name, vec_id) <= 10")
def knn_global_merge(spark: SparkSession, d: str) -> DataFrame:
    return S.merged(rounded(_two(emb(spark, d))), K)


@query(f"""SELECT q.vec_id AS query_id, b.vec_id, round({l2("b.embedding", "q.embedding")}, 6) + 0.0 AS dist FROM embeddings b, embeddings q
WHERE q.vec_id % 50 = 0 AND {l2("b.embedding", "q.embedding")} < 1.2""")
def range_search(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(S.within(e, asked(e), 1.2))


# --- S3: rank join --------------------------------------------------------------------------------------------------


@query(f"""SELECT query_id, vec_id, rnk, round(s, 6) + 0.0 AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS rnk FROM (
  SELECT q.vec_id AS query_id, b.vec_id, {l2("b.embedding[1:32]", "q.embedding[1:32]")} * 0.7 + {l2("b.embedding[33:64]", "q.embedding[33:64]")} * 0.3 AS s
  FROM embeddings b, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rnk <= 10""")
def multi_vector_weighted_topk(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    rows = e.select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    q = asked(e).select("query_id", F.slice("query", 1, 32).alias("qa"), F.slice("query", 33, 32).alias("qb"))
    return rounded(S.rank_join(rows, q, {"a": "qa", "b": "qb"}, [0.7, 0.3], K), "score")


# --- S4: evaluation -------------------------------------------------------------------------------------------------

_IVF = f"""WITH {NEAR}, post AS (SELECT vec_id, center_id FROM near WHERE rnk <= 2),
pr AS (SELECT vec_id AS query_id, center_id, rnk AS prnk FROM near WHERE vec_id % 50 = 0),
truth AS ({knn_sql(l2("b.embedding", "q.embedding"))}),
par AS (SELECT unnest([1, 2, 4]) AS nprobe),
cand AS (SELECT DISTINCT nprobe, query_id, vec_id FROM par JOIN pr ON prnk <= nprobe JOIN post USING (center_id)),
sc AS (SELECT nprobe, query_id, c.vec_id, {l2("b.embedding", "q.embedding")} AS d FROM cand c JOIN embeddings b ON b.vec_id = c.vec_id JOIN embeddings q ON q.vec_id = query_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY nprobe, query_id ORDER BY d, vec_id) AS rnk FROM sc QUALIFY rnk <= 10)"""


def _hits(e: DataFrame, nprobe: int) -> DataFrame:
    c = centers(e)
    return C.ivf_search(e, nearest_centers(e, c, 2), asked(e), c, K, nprobe)


@query(f"{_IVF} SELECT query_id, rnk, vec_id, round(d, 6) + 0.0 AS dist FROM hits WHERE nprobe = 4")
def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_hits(emb(spark, d), 4))


_REC = f"""{_IVF}, per AS (SELECT par.nprobe, t.query_id, count(h.vec_id) / count(*) AS recall FROM par, truth t
 LEFT JOIN hits h ON h.nprobe = par.nprobe AND h.query_id = t.query_id AND h.vec_id = t.vec_id GROUP BY ALL)"""


@query(f"{_REC} SELECT query_id, round(recall, 6) + 0.0 AS recall FROM per WHERE nprobe = 2")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(E.recall(_hits(e, 2), knn(e, asked(e), K), K), "recall")


@query(f"{_REC} SELECT nprobe, round(avg(recall), 6) + 0.0 AS mean, round(stddev_pop(recall), 6) + 0.0 AS std, min(recall) AS min, max(recall) AS max FROM per GROUP BY nprobe")
def param_sweep(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    c = centers(e)
    hits = C.ivf_sweep(e, nearest_centers(e, c, 2), asked(e), c, K, (1, 2, 4))
    return rounded(E.sweep_summary(hits, knn(e, asked(e), K), (1, 2, 4)), "mean", "std")


@query(f"""{_IVF}, one AS (SELECT * FROM hits WHERE nprobe = 1)
SELECT t.query_id, round(coalesce(1.0::double / h.rnk, 0.0::double), 6) + 0.0 AS rr FROM (SELECT * FROM truth WHERE rnk = 1) t
LEFT JOIN one h ON h.query_id = t.query_id AND h.vec_id = t.vec_id""")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(E.reciprocal_rank(_hits(e, 1), knn(e, asked(e), K), K), "rr")


@query(f"""{_IVF}, w AS (SELECT query_id, max(dist) AS worst, count(*) AS wanted FROM truth GROUP BY query_id)
SELECT h.query_id, round(least(sum(CASE WHEN h.d <= worst + 0.001 THEN 1 ELSE 0 END), max(wanted)) / max(wanted), 6) + 0.0 AS recall
FROM w JOIN (SELECT * FROM hits WHERE nprobe = 2) h USING (query_id) GROUP BY h.query_id
UNION ALL SELECT query_id, 0.0 FROM w WHERE query_id NOT IN (SELECT query_id FROM hits WHERE nprobe = 2)""")
def recall_by_distance(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(E.recall_by_distance(_hits(e, 2), knn(e, asked(e), K), K, 0.001), "recall")


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
 count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max,
 max(value) FILTER (i = floor(n * 0.5)) AS p50, max(value) FILTER (i = floor(n * 0.9)) AS p90, max(value) FILTER (i = floor(n * 0.95)) AS p95,
 max(value) FILTER (i = floor(n * 0.99)) AS p99, max(value) FILTER (i = floor(n * 0.999)) AS p999 FROM s GROUP BY event_type""")
def percentiles_floor(spark: SparkSession, d: str) -> DataFrame:
    found = E.percentiles(spark.read.parquet(f"{d}/events.parquet"), "value", "event_type")
    return found.withColumn("avg", F.round("avg", 6))


@query("SELECT event_type, count(*) AS runs, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def search_counters(spark: SparkSession, d: str) -> DataFrame:
    return E.counters(spark.read.parquet(f"{d}/events.parquet"), ["event_type"], ["value"]).withColumn("value", F.round("value", 6))


@query(f"""{_IVF}, cutp AS (SELECT vec_id, center_id FROM near WHERE rnk <= 2 QUALIFY row_number() OVER (PARTITION BY center_id ORDER BY d, vec_id) <= 40),
ra AS (SELECT DISTINCT query_id, p.vec_id FROM pr JOIN post p USING (center_id) WHERE prnk <= 2),
rk AS (SELECT DISTINCT query_id, p.vec_id FROM pr JOIN cutp p USING (center_id) WHERE prnk <= 2),
s2 AS (SELECT query_id, r.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {l2("b.embedding", "q.embedding")}, r.vec_id) AS rnk
 FROM rk r JOIN embeddings b ON b.vec_id = r.vec_id JOIN embeddings q ON q.vec_id = query_id)
SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN h.vec_id IS NOT NULL THEN 'found' WHEN a.vec_id IS NULL THEN 'no list read'
 WHEN k.vec_id IS NULL THEN 'cut from list' ELSE 'not ranked' END AS reason
 FROM truth t LEFT JOIN (SELECT * FROM s2 WHERE rnk <= 10) h USING (query_id, vec_id) LEFT JOIN ra a USING (query_id, vec_id) LEFT JOIN rk k USING (query_id, vec_id)) GROUP BY reason""")
def recall_attribution(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    c = centers(e)
    lists = nearest_centers(e, c, 2)
    kept = C.cut(lists, 40).filter("kept")
    hits = C.ivf_search(e, kept, asked(e), c, K, 2)
    return E.attribution(knn(e, asked(e), K), C.probe(asked(e), c, 2), lists, kept, hits)


# --- S5: clustering and inverted lists ------------------------------------------------------------------------------


@query(f"WITH {NEAR} SELECT vec_id, center_id, round(d, 6) + 0.0 AS dist FROM near WHERE rnk = 1")
def kmeans_assign_fixed_centers(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(C.assign(e, centers(e)))


@query(f"""WITH {NEAR}, x AS (SELECT center_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM near JOIN embeddings USING (vec_id) WHERE rnk = 1)
SELECT center_id, pos, count(*) AS n, round(avg(v::double), 5) + 0.0 AS mean FROM x GROUP BY center_id, pos""")
def kmeans_update_means(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    found = C.means(e, C.assign(e, centers(e))).select("center_id", "n", F.posexplode("center").alias("pos", "mean"))
    return long(found, "pos").withColumn("mean", F.round("mean", 5) + 0.0)


@query(f"""WITH {CENT}, cnt AS (SELECT center_id, center_id % 4 AS c0 FROM cent)
SELECT vec_id, center_id, round(d, 6) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d + 0.05 * c0, center_id) AS rnk FROM (
 SELECT vec_id, center_id, {l2("embedding", "c")} AS d FROM embeddings, cent) JOIN cnt USING (center_id)) WHERE rnk = 1""")
def balanced_assign_penalty(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    c = centers(e)
    return rounded(C.assign(e, c, counts=c[0] % 4, weight=0.05))


_GREEDY = """SELECT {id}, 1::bigint AS rn, [{c}] AS kept FROM cand WHERE rn = 1
 UNION ALL SELECT g.{id}, g.rn + 1, CASE WHEN len(g.kept) < {most} AND len(list_filter(g.kept, lambda k: m.dist[k + 1][cand.{c} + 1] < cand.d)) = 0
  THEN list_append(g.kept, cand.{c}) ELSE g.kept END FROM g JOIN cand ON cand.{id} = g.{id} AND cand.rn = g.rn + 1, m"""

_RNG = f"""WITH RECURSIVE {NEAR}, cand AS (SELECT vec_id, center_id, d, rnk AS rn FROM near),
m AS (SELECT list(r ORDER BY a) AS dist FROM (SELECT a.center_id AS a, list({l2("a.c", "b.c")} ORDER BY b.center_id) AS r FROM cent a, cent b GROUP BY a.center_id)),
g AS ({_GREEDY.format(id="vec_id", c="center_id", most=4)}),
post AS (SELECT vec_id, unnest(kept) AS center_id, unnest(range(1, len(kept) + 1)) AS rnk FROM g WHERE rn = 16)"""


@query(f"{_RNG} SELECT p.vec_id, p.center_id, p.rnk, round(n.d, 6) + 0.0 AS dist FROM post p JOIN near n USING (vec_id, center_id)")
def posting_assign(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(C.diversified(e, centers(e), replicas=4))


@query(f"WITH {NEAR} SELECT vec_id, center_id, row_number() OVER (PARTITION BY center_id ORDER BY d, vec_id) AS place FROM near WHERE rnk <= 2 QUALIFY place <= 40")
def posting_cut(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return C.cut(nearest_centers(e, centers(e), 2), 40).filter("kept").select("vec_id", "center_id", "place")


@query(f"""WITH {NEAR}, m AS (SELECT vec_id, center_id, d, row_number() OVER (PARTITION BY center_id ORDER BY d, vec_id) <= 40 AS kept FROM near WHERE rnk <= 2)
SELECT vec_id, center_id FROM (SELECT *, bool_or(kept) OVER (PARTITION BY vec_id) AS any_kept, row_number() OVER (PARTITION BY vec_id ORDER BY d, center_id) AS r FROM m)
WHERE kept OR (NOT any_kept AND r = 1)""")
def posting_cut_reachable(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return C.cut_reachable(nearest_centers(e, centers(e), 2), 40).select("vec_id", "center_id")


@query(f"{_RNG} SELECT cast(replicas AS bigint) AS replicas, count(*) AS rows FROM (SELECT len(kept) AS replicas FROM g WHERE rn = 16) GROUP BY replicas")
def replica_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return C.replica_histogram(C.diversified(e, centers(e), replicas=4), e)


@query(f"WITH {NEAR} SELECT cast(floor(n / 16) * 16 AS bigint) AS size_from, count(*) AS lists FROM (SELECT count(*) AS n FROM near WHERE rnk <= 2 GROUP BY center_id) GROUP BY 1")
def posting_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return C.list_sizes(nearest_centers(e, centers(e), 2))


@query(f"""WITH {NEAR} SELECT vec_id, center_id, round(list_sum(list_transform(list_zip(embedding, c), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 6) + 0.0 AS square
FROM near JOIN embeddings USING (vec_id) JOIN cent USING (center_id) WHERE rnk = 1""")
def posting_residuals(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    table = e.filter("vec_id < 16").select(F.col("vec_id").alias("center_id"), F.col("embedding").alias("center"))
    found = C.residuals(e, C.assign(e, centers(e)), table)
    return found.select("vec_id", "center_id", r6(V.dot("residual", "residual")).alias("square"))


@query(f"WITH {NEAR} SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) + 0.0 AS total FROM near JOIN embeddings USING (vec_id) WHERE rnk <= 2 AND center_id = 3")
def posting_dump(spark: SparkSession, d: str) -> DataFrame:
    """The rows of one inverted list with their vectors."""
    e = emb(spark, d)
    rows = nearest_centers(e, centers(e), 2).filter("center_id = 3").join(e, "vec_id")
    return rows.select("vec_id", (F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double")), 5) + 0.0).alias("total"))


@query("SELECT query_id, string_agg(cast(vec_id AS varchar), '|' ORDER BY rnk) AS ids FROM (" + knn_sql(l2("b.embedding", "q.embedding")) + ") GROUP BY query_id")
def result_lists(spark: SparkSession, d: str) -> DataFrame:
    """Results as one line of ids for each query."""
    e = emb(spark, d)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rnk", "vec_id"))), lambda s: s["vec_id"].cast("string"))
    return knn(e, asked(e), K).groupBy("query_id").agg(F.array_join(ids, "|").alias("ids"))


# --- S6: quantisation -----------------------------------------------------------------------------------------------

_PQ = f"""WITH bk AS (SELECT s, vec_id AS code, embedding[s * 4 + 1 : s * 4 + 4] AS c FROM embeddings, range(16) t(s) WHERE vec_id < 16),
pt AS (SELECT vec_id, s, embedding[s * 4 + 1 : s * 4 + 4] AS p FROM embeddings, range(16) t(s)),
cd AS (SELECT vec_id, s, code, c FROM (SELECT pt.vec_id, pt.s, code, c, row_number() OVER (PARTITION BY pt.vec_id, pt.s ORDER BY {l2("p", "c")}, code) AS r FROM pt JOIN bk USING (s)) WHERE r = 1)"""


@query(f"{_PQ} SELECT vec_id, s, code FROM cd")
def pq_encode_fixed_codebook(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return long(Q.encode(e, book(e)).select("vec_id", F.posexplode("codes").alias("s", "code")), "s", "code")


@query(f"""{_PQ}, lut AS (SELECT pt.vec_id AS query_id, pt.s, code, {l2("p", "c")} AS d FROM pt JOIN bk USING (s) WHERE pt.vec_id % 50 = 0)
SELECT query_id, cd.vec_id, round(sum(d), 5) + 0.0 AS dist FROM cd JOIN lut USING (s, code) GROUP BY query_id, cd.vec_id""")
def pq_adc_distance(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    b = book(e)
    tables = asked(e).select("query_id", Q.adc_table("query", Q.literal(b), 16, 4).alias("lut"))
    # a stated query set against all codes: one table of 16 x 16 numbers for each query
    pairs = Q.encode(e, b).join(F.broadcast(tables))
    return pairs.select("query_id", "vec_id", (F.round(Q.looked_up("codes", "lut"), 5) + 0.0).alias("dist"))


@query(f"""{_PQ}, dd AS (SELECT a.s, a.code AS x, b.code AS y, {l2("a.c", "b.c")} AS d FROM bk a JOIN bk b USING (s))
SELECT q.vec_id AS query_id, cd.vec_id, round(sum(d), 5) + 0.0 AS dist FROM cd JOIN cd q USING (s) JOIN dd ON dd.s = cd.s AND x = cd.code AND y = q.code
WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, cd.vec_id""")
def pq_sdc_distance(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    b = book(e)
    codes = Q.encode(e, b)
    table = Q.sdc_table(b)
    lut = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in s]) for s in table])
    asked_codes = codes.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.zip_with("codes", lut, lambda c, rows: F.element_at(rows, c + 1)).alias("lut"))
    pairs = codes.join(F.broadcast(asked_codes))
    return pairs.select("query_id", "vec_id", (F.round(Q.looked_up("codes", "lut"), 5) + 0.0).alias("dist"))


@query(f"{_PQ} SELECT vec_id, round({l2('embedding', 'r')}, 6) + 0.0 AS error FROM (SELECT vec_id, flatten(list(c ORDER BY s)) AS r FROM cd GROUP BY vec_id) JOIN embeddings USING (vec_id)")
def pq_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    b = book(e)
    codes = Q.encode(e, b, keep=("embedding",))
    return codes.select("vec_id", r6(V.l2("embedding", Q.reconstructed("codes", Q.literal(b)))).alias("error"))


@query(f"""{_PQ}, rec AS (SELECT vec_id, flatten(list(c ORDER BY s)) AS embedding FROM cd GROUP BY vec_id),
cand AS (SELECT * FROM (SELECT q.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {l2("b.embedding", "q.embedding")}, b.vec_id) AS r
 FROM rec b, embeddings q WHERE q.vec_id % 50 = 0) WHERE r <= 40)
SELECT query_id, vec_id, rnk, round(d, 6) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rnk FROM (
 SELECT query_id, c.vec_id, {l2("b.embedding", "q.embedding")} AS d FROM cand c JOIN embeddings b ON b.vec_id = c.vec_id JOIN embeddings q ON q.vec_id = query_id)) WHERE rnk <= 10""")
def pq_rerank(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    b = book(e)
    rough = Q.pq_search(Q.encode(e, b), asked(e), b, 40)
    return rounded(Q.reranked(rough, e, asked(e), K))


def _turn() -> np.ndarray:
    """A fixed orthonormal matrix: reversal with the signs of even places changed."""
    return np.fliplr(np.eye(64)) * np.where(np.arange(64) % 2 == 0, -1.0, 1.0)[:, None]


@query("""SELECT vec_id, i, round(CASE WHEN i % 2 = 0 THEN -embedding[64 - i]::double ELSE embedding[64 - i]::double END, 6) + 0.0 AS v, 0.0::double AS error
FROM embeddings, range(64) t(i)""")
def opq_rotate(spark: SparkSession, d: str) -> DataFrame:
    turn = _turn()
    e = emb(spark, d).select("vec_id", "embedding", Q.rotated("embedding", turn).alias("r"))
    back = e.select("vec_id", "r", r6(V.l2("embedding", Q.rotated("r", turn.T))).alias("error"))
    return long(back.select("vec_id", F.posexplode("r").alias("i", "v"), "error"), "i").withColumn("v", r6("v"))


# --- S7: updates ----------------------------------------------------------------------------------------------------

_AGAIN = "(SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + 10000, label FROM embeddings WHERE vec_id % 7 = 0)"


def _again(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 10000)


@query(f"SELECT vec_id, label FROM {_AGAIN}")
def apply_inserts(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return M.inserted(e, _again(e)).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0")
def apply_deletes(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return M.deleted(e, e.filter("vec_id % 7 = 0")).select("vec_id", "label")


@query("SELECT label, max(vec_id + 10000) AS vec_id FROM embeddings WHERE vec_id % 7 = 0 GROUP BY label UNION ALL SELECT label, max(vec_id) FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id % 7 = 0) GROUP BY label")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return M.upserted(e, _again(e), "label").select("label", "vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 50 <> 0 UNION ALL SELECT vec_id + 10000 FROM embeddings WHERE vec_id % 7 = 0 AND vec_id % 50 <> 0")
def delete_by_vector(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return M.deleted_by_vector(e.unionByName(_again(e)), asked(e)).select("vec_id")


@query("SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + (SELECT max(vec_id) + 1 FROM embeddings), label FROM embeddings WHERE vec_id % 7 = 0")
def merge_indexes(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return M.merged(e, e.filter("vec_id % 7 = 0")).select("vec_id", "label")


@query("""WITH a AS (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0), n AS (SELECT count(*) AS n FROM a),
h AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings, n WHERE vec_id % 7 = 0 AND vec_id < n),
t AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS r FROM a, n WHERE vec_id >= n)
SELECT vec_id AS old_id, vec_id AS new_id FROM a, n WHERE vec_id < n UNION ALL SELECT t.vec_id, h.vec_id FROM h JOIN t USING (r)""")
def compact_mapping(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return M.compaction(e, e.filter("vec_id % 7 = 0"))


@query("SELECT vec_id, vec_id % 16 AS center_id, 1 AS version FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 3 = 0 UNION ALL SELECT vec_id, (vec_id + 1) % 16, 0 FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 3 <> 0")
def stale_gc(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    new = e.filter("vec_id % 3 = 0").select("vec_id", (F.col("vec_id") % 16).alias("center_id"), F.lit(1).alias("version"))
    old = e.select("vec_id", ((F.col("vec_id") + 1) % 16).alias("center_id"), F.lit(0).alias("version"))
    versions = e.select("vec_id", F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0).alias("version"), (F.col("vec_id") % 7 == 0).alias("deleted"))
    return M.fresh(new.unionByName(old), versions).select("vec_id", "center_id", "version")


@query(f"WITH {NEAR} SELECT vec_id, label % 16 AS center_id, center_id AS nearest FROM near WHERE rnk = 1 AND label % 16 <> center_id")
def reassign_check(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    lists = e.select("vec_id", (F.col("label") % 16).alias("center_id"))
    return M.reassign_check(lists, e, centers(e))


@query("SELECT t.query_id, t.rnk, t.vec_id + 500000 AS vec_id FROM (" + knn_sql(l2("b.embedding", "q.embedding")) + ") t")
def truth_remap(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    mapping = e.select(F.col("vec_id").alias("local_id"), (F.col("vec_id") + 500000).alias("global_id"))
    return M.remapped(knn(e, asked(e), K).select("query_id", "rnk", "vec_id"), mapping)


# --- S8: graph ------------------------------------------------------------------------------------------------------

_GRAPH = f"""SELECT src, pos, dst, d FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS pos FROM (
 SELECT a.vec_id AS src, b.vec_id AS dst, {l2("b.embedding", "a.embedding")} AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE pos <= 8"""


@query(f"SELECT src, pos, dst, round(d, 6) + 0.0 AS dist FROM ({_GRAPH})")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.exact_graph(emb(spark, d), 8))


@query(f"""WITH RECURSIVE cand AS (SELECT src, dst, d, pos AS rn FROM ({_GRAPH})),
near AS (SELECT c.*, list(k.dst ORDER BY k.rn) AS before, list({l2("x.embedding", "y.embedding")} ORDER BY k.rn) AS gaps
 FROM cand c JOIN cand k ON k.src = c.src AND k.rn < c.rn JOIN embeddings x ON x.vec_id = c.dst JOIN embeddings y ON y.vec_id = k.dst GROUP BY ALL),
g AS (SELECT src, 1::bigint AS rn, [dst] AS kept FROM cand WHERE rn = 1
 UNION ALL SELECT g.src, g.rn + 1, CASE WHEN len(g.kept) < 4 AND len(list_filter(list_zip(n.before, n.gaps), lambda z: z[2] < n.d AND list_contains(g.kept, z[1]))) = 0
  THEN list_append(g.kept, n.dst) ELSE g.kept END FROM g JOIN near n ON n.src = g.src AND n.rn = g.rn + 1),
p AS (SELECT src, unnest(kept) AS dst, unnest(range(1, len(kept) + 1)) AS pos FROM g WHERE rn = 8)
SELECT p.src, p.pos, p.dst, round(c.d, 6) + 0.0 AS dist FROM p JOIN cand c USING (src, dst)""")
def rng_prune(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return rounded(G.pruned(G.exact_graph(e, 8), e, 4))


@query(f"SELECT dst AS src, src AS dst, round(d, 6) + 0.0 AS dist FROM ({_GRAPH})")
def reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.reversed_edges(G.exact_graph(emb(spark, d), 8)))


@query(f"SELECT vec_id, count(dst) AS in_degree FROM embeddings LEFT JOIN ({_GRAPH}) ON dst = vec_id GROUP BY vec_id")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return G.in_degrees(G.exact_graph(e, 8), e)


@query(f"""WITH g AS ({_GRAPH}), n AS (SELECT dst, count(*) AS n FROM g GROUP BY dst)
SELECT src, dst, place AS pos FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n, round(d, 9), dst) AS place FROM g JOIN n USING (dst)) WHERE place <= 4""")
def graph_rebuild(spark: SparkSession, d: str) -> DataFrame:
    edges = G.exact_graph(emb(spark, d), 8).withColumn("dist", F.round("dist", 9))
    return G.rebuilt(edges, 4).select("src", "dst", "pos")


@query(f"""WITH t AS (SELECT src, dst FROM ({_GRAPH})), g AS (SELECT src, dst FROM ({_GRAPH}) WHERE pos <= 4)
SELECT (SELECT count(*) FROM t SEMI JOIN g USING (src, dst)) AS found, count(*) AS wanted, (SELECT count(*) FROM t SEMI JOIN g USING (src, dst)) / count(*) AS accuracy FROM t""")
def graph_accuracy(spark: SparkSession, d: str) -> DataFrame:
    truth = G.exact_graph(emb(spark, d), 8)
    return G.accuracy(truth.filter("pos <= 4"), truth)


@query("""WITH x AS (SELECT unnest(embedding)::double AS v, unnest(range(len(embedding))) AS dim FROM embeddings)
SELECT '' AS path, dim, round(avg(v), 6) + 0.0 AS cut FROM x GROUP BY dim ORDER BY var_pop(v) DESC, dim LIMIT 1""")
def kd_split(spark: SparkSession, d: str) -> DataFrame:
    found = G.kd_split(emb(spark, d).withColumn("path", F.lit("")))
    return long(found, "dim").withColumn("cut", r6("cut"))


@query(f"""WITH c AS (SELECT vec_id AS i, embedding AS c FROM embeddings WHERE vec_id < 16),
l AS (SELECT vec_id, arg_min(i, ({l2("embedding", "c")}, i)) FILTER (i < 4) AS a, arg_min(i - 4, ({l2("embedding", "c")}, i)) FILTER (i >= 4) AS b FROM embeddings, c GROUP BY vec_id)
SELECT vec_id, a || '/' || b AS path FROM l""")
def tree_path(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    rows = centers(e)[1]
    return e.select("vec_id", G.tree_path("embedding", [rows[:4], rows[4:]]).alias("path"))


# --- S9: partitioning -----------------------------------------------------------------------------------------------


@query(f"WITH {NEAR} SELECT vec_id, center_id, rnk FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS m FROM near WHERE rnk <= 4) WHERE d <= m * 1.1")
def closure_assign(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return C.closure_assign(e, centers(e), 1.1, 4).select("vec_id", "center_id", "rnk")


@query(f"WITH {NEAR} SELECT vec_id, center_id FROM near WHERE rnk = 1 QUALIFY row_number() OVER (PARTITION BY center_id ORDER BY d, vec_id) <= 20")
def hard_capacity_round(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return C.cut(C.assign(e, centers(e)), 20).filter("kept").select("vec_id", "center_id")


@query(f"WITH {NEAR} SELECT vec_id AS query_id, center_id AS shard_id, rnk FROM near WHERE vec_id % 50 = 0 AND rnk <= 2")
def shard_routing(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return C.route(asked(e), centers(e), 2)


@query(f"WITH {NEAR} SELECT center_id, count(*) AS n FROM near WHERE rnk = 1 GROUP BY center_id")
def shard_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return C.assign(e, centers(e)).groupBy("center_id").agg(F.count("*").alias("n"))
