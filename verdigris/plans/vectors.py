"""Queries over embeddings. The query set is every vec_id divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import quantizer as Q
from verdigris.operators import vectors as V
from verdigris.session import load
from verdigris.sources import index_file

K = 10


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, d, "embeddings")
    return e, e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vec_topk_exact(spark, d):
    e, q = _both(spark, d)
    return V.top_k(e, q, K)


def vec_topk_masked(spark, d):
    e, q = _both(spark, d)
    return V.top_k(e.filter("label < 5"), q, K)


def vec_topk_allowlist(spark, d):
    e, q = _both(spark, d)
    return V.top_k(V.allowed(e, e.filter("label = 3").select("vec_id")), q, K)


def vec_effective_k(spark, d):
    e, q = _both(spark, d)
    found = V.top_k(e.filter("label = 1"), q, 1000)  # more than the mask leaves
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"))


def vec_block_skip(spark, d):
    return V.block_skip(load(spark, d, "embeddings"), F.col("label") == 7)


def vec_swap_remove(spark, d):
    e = load(spark, d, "embeddings")
    return V.swap_remove(e.select(F.col("vec_id").alias("slot"), "vec_id"), 5)


def vec_remove_ids(spark, d):
    e = load(spark, d, "embeddings")
    return V.remove(e, e.filter("label = 2")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def vec_add_with_ids(spark, d):
    e = load(spark, d, "embeddings")
    batch = e.select((F.col("vec_id") + 400).alias("vec_id")).unionByName(e.filter("label = 4").select((F.col("vec_id") + 400).alias("vec_id")))
    return V.add_with_ids(e, batch)


def vec_norms(spark, d):
    return V.norms(load(spark, d, "embeddings"))


def vec_dim_check(spark, d):
    return load(spark, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def vec_index_stats(spark, d):
    e = load(spark, d, "embeddings")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("n_ids"), F.max(F.size("embedding")).cast("long").alias("dim"), (F.count(F.lit(1)) == 0).alias("is_empty"), F.coalesce(F.bool_or(F.col("vec_id") == 17), F.lit(False)).alias("has_17"))


def _codes(bits):
    def run(spark, d):
        c = V.encode(load(spark, d, "embeddings"), bits)
        return c.select("vec_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), F.round("scale", 6).alias("scale"))

    return run


def _quantized(bits, lut=False):
    def run(spark, d):
        e, q = _both(spark, d)
        return V.top_k_quantized(V.encode(e, bits), q, bits, K, lut)

    return run


def _recall(bits):
    def run(spark, d):
        e, q = _both(spark, d)
        return V.recall(V.top_k(e, q, K), V.top_k_quantized(V.encode(e, bits), q, bits, K), K)

    return run


def _filed(bits):
    """Codes that went through index files."""

    def run(spark, d):
        files = index_file.index_files(V.encode(load(spark, d, "embeddings"), bits), bits, 128)
        c = index_file.read_index_files(files)
        return c.select("vec_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), F.round("scale", 5).alias("scale"), "bits")

    return run


def _distortion(bits):
    return lambda spark, d: V.distortion(load(spark, d, "embeddings"), bits)


QUERIES = {
    f.__name__: f
    for f in (vec_topk_exact, vec_topk_masked, vec_topk_allowlist, vec_effective_k, vec_block_skip, vec_swap_remove, vec_remove_ids, vec_add_with_ids, vec_norms, vec_dim_check, vec_index_stats)
}
for _b in (2, 3, 4):
    QUERIES[f"vec_encode_{_b}bit"] = _codes(_b)
    QUERIES[f"vec_topk_quantized_{_b}bit"] = _quantized(_b)
    QUERIES[f"vec_topk_lut_{_b}bit"] = _quantized(_b, True)
    QUERIES[f"vec_recall_{_b}bit"] = _recall(_b)
    QUERIES[f"vec_distortion_{_b}bit"] = _distortion(_b)
    QUERIES[f"vec_index_files_{_b}bit"] = _filed(_b)


def _topk_sql(where="TRUE", k=K):
    return f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND ({where})),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def _list(a):
    return "[" + ", ".join(repr(float(x)) for x in a) + "]::DOUBLE[]"


def _encoded_sql(bits, dim=64):
    rot = ", ".join(f"({i}, {_list(r)})" for i, r in enumerate(Q.rotation(dim)))
    bounds, cent = Q.codebook(bits, dim)
    code = " + ".join(f"(x > {float(b)!r})::INT" for b in bounds)
    return f"""rot(i, r) AS (VALUES {rot}),
n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
u AS (SELECT vec_id, norm, list_transform(v, lambda x: x / norm) AS u FROM n),
x AS (SELECT vec_id, norm, i, list_dot_product(u, r) AS x FROM u, rot),
c AS (SELECT vec_id, norm, i, x, {code} AS code, ({_list(cent)})[{code} + 1] AS cent FROM x),
e AS (SELECT vec_id, string_agg(code::VARCHAR, ',' ORDER BY i) AS codes, list(cent ORDER BY i) AS near, any_value(norm) / greatest(sum(x * cent), 1e-10) AS scale, any_value(norm) AS norm, sum((x - cent) * (x - cent)) AS se, sum(x * cent) AS own FROM c GROUP BY vec_id),
q AS (SELECT vec_id AS query_id, list(y ORDER BY i) AS q FROM (SELECT vec_id, i, list_dot_product(embedding::DOUBLE[], r) AS y FROM embeddings, rot WHERE vec_id % 50 = 0) GROUP BY 1),
s AS (SELECT query_id, vec_id, round(list_dot_product(q, near) * scale, 6) + 0.0 AS score FROM q, e),
a AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)"""


def _lut_sql(bits, dim=64):
    """The same with products of each coordinate and level in steps of a 255th of a query's range."""
    cent = _list(Q.codebook(bits, dim)[1])
    return f"""WITH {_encoded_sql(bits, dim)},
lp AS (SELECT query_id, q, list_transform(q, lambda y: list_transform({cent}, lambda c: y * c)) AS p FROM q),
lr AS (SELECT *, list_min(flatten(p)) AS lo, list_max(flatten(p)) AS hi FROM lp),
lt AS (SELECT query_id, lo, CASE WHEN hi - lo > 1e-12 THEN (hi - lo) / 255 ELSE 1.0 END AS step, p FROM lr),
lu AS (SELECT query_id, lo, step, list_transform(p, lambda r: list_transform(r, lambda x: greatest(0, least(255, round_even((x - lo) / step, 0))))) AS t FROM lt),
lc AS (SELECT vec_id, scale, list_transform(string_split(codes, ','), lambda x: x::INT) AS code FROM e),
ls AS (SELECT query_id, vec_id, round((list_sum(list_transform(range(1, {dim + 1}), lambda i: t[i][code[i] + 1])) * step + lo * {dim}) * scale, 6) + 0.0 AS score FROM lu, lc),
la AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM ls)
SELECT query_id, rank, vec_id, score FROM la WHERE rank <= {K}"""


ORACLE_SQL = {
    "vec_topk_exact": _topk_sql(),
    "vec_topk_masked": _topk_sql("v.label < 5"),
    "vec_topk_allowlist": _topk_sql("v.vec_id IN (SELECT vec_id FROM embeddings WHERE label = 3)"),
    "vec_effective_k": f"SELECT query_id, count(*) AS n_found FROM ({_topk_sql('v.label = 1', 1000)}) GROUP BY 1",
    "vec_block_skip": "SELECT vec_id // 32 AS block, count(*) FILTER (label = 7) AS n_allowed, count(*) AS n_rows, count(*) FILTER (label = 7) = 0 AS skipped FROM embeddings GROUP BY 1",
    "vec_swap_remove": "SELECT CASE WHEN vec_id = (SELECT max(vec_id) FROM embeddings) THEN 5 ELSE vec_id END AS slot, vec_id FROM embeddings WHERE vec_id <> 5",
    "vec_remove_ids": "SELECT label, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 2) GROUP BY 1",
    "vec_add_with_ids": """WITH b AS (SELECT vec_id + 400 AS vec_id FROM embeddings UNION ALL SELECT vec_id + 400 FROM embeddings WHERE label = 4)
SELECT vec_id, count(*) AS copies, CASE WHEN count(*) > 1 THEN 'duplicate in batch' WHEN vec_id IN (SELECT vec_id FROM embeddings) THEN 'already present' END AS rejected FROM b GROUP BY vec_id""",
    "vec_norms": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "vec_dim_check": "SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1",
    "vec_index_stats": "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, max(len(embedding)) AS dim, count(*) = 0 AS is_empty, coalesce(bool_or(vec_id = 17), false) AS has_17 FROM embeddings",
}
for _b in (2, 3, 4):
    _e = f"WITH {_encoded_sql(_b)}"
    ORACLE_SQL[f"vec_encode_{_b}bit"] = _e + " SELECT vec_id, codes, round(scale, 6) AS scale FROM e"
    ORACLE_SQL[f"vec_topk_quantized_{_b}bit"] = _e + f" SELECT query_id, rank, vec_id, score FROM a WHERE rank <= {K}"
    ORACLE_SQL[f"vec_index_files_{_b}bit"] = _e + f" SELECT vec_id, codes, round(scale::FLOAT::DOUBLE, 5) AS scale, {_b} AS bits FROM e"
    ORACLE_SQL[f"vec_topk_lut_{_b}bit"] = _lut_sql(_b)
    ORACLE_SQL[f"vec_recall_{_b}bit"] = _e + f", x10 AS ({_topk_sql()}) SELECT query_id, count(a.vec_id) AS hits, round(count(a.vec_id) / {float(K)}, 6) AS recall FROM x10 LEFT JOIN (SELECT * FROM a WHERE rank <= {K}) a USING (query_id, vec_id) GROUP BY query_id"
    ORACLE_SQL[f"vec_distortion_{_b}bit"] = _e + " SELECT round(avg(se), 6) AS mse_x_dim, round(avg(scale * own / norm), 6) AS self_score, count(*) AS n FROM e"
