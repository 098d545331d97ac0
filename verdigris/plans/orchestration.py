"""Queries that read lineitem as batches, events as status updates, conversations as job inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import orchestration as O
from verdigris.operators import pool_runs as P
from verdigris.session import load


def _items(spark, d, workers=4):
    li = load(spark, d, "lineitem")
    ok, bad = F.col("l_returnflag"), F.col("l_linestatus")
    status = F.when(ok == "R", "Failed").when(bad == "F", "Completed").when(ok == "A", "Cancelled").when(F.col("l_quantity") < 25, "Pending").otherwise("Processing")
    rows = li.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("item"), status.alias("status"), (F.col("l_orderkey") % 97 == 0).alias("batch_cancelled"))
    return O.fan_out(rows, workers)


def batch_fanout(spark, d):
    return _items(spark, d).groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.min("item_key").alias("first_item"), F.max("worker_key").alias("last_worker"))


def batch_summary(spark, d):
    return O.batch_summary(_items(spark, d))


def batch_worker_counts(spark, d):
    return O.worker_counts(_items(spark, d))


def batch_cancel(spark, d):
    items = _items(spark, d)
    return O.cancel_batches(items, items.filter("batch_cancelled").select("batch")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def worker_cancel(spark, d):
    return O.cancel_worker(_items(spark, d), 1).groupBy("worker", "status").agg(F.count(F.lit(1)).alias("n"))


def _updates(spark, d):
    e = load(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "purchase", "Completed").when(F.col("event_type") == "signup", "Pending").otherwise("Processing")
    channel = F.element_at(F.array(*map(F.lit, ("email", "sms", "push"))), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"), channel.alias("channel"), "value")


def status_latest(spark, d):
    return O.latest(_updates(spark, d), "job_id", ["status", "seq", "value"], ["ts", "seq"])


def status_lookup(spark, d):
    asked = load(spark, d, "orders").select(F.col("o_custkey").alias("job_id")).distinct()
    return O.lookup(asked, O.latest(_updates(spark, d), "job_id", ["status"], ["ts", "seq"]), "job_id")


def status_pivot(spark, d):
    return O.pivot_status(_updates(spark, d), "job_id", "channel", ["email", "sms", "push"])


def resubmission_guards(spark, d):
    last = O.latest(_updates(spark, d), "job_id", ["status"], ["ts", "seq"])
    kind = F.element_at(F.array(*map(F.lit, ("job", "report", "notification"))), (F.col("job_id") % 3 + 1).cast("int"))
    return last.withColumn("kind", kind).withColumn("accepted", O.accepts(F.col("kind"), F.col("status")))


def result_status(spark, d):
    e = load(spark, d, "events")
    s = O.result_status(F.col("event_type") == "signup", F.when(F.col("event_type") == "error", F.col("props")))
    return e.groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def pipeline_outputs(spark, d):
    return O.pipeline_outputs(load(spark, d, "documents"))


def pipeline_status(spark, d):
    u = O.pivot_status(_updates(spark, d), "job_id", "channel", ["email", "sms", "push"])
    return u.select("job_id", O.step_status(F.col("email"), F.col("sms"), F.col("push")).alias("pipeline"))


def handler_phases(spark, d):
    names = sorted(P.PHASES)
    jobs = load(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int")).alias("handler"))
    return P.phase_steps(jobs)


def progress_percent(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 3 + 2).cast("int").alias("a"), (F.col("o_custkey") % 4 + 1).cast("int").alias("b"))
    total = F.col("a") + F.col("b")
    phases = o.select("job_id", F.explode(F.array(F.struct(F.lit("Load").alias("name"), F.col("a").alias("steps"), F.lit(0).alias("before"), total.alias("total")), F.struct(F.lit("Store").alias("name"), F.col("b").alias("steps"), F.col("a").alias("before"), total.alias("total")))).alias("p")).select("job_id", "p.*")
    return O.progress(phases, "job_id")


def cluster_stats(spark, d):
    e = load(spark, d, "events")
    nodes = e.groupBy((F.col("user_id") % 7).alias("node")).agg(F.count(F.lit(1)).alias("enqueued"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("completed"))
    return O.cluster_stats(nodes, ["enqueued", "failed", "completed"])


def fault_injection(spark, d):
    e = O.inject_faults(load(spark, d, "events"), 10, F.col("event_id"))
    return e.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def scheduled_lag(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("done"))
    return o.join(li, "o_orderkey").select("o_orderkey", F.date_diff(F.col("done"), F.col("o_orderdate")).cast("long").alias("lag_days"))


def bootstrap_mix(spark, d):
    return load(spark, d, "orders").groupBy(O.bootstrap_kind(F.col("o_orderkey")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def job_preview(spark, d):
    c = load(spark, d, "conversations")
    return O.preview(c.select("conv_id", "turn", F.concat_ws("-", "role", "turn").alias("label")), "conv_id", "label", "turn")


def job_filters(spark, d):
    last = O.latest(_updates(spark, d), "job_id", ["status"], ["ts", "seq"])
    s = F.col("status")
    return last.agg(F.count_if(s.isin("Completed", "Failed", "Cancelled")).alias("removable"), F.count_if(s.isin("Failed", "Cancelled")).alias("restartable"), F.count_if(s.isin("Pending", "Processing")).alias("cancellable"))


QUERIES = {
    f.__name__: f
    for f in (
        batch_fanout, batch_summary, batch_worker_counts, batch_cancel, worker_cancel, status_latest, status_lookup, status_pivot, resubmission_guards, result_status, pipeline_outputs, pipeline_status,
        handler_phases, progress_percent, cluster_stats, fault_injection, scheduled_lag, bootstrap_mix, job_preview, job_filters,
    )
}

def _phases_sql():
    rows = ", ".join(f"({i}, '{h}', {k}, '{name}', {n})" for i, h in enumerate(sorted(P.PHASES)) for k, (name, n) in enumerate(P.PHASES[h]))
    return f"""WITH p(h, handler, k, phase, n) AS (VALUES {rows}), s AS (SELECT h, handler, k, phase, n, unnest(range(1, n + 1)) AS i FROM p),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY h ORDER BY k, i) AS INT) AS step, CAST(count(*) OVER (PARTITION BY h) AS INT) AS total_steps FROM s)
SELECT o_orderkey AS job_id, handler, phase, step, total_steps, CAST(step * 100 // total_steps AS INT) AS percent, CASE WHEN n > 1 THEN phase || ' (' || i || '/' || n || ')' ELSE phase END AS message FROM orders JOIN q ON o_orderkey % {len(P.PHASES)} = h"""


_I = """WITH i AS (SELECT l_orderkey AS batch, l_linenumber AS item, CASE WHEN l_returnflag = 'R' THEN 'Failed' WHEN l_linestatus = 'F' THEN 'Completed' WHEN l_returnflag = 'A' THEN 'Cancelled' WHEN l_quantity < 25 THEN 'Pending' ELSE 'Processing' END AS status,
  l_orderkey % 97 = 0 AS batch_cancelled, l_linenumber % 4 AS worker FROM lineitem)"""
_U = """WITH u AS (SELECT user_id AS job_id, ts, event_id AS seq, value, CASE event_type WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Completed' WHEN 'signup' THEN 'Pending' ELSE 'Processing' END AS status, (['email', 'sms', 'push'])[event_id % 3 + 1] AS channel FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS k FROM u) WHERE k = 1),
p AS (SELECT job_id, coalesce(max(status) FILTER (channel = 'email'), 'Unknown') AS email, coalesce(max(status) FILTER (channel = 'sms'), 'Unknown') AS sms, coalesce(max(status) FILTER (channel = 'push'), 'Unknown') AS push
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, channel ORDER BY ts DESC, seq DESC) AS k FROM u) WHERE k = 1 GROUP BY 1)"""
ORACLE_SQL = {
    "batch_fanout": _I + " SELECT worker, count(*) AS n, min(batch || ':item-' || item) AS first_item, max(batch || ':worker-' || worker) AS last_worker FROM i GROUP BY 1",
    "batch_summary": _I + """, c AS (SELECT batch, count(*) AS n, count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Processing') AS processing, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Cancelled') AS cancelled, bool_or(batch_cancelled) AS batch_cancelled FROM i GROUP BY 1)
SELECT *, CASE WHEN batch_cancelled THEN 'Cancelled' WHEN completed + failed + cancelled < n THEN 'Processing' WHEN failed > 0 THEN 'Failed' WHEN cancelled > 0 THEN 'Cancelled' ELSE 'Completed' END AS overall FROM c""",
    "batch_worker_counts": _I + " SELECT batch, worker, count(*) AS assigned, count(*) FILTER (status = 'Completed') AS completed FROM i GROUP BY 1, 2",
    "batch_cancel": _I + " SELECT CASE WHEN batch_cancelled AND status IN ('Pending', 'Processing') THEN 'Cancelled' ELSE status END AS status, count(*) AS n FROM i GROUP BY 1",
    "worker_cancel": _I + " SELECT worker, CASE WHEN worker = 1 AND status IN ('Pending', 'Processing') THEN 'Cancelled' ELSE status END AS status, count(*) AS n FROM i GROUP BY 1, 2",
    "status_latest": _U + " SELECT job_id, status, seq, value FROM l",
    "status_lookup": _U + " SELECT job_id, coalesce(status, 'Unknown') AS status FROM (SELECT DISTINCT o_custkey AS job_id FROM orders) LEFT JOIN l USING (job_id)",
    "status_pivot": _U + " SELECT * FROM p",
    "resubmission_guards": _U + """ SELECT job_id, status, (['job', 'report', 'notification'])[job_id % 3 + 1] AS kind,
NOT CASE job_id % 3 WHEN 0 THEN status = 'Processing' WHEN 1 THEN status IN ('Processing', 'Completed') ELSE status IN ('Pending', 'Processing', 'Completed') END AS accepted FROM l""",
    "result_status": "SELECT CASE WHEN event_type = 'signup' THEN 'Cancelled' WHEN event_type = 'error' AND props IS NOT NULL THEN 'Failed' ELSE 'Completed' END AS status, count(*) AS n FROM events GROUP BY 1",
    "pipeline_outputs": r"""WITH w AS (SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE len(string_split_regex(trim(text), '[ \n\t\r]+')) END AS n_words FROM documents), k AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(greatest(3, n_words // 50) AS INT) AS n_keywords, round((doc_id * 7919) % 2001 / 1000.0 - 1, 3) AS sentiment FROM w)
SELECT *, array_to_string(list_transform(range(1, least(n_keywords, 3) + 1), lambda i: 'kw-' || i), ', ') AS preview FROM k""",
    "pipeline_status": _U + """ SELECT job_id, CASE WHEN email = 'Failed' THEN 'Failed at extract' WHEN email IN ('Pending', 'Processing') THEN 'Running extract' WHEN sms = 'Failed' THEN 'Failed at transform' WHEN sms IN ('Pending', 'Processing') THEN 'Running transform'
  WHEN push = 'Failed' THEN 'Failed at index' WHEN push IN ('Pending', 'Processing') THEN 'Running index' ELSE 'Completed' END AS pipeline FROM p""",
    "handler_phases": _phases_sql(),
    "progress_percent": """WITH o AS (SELECT o_orderkey AS job_id, o_orderkey % 3 + 2 AS a, o_custkey % 4 + 1 AS b FROM orders), p AS (SELECT job_id, 'Load' AS name, a AS steps, 0 AS before, a + b AS total FROM o UNION ALL SELECT job_id, 'Store', b, a, a + b FROM o), r AS (SELECT *, unnest(range(1, steps + 1)) AS i FROM p)
SELECT job_id, name || ' (' || i || '/' || steps || ')' AS label, (before + i) * 100 // total AS percent, CAST(round_even((before + i) * 100.0 / total, 0) AS BIGINT) AS percent_rounded FROM r""",
    "cluster_stats": "SELECT count(*) AS enqueued, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS completed, count(DISTINCT user_id % 7) AS n_nodes FROM events",
    "fault_injection": "SELECT CASE WHEN (event_id * 7919 + 104729) % 1000 < 10 THEN (['timeout', 'invalid', 'io', 'unexpected'])[event_id % 4 + 1] END AS fault, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1",
    "scheduled_lag": "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(max(l_shipdate) AS DATE)) AS lag_days FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate",
    "bootstrap_mix": "SELECT (['import', 'export', 'scheduled'])[o_orderkey % 3 + 1] AS kind, count(*) AS n FROM orders GROUP BY 1",
    "job_preview": "SELECT conv_id, array_to_string(list(role || '-' || turn ORDER BY turn) [1:3], ', ') || CASE WHEN count(*) > 3 THEN '…' ELSE '' END AS preview FROM conversations GROUP BY 1",
    "job_filters": _U + " SELECT count(*) FILTER (status IN ('Completed', 'Failed', 'Cancelled')) AS removable, count(*) FILTER (status IN ('Failed', 'Cancelled')) AS restartable, count(*) FILTER (status IN ('Pending', 'Processing')) AS cancellable FROM l",
}
