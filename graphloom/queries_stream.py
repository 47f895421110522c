"""Batch twins of the streaming operators; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.fixtures import sql, view
from graphloom.registry import query
from graphloom.streaming import streams as st


def _changes(spark, sf):
    c = view(spark, sf, "changes")
    return c.select("id", "file_path", F.col("applied_at").alias("ts"), F.when(F.col("rolled_back"), "old").otherwise(F.col("provider")).alias("content"))


@query("st1_debounce", sql("""WITH g AS (SELECT *, CASE WHEN epoch_us(applied_at) - epoch_us(lag(applied_at) OVER (PARTITION BY file_path ORDER BY applied_at, id)) < 3600000000 THEN 0 ELSE 1 END AS new FROM changes),
s AS (SELECT *, sum(new) OVER (PARTITION BY file_path ORDER BY applied_at, id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT file_path, max_by(id, row(applied_at, id)) AS id, count(*) AS events FROM s GROUP BY file_path, k""", "changes"))
def _(spark, sf):
    return st.debounce(_changes(spark, sf), "1 hour").drop("ts")


@query("st2_suppress_noops", sql("""WITH c AS (SELECT id, file_path, CASE WHEN rolled_back THEN 'old' ELSE provider END AS new_content, lag(CASE WHEN rolled_back THEN 'old' ELSE provider END) OVER (PARTITION BY file_path ORDER BY applied_at, id) AS old_content FROM changes)
SELECT file_path, id, old_content, new_content FROM c WHERE old_content IS NULL OR old_content <> new_content""", "changes"))
def _(spark, sf):
    return st.suppress_noops(_changes(spark, sf))


@query("st8_failure_alerts", sql("""WITH s AS (SELECT *, sha256(file_path || ':' || regexp_replace(regexp_replace(message, '/[A-Za-z0-9_./-]+', '[PATH]', 'g'), '0x[0-9a-fA-F]+', '[HEX]', 'g')) AS signature FROM failures)
SELECT signature, count(*) AS frequency, count(*) >= 3 AS alert FROM s GROUP BY signature""", "failures"))
def _(spark, sf):
    return st.failure_stream(view(spark, sf, "failures")).drop("last_at")


@query("st9_step_alerts", sql("SELECT session_id, tool, path, count(*) AS n FROM steps GROUP BY ALL HAVING count(*) >= 2", "steps"))
def _(spark, sf):
    return st.step_alerts(view(spark, sf, "steps"), 2)


@query("st9_repeat_alerts", sql("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool, path ORDER BY step) AS k, sum(CASE WHEN tool IN ('write_file', 'patch_file') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, path ORDER BY step) AS w FROM steps)
SELECT session_id, step, tool, path, k AS n, 'stagnation' AS alert FROM c WHERE k % 2 = 0 UNION ALL SELECT session_id, step, tool, path, CAST(w AS BIGINT), 'oscillation' FROM c WHERE w >= 2 AND tool IN ('write_file', 'patch_file')""", "steps"))
def _(spark, sf):
    return st.repeat_alerts(view(spark, sf, "steps"), 2, 2)
