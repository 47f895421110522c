"""Graph, history and log views over the star-schema tables, for queries; with the same views as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB text of each view; Spark's text is made from it by the substitutions below.
VIEWS = {
    "g_nodes": """
SELECT 'r' || r_regionkey AS id, 'module' AS kind, r_name AS name, '/src/config/r' || (r_regionkey % 2) || '.ts' AS file_path, 'config' AS layer FROM region
UNION ALL SELECT 'n' || n_nationkey, 'interface', n_name, '/src/infra/n' || (n_nationkey % 5) || '.ts', 'infrastructure' FROM nation
UNION ALL SELECT 's' || s_suppkey, 'class', s_name, '/src/models/s' || (s_suppkey % 20) || '.ts', 'database' FROM supplier
UNION ALL SELECT 'p' || p_partkey, 'function', p_name, '/src/api/p' || (p_partkey % 100) || '.ts', 'api' FROM part
UNION ALL SELECT 'c' || c_custkey, 'component', c_name, '/src/views/c' || (c_custkey % 100) || '.tsx', 'frontend' FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'file', 'order ' || o_orderkey, '/src/services/o' || (o_orderkey % 500) || CASE WHEN o_orderkey % 10 = 0 THEN '.test.ts' ELSE '.ts' END, 'backend' FROM orders""",
    "g_edges": """
SELECT DISTINCT src, dst, kind FROM (
  SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'depends_on' AS kind FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'references' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'references' FROM customer
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'provides' FROM lineitem
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'uses_type' FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, CASE WHEN l_orderkey % 10 = 0 THEN 'tests' ELSE 'imports' END FROM lineitem
) e""",
    "cyc_edges": """
SELECT DISTINCT src, dst FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
  FROM lineitem
) x WHERE dst IS NOT NULL""",
    "changes": """
SELECT CAST(event_id AS VARCHAR) AS id, 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
       '/src/m' || (CAST(props->>'k' AS INTEGER) % 7) || '/f' || (props->>'k') || '.ts' AS file_path,
       ts AS applied_at, event_type = 'error' AS rolled_back, 'p' || (user_id % 4) AS provider,
       least(value / 100, CAST(1 AS DOUBLE)) AS confidence
FROM events""",
    "failures": """
SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'ai_timeout' WHEN 1 THEN 'test_regression' WHEN 2 THEN 'parse_error' ELSE 'model_outage' END AS category,
       '/src/f' || (props->>'k') || '.ts' AS file_path,
       'Crash ' || (event_id % 3) || ' at /srv/app/x' || user_id || '.ts:' || (event_id % 90) || ':7 addr 0xab' || (event_id % 10) AS message,
       ts
FROM events WHERE event_type = 'error'""",
    "calls": """
SELECT 'p' || (user_id % 4) AS provider, 'm' || (CAST(props->>'k' AS INTEGER) % 3) AS model, event_type <> 'error' AS ok,
       value * 10 AS latency_ms,
       CASE WHEN event_type <> 'error' THEN NULL ELSE CASE event_id % 5 WHEN 0 THEN '429 too many requests' WHEN 1 THEN 'model not found' WHEN 2 THEN 'internal server error' WHEN 3 THEN 'invalid api key' ELSE 'connection refused' END END AS error,
       CAST(floor(value) AS BIGINT) * 100 AS tokens, CAST(floor(value) AS DOUBLE) * 100 * CAST(0.0000005 AS DOUBLE) AS cost, ts, event_id AS seq
FROM events""",
    "steps": """
SELECT 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
       row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS step,
       CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'search_code' WHEN 'signup' THEN 'write_file' WHEN 'purchase' THEN 'patch_file' ELSE 'run_shell' END AS tool,
       'f' || (CAST(props->>'k' AS INTEGER) % 4) AS path, value < 40 AS success, CAST(floor(value) AS BIGINT) AS tokens, ts
FROM events""",
    "heartbeats": """
SELECT 't' || (user_id % 10) AS task_id, CASE event_type WHEN 'signup' THEN 'IDLE' WHEN 'error' THEN 'WAITING' ELSE 'EXECUTING' END AS status, ts, event_id AS seq FROM events""",
    "eval_metrics": """
SELECT session_id, 'profile' || least(min(tokens) // 15, 3) AS task_profile, sum(tokens) AS tokens,
       avg(CASE WHEN success THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS success_rate
FROM steps GROUP BY session_id""",
    "messages": "SELECT conv_id, turn, role, text AS content, CAST(length(text) AS DOUBLE) / 4 AS tokens FROM conversations",
    "chunks": """
SELECT e.vec_id AS id, '/' || d.source || '/l' || e.label AS file_path, d.text AS content, e.embedding AS embedding
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""",
    "files": """
SELECT '/' || source || '/' || CASE doc_id % 4 WHEN 0 THEN 'services' WHEN 1 THEN 'components' WHEN 2 THEN 'models' ELSE 'config' END
       || '/d' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.sql' WHEN 3 THEN '.tsx' ELSE '.yaml' END AS path,
       text AS content, substr(md5(text), 1, 12) AS hash
FROM documents""",
    "file_pairs": "SELECT doc_id, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS old_content, text AS new_content FROM documents",
    "compiler_log": """
SELECT 'src/m' || (user_id % 9) || '.ts(' || (props->>'k') || ',' || (event_id % 80) || '): ' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END
       || ' TS' || (2300 + event_id % 50) || ': value ' || user_id || ' is bad' AS line FROM events""",
    "commit_log": """
SELECT md5(CAST(event_id AS VARCHAR)) || '|user' || user_id || '|' || strftime(ts, '%Y-%m-%d') || ' 00:00:00 +0000|' || event_type || ' | part ' || event_id AS line FROM events""",
}
NEEDS = {"eval_metrics": ["steps"]}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Spark deals edges by their source before it makes them distinct, which then serves joins and groups by the source, too.
_DEALT = {"g_edges": "src"}
_SPARK = (("strftime(ts, '%Y-%m-%d')", "date_format(ts, 'yyyy-MM-dd')"), ("props->>'k'", "get_json_object(props, '$.k')"), ("min(tokens) // 15", "min(tokens) div 15"), ("AS VARCHAR", "AS STRING"), ("ORDER BY doc_id)", "ORDER BY doc_id NULLS LAST)"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; tables are bound by argument, so nothing is registered in the session."""
    text = VIEWS[name]
    for a, b in _SPARK:
        text = text.replace(a, b)
    used: dict[str, DataFrame] = {}
    for t in (*BASE, *NEEDS.get(name, [])):
        import re

        if re.search(rf"\b(FROM|JOIN) {t}\b", text):
            used[t] = table(spark, sf_dir, t) if t in BASE else view(spark, sf_dir, t)
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    if name in _DEALT:
        head, inner = text.split("FROM (", 1)
        inner, tail = inner.rsplit(") e", 1)
        return spark.sql(f"{head} FROM (SELECT /*+ REPARTITION({_DEALT[name]}) */ * FROM ({inner}) e) e{tail}", **used)
    return spark.sql(text, **used)


def sql(body: str, *views: str) -> str:
    """DuckDB text: the views it needs, then body, which may start with further common tables (`WITH ...`)."""
    names: list[str] = []
    for v in views:
        for n in (*NEEDS.get(v, []), v):
            if n not in names:
                names.append(n)
    body = body.strip()
    recursive = "RECURSIVE " if "RECURSIVE" in body[:20] else ""
    rest = body[len("WITH " + recursive) :] if body.startswith("WITH ") else None
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if rest is not None:
        return f"WITH {recursive}{head}{',' if head else ''}\n{rest}"
    return f"WITH {head}\n{body}" if head else body
