"""Queries on change history, failures, calls, steps and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.fixtures import sql, view
from graphloom.functions import text as x
from graphloom.operators import history as h
from graphloom.operators import telemetry as t
from graphloom.registry import query


def _q(name, body, *views):
    return query(name, sql(body, *views) if body else None)


@_q("w2_latest_change", "SELECT file_path, id, session_id, provider, confidence FROM changes WHERE NOT rolled_back QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY applied_at DESC, id DESC) = 1", "changes")
def _(spark, sf):
    return h.latest_change(view(spark, sf, "changes")).select("file_path", "id", "session_id", "provider", "confidence")


@_q("w2_active_changes", "SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY applied_at, id) AS place FROM changes WHERE NOT rolled_back", "changes")
def _(spark, sf):
    return h.active_changes(view(spark, sf, "changes"))


@_q("t4_recent_changes", "SELECT id, file_path, session_id FROM changes ORDER BY applied_at DESC, id DESC LIMIT 20", "changes")
def _(spark, sf):
    return h.newest(view(spark, sf, "changes"), 20).select("id", "file_path", "session_id")


@_q("t4_changes_by_file", "SELECT id, file_path, session_id FROM changes QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY applied_at DESC, id DESC) <= 50", "changes")
def _(spark, sf):
    return h.newest(view(spark, sf, "changes"), 50, "file_path").select("id", "file_path", "session_id")


@_q("t9_rollback_targets", "SELECT session_id, file_path, min_by(id, row(applied_at, id)) AS first_id, count(*) AS changes FROM changes WHERE NOT rolled_back GROUP BY ALL", "changes")
def _(spark, sf):
    return h.rollback_targets(view(spark, sf, "changes"))


_SESSIONS = """WITH r AS (SELECT * FROM changes WHERE NOT rolled_back ORDER BY applied_at DESC, id DESC LIMIT 300),
f AS (SELECT session_id, file_path, min(row(applied_at, id)) AS first, count(*) AS n, max(applied_at) AS last FROM r GROUP BY ALL),
s AS (SELECT session_id, list(file_path ORDER BY first, file_path) AS files, CAST(sum(n) AS BIGINT) AS changes, max(last) AS last_at FROM f GROUP BY session_id ORDER BY last_at DESC, session_id LIMIT 5)"""


@_q("a4_session_summary", f"{_SESSIONS} SELECT session_id, array_to_string(files, ',') AS files, changes, (epoch_us(last_at) // 1000) AS last_ms FROM s", "changes")
def _(spark, sf):
    s = h.session_summary(view(spark, sf, "changes"))
    return s.select("session_id", F.array_join("files", ",").alias("files"), "changes", F.unix_millis("last_at").alias("last_ms"))


@_q("d6_session_digest", f"{_SESSIONS} SELECT session_id, strftime(last_at, '%Y-%m-%d %H:%M') || ' ' || changes || ' changes: ' || array_to_string(files[1:4], ', ') || CASE WHEN len(files) > 4 THEN ' +' || (len(files) - 4) || ' more' ELSE '' END AS line FROM s", "changes")
def _(spark, sf):
    return h.session_digest(h.session_summary(view(spark, sf, "changes")))


@_q("a5_hot_files", "SELECT file_path, count(*) AS changes FROM changes GROUP BY file_path ORDER BY changes DESC, file_path LIMIT 8", "changes")
def _(spark, sf):
    return h.hot_files(view(spark, sf, "changes"))


@_q("a6_recurring_failures", "SELECT file_path, count(*) AS n, substr(max(message), 1, 100) AS message FROM failures GROUP BY file_path HAVING count(*) >= 2 ORDER BY n DESC, file_path LIMIT 6", "failures")
def _(spark, sf):
    return h.recurring_failures(view(spark, sf, "failures"))


_SIGNED = "WITH s AS (SELECT *, sha256(file_path || ':' || regexp_replace(regexp_replace(message, '/[A-Za-z0-9_./-]+', '[PATH]', 'g'), '0x[0-9a-fA-F]+', '[HEX]', 'g')) AS signature FROM failures)"


@_q("a7_failure_signatures", f"{_SIGNED} SELECT signature, count(*) AS frequency, min_by(id, row(ts, id)) AS first_id, max_by(message, row(ts, id)) AS last_message FROM s GROUP BY signature", "failures")
def _(spark, sf):
    return h.failure_signatures(view(spark, sf, "failures")).drop("last_at")


@_q("a8_frequent_failures", f"{_SIGNED} SELECT signature, count(*) AS frequency FROM s GROUP BY signature HAVING count(*) >= 3", "failures")
def _(spark, sf):
    return h.failure_signatures(view(spark, sf, "failures")).where("frequency >= 3").select("signature", "frequency")


@_q("c7_failure_actions", f"""{_SIGNED}, r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY ts, id) >= 3 AS recurring FROM s)
SELECT id, CASE WHEN recurring THEN 'Analyse the root cause' WHEN category = 'test_regression' THEN 'Revert the change' WHEN category = 'ai_timeout' THEN 'Use a faster model or a longer timeout'
 WHEN category = 'parse_error' THEN 'Check the syntax of the output or refine constraints' ELSE 'Switch to a fallback provider' END AS suggested, category = 'test_regression' AND NOT recurring AS auto_fix, recurring FROM r""", "failures")
def _(spark, sf):
    return h.failure_actions(view(spark, sf, "failures"))


@_q("a15_module_map", """WITH p AS (SELECT path, string_split(ltrim(path, '/'), '/') AS s FROM files), m AS (SELECT s[1] AS module, path FROM p WHERE len(s) BETWEEN 2 AND 4 QUALIFY row_number() OVER (PARTITION BY s[1] ORDER BY path) <= 5)
SELECT module, path, contains(path, '.ts') AS is_active FROM m""", "files")
def _(spark, sf):
    f = view(spark, sf, "files")
    return h.module_map(f, f.where("contains(path, '.ts')"))


@_q("a9_session_metrics", "SELECT session_id, (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS duration_ms, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(CAST(success AS INTEGER)), 6) AS success_rate, round(CAST(sum(tokens) AS DOUBLE) * 5e-7, 9) AS cost, count(*) AS steps FROM steps GROUP BY session_id", "steps")
def _(spark, sf):
    return t.session_metrics(view(spark, sf, "steps"))


@_q("a10_underperforming_profiles", "SELECT task_profile, count(*) AS sessions, round(avg(success_rate), 6) AS success_rate, count(*) >= 5 AND avg(success_rate) < 0.6 AS raise_tier FROM eval_metrics GROUP BY task_profile", "eval_metrics")
def _(spark, sf):
    return t.underperforming_profiles(view(spark, sf, "eval_metrics"))


@_q("a11_usage_report", "SELECT provider, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost, coalesce(sum(cost) >= CASE provider WHEN 'p0' THEN 0.01 WHEN 'p1' THEN 1e6 END, false) AS over_budget FROM calls GROUP BY provider", "calls")
def _(spark, sf):
    return t.usage_report(view(spark, sf, "calls"), {"p0": 0.01, "p1": 1e6})


@_q("c8_classify_errors", """WITH c AS (SELECT seq, CASE WHEN contains(error, 'api key') THEN 'AUTH_ERROR' WHEN contains(error, '429') THEN 'RATE_LIMIT' WHEN contains(error, 'model not found') THEN 'MODEL_NOT_FOUND' WHEN contains(error, 'connection') THEN 'NETWORK_ERROR' WHEN contains(error, 'internal server error') THEN 'SERVER_ERROR' ELSE 'UNKNOWN' END AS code FROM calls WHERE NOT ok)
SELECT seq, code, code IN ('RATE_LIMIT', 'SERVER_ERROR', 'NETWORK_ERROR') AS retryable, code IN ('AUTH_ERROR', 'MODEL_NOT_FOUND', 'QUOTA_EXCEEDED') AS fatal FROM c""", "calls")
def _(spark, sf):
    return t.classify_errors(view(spark, sf, "calls"))


_HEALTH = """WITH i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY provider ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS isl FROM calls),
n AS (SELECT *, CAST(sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY provider, isl ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consecutive,
  avg(CAST(ok AS INTEGER)) OVER (PARTITION BY provider ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS rate, coalesce(contains(error, '429'), false) AS lim FROM i),
o AS (SELECT *, CASE WHEN ok THEN 'HEALTHY' WHEN lim AND consecutive >= 3 THEN 'CIRCUIT_BROKEN' WHEN lim OR consecutive >= 2 THEN 'DEGRADED' END AS own,
  CAST(CASE WHEN ok THEN NULL WHEN lim THEN 15000 * pow(3, least(consecutive - 1, 2)) WHEN consecutive >= 2 THEN 30000 END AS BIGINT) AS cooldown_ms FROM n),
s AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY provider, isl ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 'HEALTHY') AS status FROM o)"""


@_q("w3_provider_health", f"{_HEALTH} SELECT provider, seq, consecutive, status, cooldown_ms, round(rate, 6) AS success_rate, round(CASE WHEN status = 'CIRCUIT_BROKEN' OR cooldown_ms IS NOT NULL THEN 0 ELSE greatest(0.1, rate - consecutive * 0.2) END, 6) AS weight FROM s", "calls")
def _(spark, sf):
    return t.provider_health(view(spark, sf, "calls"))


@_q("a20_provider_summary", f"{_HEALTH} SELECT provider, count(*) AS calls, round(avg(CAST(ok AS INTEGER)), 2) AS success_rate, max_by(status, row(ts, seq)) AS status FROM s GROUP BY provider", "calls")
def _(spark, sf):
    return t.provider_summary(view(spark, sf, "calls"))


_MODEL = """WITH m AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY provider, model ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS isl, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY provider ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS pisl,
  CASE WHEN ok THEN row_number() OVER (PARTITION BY provider, model, ok ORDER BY ts DESC, seq DESC) END AS back FROM calls),
n AS (SELECT *, CAST(sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY provider, model, isl ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY provider, pisl ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS pc FROM m),
e AS (SELECT provider, model, max_by(ok, row(ts, seq)) AS ok, max_by(coalesce(error, ''), row(ts, seq)) AS error, max_by(c, row(ts, seq)) AS c, max_by(pc, row(ts, seq)) AS pc,
  2000 * pow(0.7, count(*) FILTER (ok)) + coalesce(sum(0.3 * latency_ms * pow(0.7, back - 1)) FILTER (ok), 0) AS lat FROM n GROUP BY provider, model),
hm AS (SELECT provider, model, c AS consecutive, round(lat, 4) AS latency_avg, CASE WHEN ok THEN 'HEALTHY' WHEN contains(error, '429') THEN 'COOLDOWN' WHEN contains(error, 'model not found') THEN 'FAILED' ELSE 'DEGRADED' END AS status,
  CAST(floor(CASE WHEN ok THEN NULL WHEN contains(error, '429') THEN 45000 * pow(1.5, least(c - 1, 3)) WHEN contains(error, 'model not found') THEN NULL ELSE 15000 END) AS BIGINT) AS cooldown_ms, pc >= 3 AS blackout,
  CAST(CASE WHEN pc >= 3 OR NOT ok THEN 0 ELSE greatest(0, 100 - c * 10) END AS BIGINT) AS score FROM e)"""


@_q("w4_model_health", f"{_MODEL} SELECT * FROM hm", "calls")
def _(spark, sf):
    return t.model_health(view(spark, sf, "calls"))


@_q("t8_model_order", f"""{_MODEL}, r AS (SELECT provider, model, row_number() OVER (ORDER BY score - 20 * CASE model WHEN 'm1' THEN 1 WHEN 'm2' THEN 2 ELSE 0 END DESC, provider, model) AS r FROM hm WHERE score > 0),
x AS (SELECT (SELECT provider FROM r WHERE r = 1) AS a, (SELECT provider FROM r WHERE r = 2) AS b, (SELECT min(r) FROM r WHERE provider <> (SELECT provider FROM r WHERE r = 1)) AS o)
SELECT provider, model, CAST(CASE WHEN a IS DISTINCT FROM b OR o IS NULL THEN r WHEN r = o THEN 2 WHEN r >= 2 AND r < o THEN r + 1 ELSE r END AS INTEGER) AS rank FROM r, x""", "calls")
def _(spark, sf):
    return t.model_order(t.model_health(view(spark, sf, "calls")), {"m1": 1, "m2": 2})


@_q("w12_diversify", """WITH r AS (SELECT provider, model, CAST(row_number() OVER (ORDER BY provider, count(*) DESC, model) AS INTEGER) AS r FROM calls GROUP BY provider, model),
o AS (SELECT min(r) AS o FROM r WHERE provider <> 'p0') SELECT provider, model, CAST(CASE WHEN r = o THEN 2 WHEN r >= 2 AND r < o THEN r + 1 ELSE r END AS INTEGER) AS rank FROM r, o""", "calls")
def _(spark, sf):
    n = view(spark, sf, "calls").groupBy("provider", "model").count()
    return t.diversify(n.select("provider", "model", F.row_number().over(Window.orderBy("provider", F.desc("count"), "model")).alias("rank")))


@_q("w5_circuit_states", """WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ms, seq) AS n FROM (SELECT provider, seq, ok, epoch_us(ts) // 1000 AS ms FROM calls WHERE ok OR NOT (contains(lower(error), 'rate limit') OR contains(lower(error), '429') OR contains(lower(error), 'too many requests'))) x),
r AS (SELECT DISTINCT provider, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 'CLOSED' AS state, 0 AS failed, 0 AS good, CAST(0 AS BIGINT) AS since FROM c
  UNION ALL SELECT provider, n, seq, CASE WHEN NOT ok THEN CASE WHEN h = 'HALF_OPEN' OR failed + 1 >= 5 THEN 'OPEN' ELSE h END WHEN h = 'HALF_OPEN' AND g + 1 >= 2 THEN 'CLOSED' ELSE h END,
    CASE WHEN NOT ok THEN failed + 1 WHEN h = 'HALF_OPEN' AND g + 1 < 2 THEN failed ELSE 0 END, CASE WHEN ok AND h = 'HALF_OPEN' THEN g + 1 ELSE g END, CASE WHEN ok THEN since ELSE ms END
  FROM (SELECT c.*, failed, since, CASE WHEN state = 'OPEN' AND ms - since >= 60000 THEN 'HALF_OPEN' ELSE state END AS h, CASE WHEN state = 'OPEN' AND ms - since >= 60000 THEN 0 ELSE good END AS g FROM r JOIN c ON c.provider = r.provider AND c.n = r.n + 1) y)
SELECT provider, seq, state FROM r WHERE n > 0""", "calls")
def _(spark, sf):
    return t.circuit_states(view(spark, sf, "calls"))


@_q("w13_admission_audit", """SELECT seq, CASE WHEN coalesce(round(sum(cost) OVER (PARTITION BY provider ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9), 0) >= 1.0 THEN 'too_expensive'
 WHEN (epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER (PARTITION BY provider ORDER BY ts, seq)) // 1000) < 1000 THEN 'too_soon' END AS refused FROM calls""", "calls")
def _(spark, sf):
    return t.admission_audit(view(spark, sf, "calls"), 1.0, 60)


@_q("a17_stagnation", "SELECT * FROM (SELECT session_id, step, tool, path, row_number() OVER (PARTITION BY session_id, tool, path ORDER BY step) AS n FROM steps) x WHERE n % 3 = 0", "steps")
def _(spark, sf):
    return t.stagnation(view(spark, sf, "steps"))


@_q("a18_oscillating_files", "SELECT session_id, step, path, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY step) AS n FROM steps WHERE tool IN ('write_file', 'patch_file')) x WHERE n >= 2", "steps")
def _(spark, sf):
    return t.oscillating_files(view(spark, sf, "steps"), 2)


@_q("w11_recent_steps", "SELECT session_id, step, tool, row_number() OVER (PARTITION BY session_id ORDER BY step DESC) AS rn FROM steps QUALIFY rn <= 3", "steps")
def _(spark, sf):
    return t.recent_steps(view(spark, sf, "steps"), 3)


@_q("w14_modification_confidence", """WITH x AS (SELECT *, coalesce(sum(CAST(tool IN ('write_file', 'patch_file') AS INTEGER)) OVER w, 0) AS mods, coalesce(max(CAST(tool = 'read_file' AS INTEGER)) OVER w, 0) AS rd FROM steps
 WINDOW w AS (PARTITION BY session_id, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, step, round(greatest(0.1, least(1.0, CAST(0.9 AS DOUBLE) - CASE WHEN rd = 1 THEN 0 ELSE CAST(0.3 AS DOUBLE) END - CASE WHEN mods > 3 THEN CAST(0.2 AS DOUBLE) WHEN mods > 1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END - CASE WHEN step <= 2 THEN CAST(0.1 AS DOUBLE) ELSE 0 END)), 6) AS confidence FROM x WHERE tool IN ('write_file', 'patch_file')""", "steps")
def _(spark, sf):
    return t.modification_confidence(view(spark, sf, "steps"))


@_q("st7_stalled_tasks", "SELECT task_id, seq, silent_ms FROM (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY task_id ORDER BY ts, seq)) // 1000) - (epoch_us(ts) // 1000) AS silent_ms FROM heartbeats) x WHERE silent_ms >= 60000 AND status NOT IN ('IDLE', 'STALLED')", "heartbeats")
def _(spark, sf):
    return t.stalled_tasks(view(spark, sf, "heartbeats"))


_FACTS = "WITH facts AS (SELECT session_id, path || tool || step AS key, tool = 'write_file' AS pinned, step AS last_step FROM steps)"


def _facts(spark, sf):
    return view(spark, sf, "steps").select("session_id", F.concat("path", "tool", F.col("step").cast("string")).alias("key"), (F.col("tool") == "write_file").alias("pinned"), F.col("step").alias("last_step"))


@_q("w9_retain_facts", f"{_FACTS} SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pinned DESC, last_step DESC, key) <= 2", "steps")
def _(spark, sf):
    return t.retain_facts(_facts(spark, sf), 2)


@_q("w9_evict_facts", f"""{_FACTS} SELECT session_id, key, pinned, last_step FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS s, row_number() OVER (PARTITION BY session_id, pinned ORDER BY last_step, key) AS o FROM facts) x WHERE NOT (s > 3 AND NOT pinned AND o <= 1)""", "steps")
def _(spark, sf):
    return t.evict_facts(_facts(spark, sf), 3, 1)


@_q("w10_dedupe_constraints", """SELECT session_id, step, value FROM (SELECT session_id, substr(value, 1, 500) AS value, step, row_number() OVER (PARTITION BY session_id ORDER BY step DESC, value) AS r FROM (
 SELECT session_id, value, step FROM (SELECT conv_id AS session_id, turn AS step, content AS value FROM messages) m QUALIFY row_number() OVER (PARTITION BY session_id, substr(value, 1, 40) ORDER BY step, value) = 1) y) x WHERE r <= 10""", "messages")
def _(spark, sf):
    m = view(spark, sf, "messages").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("step"), F.col("content").alias("value"))
    return t.dedupe_constraints(m)


@_q("a19_rank_hypotheses", """WITH hy AS (SELECT id, file_path AS failure_id, (id % 100) / CAST(100 AS DOUBLE) AS confidence, id % 3 = 0 AS systemic FROM failures), te AS (SELECT id, avg(CAST(ok AS INTEGER)) AS rate FROM (SELECT seq + 1 AS id, ok FROM calls) c GROUP BY id),
s AS (SELECT failure_id, id, round(least(100, confidence * 100 + CASE WHEN systemic THEN 10 ELSE 0 END + coalesce(rate * 50, 25)), 6) AS score FROM hy LEFT JOIN te USING (id))
SELECT failure_id, id, score, row_number() OVER (PARTITION BY failure_id ORDER BY score DESC, id) AS rank FROM s""", "failures", "calls")
def _(spark, sf):
    hy = view(spark, sf, "failures").select("id", F.col("file_path").alias("failure_id"), (F.pmod("id", F.lit(100)) / 100.0).alias("confidence"), (F.col("id") % 3 == 0).alias("systemic"))
    return t.rank_hypotheses(hy, view(spark, sf, "calls").select((F.col("seq") + 1).alias("hypothesis_id"), F.col("ok").alias("passed")))


@_q("a21_task_outcomes", """WITH r AS (SELECT session_id, id AS task_id, CASE WHEN rolled_back THEN 'failed' WHEN confidence < 0.1 THEN 'skipped' ELSE 'applied' END AS status, confidence FROM changes WHERE CAST(id AS BIGINT) % 5 <> 0),
p AS (SELECT session_id, count(*) AS pending FROM changes WHERE CAST(id AS BIGINT) % 5 = 0 GROUP BY session_id),
d AS (SELECT session_id, count(*) FILTER (status = 'applied' AND confidence >= 0.3) AS applied, count(*) FILTER (status = 'applied' AND confidence < 0.3) AS low_confidence, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM r GROUP BY session_id)
SELECT session_id, coalesce(pending, 0) AS pending, coalesce(applied, 0) AS applied, coalesce(low_confidence, 0) AS low_confidence, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped FROM d FULL JOIN p USING (session_id)""", "changes")
def _(spark, sf):
    c = view(spark, sf, "changes")
    done = c.where("cast(id as bigint) % 5 <> 0").select("session_id", F.col("id").alias("task_id"), F.when(F.col("rolled_back"), "failed").when(F.col("confidence") < 0.1, "skipped").otherwise("applied").alias("status"), "confidence")
    return t.task_outcomes(c.select("session_id", F.col("id").alias("task_id")), done, 0.3)


@_q("t9_rollback_restores", """WITH c AS (SELECT *, 'before ' || id AS original_content, row_number() OVER (PARTITION BY file_path ORDER BY applied_at DESC, id DESC) AS rn FROM changes WHERE NOT rolled_back)
SELECT file_path, original_content AS restore_content FROM c WHERE rn = 1""", "changes")
def _(spark, sf):
    c = view(spark, sf, "changes").withColumn("original_content", F.concat(F.lit("before "), "id"))
    return h.rollback(c, h.latest_change(c).select("id"))[1]


@_q("t9_rolled_back", """SELECT id, rolled_back OR coalesce(session_id = (SELECT min(session_id) FROM changes), false) AS rolled_back FROM changes""", "changes")
def _(spark, sf):
    c = view(spark, sf, "changes").withColumn("original_content", F.lit(None).cast("string"))
    first = c.agg(F.min("session_id").alias("session_id"))
    return h.rollback(c, c.join(first, "session_id").select("id"))[0].select("id", "rolled_back")


@_q("a9_session_outcomes", """WITH r AS (SELECT session_id, avg(CAST(success AS INTEGER)) AS rate FROM steps WHERE tool <> 'run_shell' GROUP BY session_id),
s AS (SELECT session_id, bool_or(success) AS success, bool_or(tool = 'patch_file' AND NOT success) AS outage, bool_or(tool = 'run_shell') AS told FROM steps GROUP BY session_id)
SELECT session_id, round(coalesce(rate, CAST(success AS INTEGER)), 6) AS success_rate, outage OR told AS regression FROM s LEFT JOIN r USING (session_id)""", "steps")
def _(spark, sf):
    s = view(spark, sf, "steps")
    sessions = s.groupBy("session_id").agg(F.bool_or("success").alias("success"), F.bool_or((F.col("tool") == "patch_file") & ~F.col("success")).alias("outage"))
    tasks = s.select("session_id", F.when(F.col("tool") == "run_shell", F.concat(F.lit("regression in "), "path")).otherwise(F.concat(F.lit("edit "), "path")).alias("text"))
    return t.session_outcomes(sessions, s.where("tool <> 'run_shell'"), tasks)


@_q("t8_provider_order", f"""{_HEALTH}, l AS (SELECT provider, max_by(CASE WHEN status = 'CIRCUIT_BROKEN' OR cooldown_ms IS NOT NULL THEN 0 ELSE greatest(0.1, round(rate, 6) - consecutive * 0.2) END, row(ts, seq)) AS weight FROM s GROUP BY provider),
p AS (SELECT 'p' || i AS provider, CASE WHEN i < 3 THEN 1 ELSE 2 END AS tier FROM range(0, 5) r(i))
SELECT provider, row_number() OVER (ORDER BY provider <> 'p3', tier, coalesce(weight, 1) DESC, provider) AS rank FROM p LEFT JOIN l USING (provider) WHERE coalesce(weight, 1) > 0""", "calls")
def _(spark, sf):
    return t.provider_order(view(spark, sf, "calls"), {"p0": 1, "p1": 1, "p2": 1, "p3": 2, "p4": 2}, "p3")


@_q("a21_remaining_errors", """WITH a AS (SELECT DISTINCT session_id, file_path FROM changes WHERE NOT rolled_back), e AS (SELECT file_path, count(*) AS n FROM failures GROUP BY file_path)
SELECT session_id, count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS errors FROM a LEFT JOIN e ON e.file_path = '/src/f' || regexp_extract(a.file_path, 'f([0-9]+)', 1) || '.ts' GROUP BY session_id""", "changes", "failures")
def _(spark, sf):
    number = F.regexp_extract("file_path", "f([0-9]+)", 1)
    results = view(spark, sf, "changes").select("session_id", F.concat(F.lit("/src/f"), number, F.lit(".ts")).alias("file_path"), F.when(F.col("rolled_back"), "failed").otherwise("applied").alias("status"))
    return t.remaining_errors(results, view(spark, sf, "failures").groupBy(F.col("file_path").alias("file")).agg(F.count("*").alias("errors")))


@_q("w8_compression_steps", """WITH RECURSIVE l AS (SELECT session_id, step FROM (SELECT session_id, step, sum(tokens) OVER (PARTITION BY session_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS n FROM steps) x WHERE n > 20),
c AS (SELECT session_id, min(step) AS step FROM l WHERE step >= 2 GROUP BY session_id
UNION ALL SELECT session_id, step FROM (SELECT l.session_id, l.step, row_number() OVER (PARTITION BY l.session_id ORDER BY l.step) AS rn FROM c JOIN l ON l.session_id = c.session_id AND l.step >= c.step + 2) y WHERE rn = 1)
SELECT session_id, step FROM c""", "steps")
def _(spark, sf):
    upto = Window.partitionBy("session_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    s = view(spark, sf, "steps").select("session_id", "step", F.sum("tokens").over(upto).alias("length"))
    return x.compression_steps(s, 2, 20)


@_q("d3_valid_tasks", """WITH t AS (SELECT id, CASE CAST(id AS BIGINT) % 7 WHEN 0 THEN '' WHEN 1 THEN '/src/Example.js' WHEN 2 THEN 'Absolute Path here' WHEN 3 THEN 'src' || chr(92) || 'a' WHEN 4 THEN 'name' WHEN 5 THEN NULL ELSE file_path END AS target_file, CASE WHEN rolled_back THEN '' ELSE provider END AS description FROM changes)
SELECT id, target_file FROM t WHERE description <> '' AND CAST(id AS BIGINT) % 7 IN (3, 6)""", "changes")
def _(spark, sf):
    k = F.col("id").cast("long") % 7
    target = F.when(k == 0, "").when(k == 1, "/src/Example.js").when(k == 2, "Absolute Path here").when(k == 3, "src\\a").when(k == 4, "name").when(k == 5, None).otherwise(F.col("file_path"))
    tasks = view(spark, sf, "changes").select("id", target.alias("target_file"), F.when(F.col("rolled_back"), "").otherwise(F.col("provider")).alias("description"))
    return x.valid_tasks(tasks).select("id", "target_file")
