"""Agent steps, model calls, budgets and session facts: folds in order of time as windows over islands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import scan
from graphloom.operators.breaker import Breaker
from graphloom.tables import written

#: Message fragments of provider errors, first match wins; then which codes may be retried or are fatal.
ERROR_RULES = (
    ("AUTH_ERROR", ("invalid api key", "incorrect api key", "authentication", "unauthorized", "permission denied", "api key")),
    ("RATE_LIMIT", ("429", "rate limit", "too many requests", "requests per minute", "quota")),
    ("MODEL_NOT_FOUND", ("model not found", "no such model", "does not exist", "invalid model")),
    ("QUOTA_EXCEEDED", ("billing", "payment", "subscription", "exceeded your current quota")),
    ("CONTEXT_TOO_LONG", ("context length", "too long", "token limit", "max tokens", "context window")),
    ("CONTENT_FILTERED", ("content policy", "safety", "filtered", "blocked", "harmful")),
    ("NETWORK_ERROR", ("econnrefused", "enotfound", "etimedout", "network", "fetch failed", "connection")),
    ("SERVER_ERROR", ("500", "502", "503", "overloaded", "service unavailable", "internal server error")),
)
STATUS_RULES = ((401, "AUTH_ERROR"), (403, "AUTH_ERROR"), (402, "QUOTA_EXCEEDED"), (404, "MODEL_NOT_FOUND"), (429, "RATE_LIMIT"))
RETRYABLE, FATAL = ("RATE_LIMIT", "SERVER_ERROR", "NETWORK_ERROR"), ("AUTH_ERROR", "MODEL_NOT_FOUND", "QUOTA_EXCEEDED")
RATE_WORDS = ("rate limit", "429", "too many requests")
WRITES = ("write_file", "patch_file")


def _has(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.lower(c).contains(w), F.lit(False))
    return out


def classify_errors(calls: DataFrame) -> DataFrame:
    """seq, code, retryable, fatal of failed calls; a status column counts before the message where there is one."""
    code = F.lit("UNKNOWN")
    for name, words in reversed(ERROR_RULES):
        code = F.when(_has(F.col("error"), words), name).otherwise(code)
    if "status" in calls.columns:
        code = F.when(F.col("status") >= 500, "SERVER_ERROR").otherwise(code)
        for status, name in STATUS_RULES:
            code = F.when(F.col("status") == status, name).otherwise(code)
    return calls.where("not ok").select("seq", code.alias("code")).select("seq", "code", F.col("code").isin(*RETRYABLE).alias("retryable"), F.col("code").isin(*FATAL).alias("fatal"))


#: Calls in order of time.
ORDER = ("ts", "seq")


def provider_health(calls: DataFrame) -> DataFrame:
    """After each call: consecutive failures, status, cooldown in ms, weight, success rate so far.

    A rate limit cools down 15 s, 45 s, then 135 s and breaks the circuit from the third failure; others degrade for
    30 s from the second. A failure that sets no status keeps the one before. weight is 0 while cooling or broken.
    """
    key = ("provider",)
    counts = scan.sums(good=F.col("ok").cast("long"), all=F.lit(1).cast("long"))
    c = scan.folded(scan.cut(calls, "provider", *ORDER), key, ORDER, scan.runs("ok", "consecutive"), counts)
    limited = _has(F.col("error"), RATE_WORDS)
    n = F.col("consecutive")
    own_cool = F.when(~F.col("ok") & limited, F.lit(15000) * F.pow(F.lit(3.0), F.least(n - 1, F.lit(2)))).when(~F.col("ok") & (n >= 2), 30000.0)
    own_status = F.when(F.col("ok"), "HEALTHY").when(limited & (n >= 3), "CIRCUIT_BROKEN").when(limited | (n >= 2), "DEGRADED")
    # a success sets a status, so the last one set is never from before it
    c = scan.folded(c.withColumn("cooldown_ms", own_cool.cast("long")), key, ORDER, scan.latest(own_status, "status"))
    c = c.withColumn("status", F.coalesce("status", F.lit("HEALTHY"))).withColumn("success_rate", F.col("good") / F.col("all"))
    blocked = (F.col("status") == "CIRCUIT_BROKEN") | F.col("cooldown_ms").isNotNull()
    weight = F.when(blocked, 0.0).otherwise(F.greatest(F.lit(0.1), F.col("success_rate") - F.col("consecutive") * 0.2))
    return c.select("provider", "seq", "consecutive", "status", "cooldown_ms", F.round("success_rate", 6).alias("success_rate"), F.round(weight, 6).alias("weight"))


def provider_summary(calls: DataFrame) -> DataFrame:
    """provider, calls, success_rate (two digits), status after the last call."""
    last = provider_health(calls).join(calls.select("seq", "ts"), "seq").groupBy("provider").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))
    return calls.groupBy("provider").agg(F.count("*").alias("calls"), F.round(F.avg(F.col("ok").cast("double")), 2).alias("success_rate")).join(last, "provider")


def model_health(calls: DataFrame, start_ms: float = 2000.0) -> DataFrame:
    """After the last call of each (provider, model): consecutive failures, latency average, status, cooldown, score.

    Latency of successes is smoothed 0.7 to 0.3 from start_ms. A rate limit cools down 45 s times 1.5 for each earlier
    failure, three at most; a missing model fails for good; other failures degrade for 15 s. score is 100 less 10 for
    each failure and 30 if degraded, and 0 while cooling, failed, or while the provider is blacked out.
    """
    key = ("provider", "model")
    c = scan.folded(scan.cut(calls, "provider", *ORDER), ("provider",), ORDER, scan.runs("ok", "provider_failures"))
    c = scan.folded(c, key, ORDER, scan.runs("ok", "consecutive"))
    # the smoothed average is a sum with weights 0.3 * 0.7^k, k successes later: those of the same range, then the others
    w = Window.partitionBy(*key, scan.PART, "ok").orderBy(F.desc("ts"), F.desc("seq"))
    c = c.withColumn("weighted", F.when(F.col("ok"), F.col("latency_ms") * 0.3 * F.pow(F.lit(0.7), F.row_number().over(w) - 1)))
    parts = c.groupBy(*key, scan.PART).agg(
        F.max(F.struct(*ORDER, "ok", "error", "consecutive", "provider_failures")).alias("l"),
        F.coalesce(F.sum("weighted"), F.lit(0.0)).alias("recent"),
        F.count_if("ok").alias("successes"),
    )
    later = F.coalesce(F.sum("successes").over(Window.partitionBy(*key).orderBy(F.desc(scan.PART)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("recent", F.col("recent") * F.pow(F.lit(0.7), later))
    agg = parts.groupBy(*key).agg(F.max("l").alias("l"), F.sum("recent").alias("recent"), F.sum("successes").alias("successes"))
    ewma = F.lit(start_ms) * F.pow(F.lit(0.7), F.col("successes")) + F.col("recent")
    n, limited = F.col("l.consecutive"), _has(F.col("l.error"), ("rate limit", "429"))
    missing = _has(F.col("l.error"), ("model not found", "404"))
    status = F.when(F.col("l.ok"), "HEALTHY").when(limited, "COOLDOWN").when(missing, "FAILED").otherwise("DEGRADED")
    cool = F.when(F.col("l.ok") | (missing & ~limited), None).when(limited, 45000 * F.pow(F.lit(1.5), F.least(n - 1, F.lit(3)))).otherwise(15000)
    black = F.col("l.provider_failures") >= 3
    score = F.when(black | ~F.col("l.ok"), 0).otherwise(F.greatest(F.lit(0), 100 - n * 10))
    return agg.select("provider", "model", n.alias("consecutive"), F.round(ewma, 4).alias("latency_avg"), status.alias("status"), cool.cast("long").alias("cooldown_ms"), black.alias("blackout"), score.cast("long").alias("score"))


def circuit_states(calls: DataFrame, threshold: int = 5, cooldown_ms: int = 60_000, probes: int = 2) -> DataFrame:
    """(provider, seq, state): the breaker after each call that does not fail for a rate limit, in order of time.

    A provider's calls are cut into ranges. Each range is folded for every state that the breaker may enter it with, which
    gives a map from entry to exit; the maps are applied in order, a row a range; then every range is replayed from its
    own entry. A null provider is a provider.
    """
    made = Breaker(threshold, cooldown_ms, probes)
    counted = calls.where(F.col("ok") | ~_has(F.col("error"), RATE_WORDS)).select("provider", "seq", "ok", F.unix_millis("ts").alias("ms"))
    rows = scan.cut(counted, "provider", "ms", "seq")
    kinds = f"provider {dict(calls.dtypes)['provider']}, {scan.PART} int"

    def summed(pdf):
        pdf = pdf.sort_values(["ms", "seq"])
        limits, exits = made.map_of(pdf["ms"].tolist(), pdf["ok"].tolist())
        return pdf[["provider", scan.PART]].head(1).assign(limits=[limits], exits=[[v for s in exits for v in s]])

    def composed(pdf):
        pdf = pdf.sort_values(scan.PART)
        state, enters = made.START, []
        for limits, exits in zip(pdf["limits"], pdf["exits"], strict=True):
            enters.append(list(state))
            state = made.through(state, list(limits), [tuple(exits[i : i + 3]) for i in range(0, len(exits), 3)])
        return pdf[["provider", scan.PART]].assign(enters=enters)

    def replayed(pdf):
        pdf = pdf.sort_values(["ms", "seq"])
        state, out = tuple(pdf["enters"].iloc[0]), []
        for ms, ok in zip(pdf["ms"], pdf["ok"], strict=True):
            state = made.step(state, ms, ok)
            out.append(made.NAMES[state[0]])
        return pdf[["provider", "seq"]].assign(state=out)

    maps = written(rows.groupBy("provider", scan.PART).applyInPandas(summed, f"{kinds}, limits array<long>, exits array<long>"))
    entries = written(maps.groupBy("provider").applyInPandas(composed, f"{kinds}, enters array<long>"))
    same = rows["provider"].eqNullSafe(entries["provider"]) & (rows[scan.PART] == entries[scan.PART])
    given = rows.join(entries, same).select(rows["provider"], rows[scan.PART], "seq", "ok", "ms", "enters")
    return given.groupBy("provider", scan.PART).applyInPandas(replayed, f"provider {dict(calls.dtypes)['provider']}, seq long, state string")


def session_metrics(steps: DataFrame, price: float = 5e-7) -> DataFrame:
    return steps.groupBy("session_id").agg(
        (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("duration_ms"), F.sum("tokens").alias("tokens"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), F.round(F.sum("tokens") * price, 9).alias("cost"), F.count("*").alias("steps")
    )


#: Words in a session's task list that tell of a regression.
REGRESSION_WORDS = ("test fail", "regression")


def session_outcomes(sessions: DataFrame, steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """(session_id, success_rate, regression) of sessions(session_id, success, outage) and tasks(session_id, text).

    A session without steps has rate 1 if it succeeded, else 0. An outage, or a task that speaks of a regression, is one.
    """
    rate = steps.groupBy("session_id").agg(F.avg(F.col("success").cast("double")).alias("rate"))
    told = F.max(reduce(lambda a, b: a | b, [F.col("text").contains(w) for w in REGRESSION_WORDS])).alias("told")
    out = sessions.join(rate, "session_id", "left").join(tasks.groupBy("session_id").agg(told), "session_id", "left")
    plain = F.coalesce(F.col("success").cast("double"), F.lit(0.0))
    flag = F.coalesce("outage", F.lit(False)) | F.coalesce("told", F.lit(False))
    return out.select("session_id", F.round(F.coalesce("rate", plain), 6).alias("success_rate"), flag.alias("regression"))


def underperforming_profiles(metrics: DataFrame, least: int = 5, below: float = 0.6) -> DataFrame:
    m = metrics.groupBy("task_profile").agg(F.count("*").alias("sessions"), F.avg("success_rate").alias("r"))
    return m.select("task_profile", "sessions", F.round("r", 6).alias("success_rate"), ((F.col("sessions") >= least) & (F.col("r") < below)).alias("raise_tier"))


def usage_report(calls: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """provider, requests, tokens, cost against a budget by provider (null: none)."""
    budget = F.lit(None).cast("double")
    for p, v in budgets.items():
        budget = F.when(F.col("provider") == p, v).otherwise(budget)
    u = calls.groupBy("provider").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("c"))
    return u.select("provider", "requests", "tokens", F.round("c", 6).alias("cost"), F.coalesce(F.col("c") >= budget, F.lit(False)).alias("over_budget"))


def admission_audit(calls: DataFrame, budget: float, per_minute: int) -> DataFrame:
    """(seq, refused): too_expensive if earlier calls of the provider cost the budget or more, too_soon within 60000/per_minute ms."""
    key = ("provider",)
    c = scan.folded(scan.cut(calls, "provider", *ORDER), key, ORDER, scan.sums(total=F.col("cost")), scan.previous("ts", "last"))
    spent = F.round(F.col("total") - F.coalesce("cost", F.lit(0.0)), 9)
    gap = F.unix_millis("ts") - F.unix_millis("last")
    return c.select("seq", F.when(spent >= budget, "too_expensive").when(gap < 60000 / per_minute, "too_soon").alias("refused"))


def stagnation(steps: DataFrame, times: int = 3) -> DataFrame:
    """Steps at which the same tool and path came up for the third, sixth, ... time in a session."""
    at = Window.partitionBy("session_id", "tool", "path").orderBy("step")
    return steps.withColumn("n", F.row_number().over(at)).where(F.col("n") % times == 0).select("session_id", "step", "tool", "path", "n")


def oscillating_files(steps: DataFrame, least: int = 4) -> DataFrame:
    """Writes of a file from the fourth in a session on."""
    at = Window.partitionBy("session_id", "path").orderBy("step")
    return steps.where(F.col("tool").isin(*WRITES)).withColumn("n", F.row_number().over(at)).where(F.col("n") >= least).select("session_id", "step", "path", "n")


def recent_steps(steps: DataFrame, keep: int = 50) -> DataFrame:
    at = Window.partitionBy("session_id").orderBy(F.desc("step"))
    return steps.withColumn("rn", F.row_number().over(at)).where(F.col("rn") <= keep).select("session_id", "step", "tool", "rn")


def modification_confidence(steps: DataFrame) -> DataFrame:
    """(session_id, step, confidence) of each write: 0.9, less for unread files, repeated writes and early turns."""
    at = Window.partitionBy("session_id", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    mods = F.coalesce(F.sum(F.col("tool").isin(*WRITES).cast("int")).over(at), F.lit(0))
    read = F.coalesce(F.max((F.col("tool") == "read_file").cast("int")).over(at), F.lit(0)) == 1
    c = 0.9 - F.when(read, 0.0).otherwise(0.3) - F.when(mods > 3, 0.2).when(mods > 1, 0.1).otherwise(0.0) - F.when(F.col("step") <= 2, 0.1).otherwise(0.0)
    return steps.select("session_id", "step", "tool", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), c)), 6).alias("confidence")).where(F.col("tool").isin(*WRITES)).drop("tool")


def provider_order(calls: DataFrame, tiers: dict[str, int], configured: str | None = None) -> DataFrame:
    """(provider, rank): healthy providers of the pool, the configured one first, then by tier and by falling weight.

    Health is that after a provider's last call; one that was never called is healthy with weight 1.
    """
    h = provider_health(calls).join(calls.select("seq", "ts"), "seq")
    last = h.groupBy("provider").agg(F.max_by("weight", F.struct("ts", "seq")).alias("weight"))
    pool = calls.sparkSession.createDataFrame(list(tiers.items()), "provider string, tier int")
    p = pool.join(last, "provider", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).where("weight > 0")
    first = F.desc(F.col("provider").eqNullSafe(F.lit(configured)))
    at = Window.orderBy(first, "tier", F.desc("weight"), "provider")  # as many rows as the pool has providers
    return p.select("provider", F.row_number().over(at).alias("rank"))


def model_order(health: DataFrame, tiers: dict[str, int]) -> DataFrame:
    """provider, model, rank: by score less 20 for each tier; if ranks 1 and 2 share a provider, the best of another moves to 2."""
    tier = F.lit(0)
    for m, t in tiers.items():
        tier = F.when(F.col("model") == m, t).otherwise(tier)
    r = health.where("score > 0").withColumn("value", F.col("score") - 20 * tier)
    r = r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "provider", "model")))  # as many rows as there are models
    return diversify(r)


def diversify(ranked: DataFrame) -> DataFrame:
    """ranked(provider, model, rank): if ranks 1 and 2 share a provider, the best of another provider takes rank 2."""
    whole = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.first("provider").over(whole)
    second = F.max(F.when(F.col("rank") == 2, F.col("provider"))).over(whole)
    d = ranked.withColumn("top", top).withColumn("second", second)
    d = d.withColumn("other", F.min(F.when(F.col("provider") != F.col("top"), F.col("rank"))).over(whole))
    moves = (F.col("top") == F.col("second")) & F.col("other").isNotNull()
    new = F.when(~F.coalesce(moves, F.lit(False)), F.col("rank")).when(F.col("rank") == F.col("other"), 2).when((F.col("rank") >= 2) & (F.col("rank") < F.col("other")), F.col("rank") + 1).otherwise(F.col("rank"))
    return d.select("provider", "model", new.alias("rank"))


def stalled_tasks(heartbeats: DataFrame, silence_ms: int = 60_000) -> DataFrame:
    """(task_id, seq, silent_ms): pulses, not idle or stalled, after which the task was silent for silence_ms or more."""
    at = Window.partitionBy("task_id").orderBy("ts", "seq")
    gap = F.unix_millis(F.lead("ts").over(at)) - F.unix_millis("ts")
    return heartbeats.withColumn("silent_ms", gap).where((F.col("silent_ms") >= silence_ms) & ~F.col("status").isin("IDLE", "STALLED")).select("task_id", "seq", "silent_ms")


def retain_facts(facts: DataFrame, keep: int = 100) -> DataFrame:
    """Pinned facts first, then the most recently used ones."""
    at = Window.partitionBy("session_id").orderBy(F.desc("pinned"), F.desc("last_step"), "key")
    return facts.withColumn("rn", F.row_number().over(at)).where(F.col("rn") <= keep).drop("rn")


def evict_facts(facts: DataFrame, cap: int = 200, n: int = 20) -> DataFrame:
    """Where a session holds more than cap facts, its n oldest unpinned ones go."""
    size = F.count("*").over(Window.partitionBy("session_id"))
    old = F.row_number().over(Window.partitionBy("session_id", "pinned").orderBy("last_step", "key"))
    return facts.withColumn("s", size).withColumn("o", old).where(~((F.col("s") > cap) & ~F.col("pinned") & (F.col("o") <= n))).drop("s", "o")


def dedupe_constraints(constraints: DataFrame, shown: int = 10) -> DataFrame:
    """(session_id, step, value): the first constraint of each 40-character start, cut to 500, the newest `shown` of them."""
    c = constraints.groupBy("session_id", F.substring("value", 1, 40).alias("start")).agg(F.min(F.struct("step", "value")).alias("c"))
    at = Window.partitionBy("session_id").orderBy(F.desc("c.step"), "c.value")
    return c.withColumn("rn", F.row_number().over(at)).where(F.col("rn") <= shown).select("session_id", "c.step", F.substring("c.value", 1, 500).alias("value"))


def rank_hypotheses(hypotheses: DataFrame, tests: DataFrame) -> DataFrame:
    """(failure_id, id, score, rank): least(100, confidence * 100 + 10 if systemic + 50 * pass rate, or 25 without a test)."""
    rate = tests.groupBy(F.col("hypothesis_id").alias("id")).agg(F.avg(F.col("passed").cast("double")).alias("rate"))
    s = F.least(F.lit(100.0), F.col("confidence") * 100 + F.when(F.col("systemic"), 10).otherwise(0) + F.coalesce(F.col("rate") * 50, F.lit(25.0)))
    out = hypotheses.join(rate, "id", "left").withColumn("score", F.round(s, 6))
    return out.select("failure_id", "id", "score", F.row_number().over(Window.partitionBy("failure_id").orderBy(F.desc("score"), "id")).alias("rank"))


def task_outcomes(tasks: DataFrame, results: DataFrame, least: float) -> DataFrame:
    """By session: pending tasks, and results applied, below `least` confidence, failed or skipped."""
    done = results.groupBy("session_id").agg(
        F.count_if((F.col("status") == "applied") & (F.col("confidence") >= least)).alias("applied"), F.count_if((F.col("status") == "applied") & (F.col("confidence") < least)).alias("low_confidence"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped")
    )
    pending = tasks.join(results.select("task_id").distinct(), "task_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("pending"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return done.join(pending, "session_id", "full_outer").select("session_id", *(z(c) for c in ("pending", "applied", "low_confidence", "failed", "skipped")))


def remaining_errors(results: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(session_id, files, errors): files that a session's applied results touch, and the errors left in them.

    results(session_id, file_path, status), diagnostics(file, errors) by file. A file counts once for each session.
    """
    files = results.where("status = 'applied'").select("session_id", "file_path").distinct()
    e = diagnostics.groupBy(F.col("file").alias("file_path")).agg(F.sum("errors").alias("errors"))
    left = F.coalesce(F.sum("errors"), F.lit(0)).alias("errors")
    return files.join(e, "file_path", "left").groupBy("session_id").agg(F.count("*").alias("files"), left)
