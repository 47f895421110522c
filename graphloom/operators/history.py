"""Change history: latest states, sessions, hot files, rollback, failures and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What is suggested for a category of failure, and whether it is done automatically.
ACTIONS = {
    "test_regression": ("Revert the change", True),
    "ai_timeout": ("Use a faster model or a longer timeout", False),
    "parse_error": ("Check the syntax of the output or refine constraints", False),
    "model_outage": ("Switch to a fallback provider", False),
}
OTHER_ACTION, RECURRING_ACTION = "Check the logs for more details", "Analyse the root cause"


def latest_change(changes: DataFrame) -> DataFrame:
    """The newest change of each file that is not rolled back; ties by id."""
    c = [F.col(x) for x in changes.columns if x != "file_path"]
    newest = changes.where("not rolled_back").groupBy("file_path").agg(F.max_by(F.struct(*c), F.struct("applied_at", "id")).alias("c"))
    return newest.select("file_path", "c.*")


def active_changes(changes: DataFrame) -> DataFrame:
    """Changes that are not rolled back, with their place in their file's history, oldest first."""
    at = Window.partitionBy("file_path").orderBy("applied_at", "id")
    return changes.where("not rolled_back").select("file_path", "id", F.row_number().over(at).alias("place"))


def newest(changes: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """The newest n changes, of all or for each value of `by`."""
    order = [F.desc("applied_at"), F.desc("id")]
    if by is None:
        return changes.orderBy(*order).limit(n)
    return changes.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def rollback_targets(changes: DataFrame) -> DataFrame:
    """(session_id, file_path, first_id, changes): what rolling back a session restores: each file as before its first change there."""
    live = changes.where("not rolled_back")
    return live.groupBy("session_id", "file_path").agg(F.min_by("id", F.struct("applied_at", "id")).alias("first_id"), F.count("*").alias("changes"))


def rollback(changes: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes with the active ones among chosen(id) marked as rolled back, and (file_path, restore_content).

    A file is restored to what it was before the first of its chosen changes. chosen may be one id, the ids of a
    session, or those of latest_change for files; ids that are unknown or rolled back already do nothing.
    """
    ids = chosen.select("id").distinct()
    hit = changes.where("not rolled_back").join(ids, "id", "left_semi")
    restores = hit.groupBy("file_path").agg(F.min_by("original_content", F.struct("applied_at", "id")).alias("restore_content"))
    marked = changes.join(ids.withColumn("__chosen", F.lit(True)), "id", "left")
    marked = marked.withColumn("rolled_back", F.col("rolled_back") | F.col("__chosen").isNotNull()).select(*changes.columns)
    return marked, restores


def session_summary(changes: DataFrame, n: int = 5, newest_rows: int = 300) -> DataFrame:
    """Over the newest active changes: files, changes and latest time of the n newest sessions; files in the order they came."""
    recent = newest(changes.where("not rolled_back"), newest_rows)
    files = recent.groupBy("session_id", "file_path").agg(F.min(F.struct("applied_at", "id")).alias("first"), F.count("*").alias("n"), F.max("applied_at").alias("last"))
    s = files.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "file_path"))), lambda x: x["file_path"]).alias("files"), F.sum("n").alias("changes"), F.max("last").alias("last_at")
    )
    return s.orderBy(F.desc("last_at"), "session_id").limit(n)


def hot_files(changes: DataFrame, k: int = 8) -> DataFrame:
    return changes.groupBy("file_path").agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "file_path").limit(k)


def session_digest(sessions: DataFrame, shown: int = 4) -> DataFrame:
    """One line for each session: time, changes, the first files and how many more."""
    more = F.size("files") - shown
    return sessions.select(
        "session_id",
        F.concat(F.date_format("last_at", "yyyy-MM-dd HH:mm"), F.lit(" "), F.col("changes").cast("string"), F.lit(" changes: "), F.array_join(F.slice("files", 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise("")).alias("line"),
    )


def recurring_failures(failures: DataFrame, least: int = 2, k: int = 6) -> DataFrame:
    f = failures.groupBy("file_path").agg(F.count("*").alias("n"), F.substring(F.max("message"), 1, 100).alias("message"))
    return f.where(F.col("n") >= least).orderBy(F.desc("n"), "file_path").limit(k)


def signed(failures: DataFrame) -> DataFrame:
    """failures with `signature`: sha256 of file and message, paths and hexadecimal numbers masked."""
    m = F.regexp_replace("message", r"/[A-Za-z0-9_./-]+", "[PATH]")
    m = F.regexp_replace(m, r"0x[0-9a-fA-F]+", "[HEX]")
    return failures.withColumn("signature", F.sha2(F.concat_ws(":", "file_path", m), 256))


def failure_signatures(failures: DataFrame) -> DataFrame:
    """signature, frequency, first_id, last_message, last_at."""
    return signed(failures).groupBy("signature").agg(
        F.count("*").alias("frequency"), F.min_by("id", F.struct("ts", "id")).alias("first_id"), F.max_by("message", F.struct("ts", "id")).alias("last_message"), F.max("ts").alias("last_at")
    )


def failure_actions(failures: DataFrame, recurring_from: int = 3) -> DataFrame:
    """(id, suggested, auto_fix, recurring): in order of time, a signature recurs from its third failure on."""
    at = Window.partitionBy("signature").orderBy("ts", "id")
    f = signed(failures).withColumn("recurring", F.row_number().over(at) >= recurring_from)
    suggested, auto = F.lit(OTHER_ACTION), F.lit(False)
    for category, (text, fix) in ACTIONS.items():
        suggested, auto = F.when(F.col("category") == category, text).otherwise(suggested), F.when(F.col("category") == category, fix).otherwise(auto)
    return f.select("id", F.when(F.col("recurring"), RECURRING_ACTION).otherwise(suggested).alias("suggested"), (auto & ~F.col("recurring")).alias("auto_fix"), "recurring")


def diagnostics_by_file(diagnostics: DataFrame) -> DataFrame:
    """file, errors, warnings, summary: the error lines in order of line and message."""
    return diagnostics.groupBy("file").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == "error", F.struct("line", "col", "message")))), lambda d: F.concat_ws(":", d["line"], d["message"])), "; ").alias("summary"),
    )


def module_map(files: DataFrame, active: DataFrame, most: int = 5) -> DataFrame:
    """(module, path, is_active): up to `most` files of each top folder, at most two levels below it."""
    parts = F.split(F.ltrim(F.col("path"), F.lit("/")), "/")
    f = files.select("path", parts.alias("p")).where("size(p) between 2 and 4").select(F.col("p")[0].alias("module"), "path")
    f = f.withColumn("rn", F.row_number().over(Window.partitionBy("module").orderBy("path"))).where(F.col("rn") <= most)
    return f.join(active.select("path", F.lit(True).alias("a")).distinct(), "path", "left").select("module", "path", F.coalesce("a", F.lit(False)).alias("is_active"))
