"""Continuous forms. Every event stream carries an explicit watermark; keys' states are small rows.

Functions that take either a batch or a stream say so; the others need a stream. Timestamps must be `timestamp`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from graphloom.operators.codegraph import CodeStore
from graphloom.operators.history import signed
from graphloom.operators.impact import classify_changes, impact_reports, propagate
from graphloom.operators.telemetry import WRITES, oscillating_files, stagnation
from graphloom.plans.blast import plan_from_files
from graphloom.tables import written


def debounce(changes: DataFrame, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Batch or stream: for each file the last event (id, ts) before a silence of `gap`."""
    c = changes.withWatermark("ts", late) if changes.isStreaming else changes
    g = c.groupBy("file_path", F.session_window("ts", gap)).agg(F.max_by(F.struct("id", "ts"), F.struct("ts", "id")).alias("e"), F.count("*").alias("events"))
    return g.select("file_path", "e.id", "e.ts", "events")


def _millis(length: str) -> int:
    return int(pd.Timedelta(length).total_seconds() * 1000)


def suppress_noops(changes: DataFrame, late: str = "10 minutes", forget: str = "30 days") -> DataFrame:
    """(file_path, id, old_content, new_content): events whose content differs from the file's last seen one.

    On a batch by lag; on a stream by a state with the last content for each file, events of a batch ordered by (ts, id).
    A file that no event names for `forget` of event time is forgotten; its next event counts as its first.
    """
    if not changes.isStreaming:
        w = Window.partitionBy("file_path").orderBy("ts", "id")
        c = changes.withColumn("old_content", F.lag("content").over(w))
        return c.where(~F.col("old_content").eqNullSafe(F.col("content")) | F.col("old_content").isNull()).select("file_path", "id", "old_content", F.col("content").alias("new_content"))

    keep = _millis(forget)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        if state.hasTimedOut:
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
                if last is None or r.content != last:
                    rows.append((key[0], r.id, last, r.content))
                last, at = r.content, int(r.ts.timestamp() * 1000)
            state.update((last,))
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + keep)
        yield pd.DataFrame(rows, columns=["file_path", "id", "old_content", "new_content"])

    kind = "file_path string, id string, old_content string, new_content string"
    grouped = changes.withWatermark("ts", late).groupBy("file_path")
    return grouped.applyInPandasWithState(step, kind, "last string", "append", GroupStateTimeout.EventTimeTimeout)


def health_stream(calls: DataFrame, late: str = "10 minutes", forget: str = "30 days") -> DataFrame:
    """(provider, seq, consecutive): failures since the last success, as calls arrive.

    A provider without calls for `forget` of event time starts anew.
    """
    keep = _millis(forget)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = []
        if state.hasTimedOut:
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples():
                n, at = 0 if r.ok else n + 1, int(r.ts.timestamp() * 1000)
                rows.append((key[0], r.seq, n))
            state.update((n,))
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + keep)
        yield pd.DataFrame(rows, columns=["provider", "seq", "consecutive"])

    grouped = calls.withWatermark("ts", late).groupBy("provider")
    return grouped.applyInPandasWithState(step, "provider string, seq long, consecutive long", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def stalled_stream(heartbeats: DataFrame, silence_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """(task_id, seq): the pulse after which a task, not idle or stalled, was silent for silence_ms of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, last = [], state.get if state.exists else None
        if state.hasTimedOut:
            rows.append((key[0], last[1]))
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples():
                ms = int(r.ts.timestamp() * 1000)
                if last is not None and last[2] and ms - last[0] >= silence_ms:
                    rows.append((key[0], last[1]))
                last = (ms, r.seq, r.status not in ("IDLE", "STALLED"))
            state.update(last)
            if last[2]:
                state.setTimeoutTimestamp(max(last[0] + silence_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["task_id", "seq"])

    return heartbeats.withWatermark("ts", late).groupBy("task_id").applyInPandasWithState(step, "task_id string, seq long", "ms long, seq long, active boolean", "append", GroupStateTimeout.EventTimeTimeout)


def _counted(rows: DataFrame, *keys: str, late: str, forget: str) -> DataFrame:
    """Stream in update mode: keys, n rows so far, last_at; a key without rows for `forget` of event time starts anew."""
    keep, names = _millis(forget), [*keys, "n", "last_at"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            for b in batches:
                n, last = n + len(b), max(last, int(b["ts"].max().timestamp() * 1000))
            state.update((n, last))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep)
            out.append((*key, n, pd.Timestamp(last, unit="ms")))
        yield pd.DataFrame(out, columns=names)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    grouped = rows.withWatermark("ts", late).groupBy(*keys)
    return grouped.applyInPandasWithState(step, f"{kinds}, n long, last_at timestamp", "n long, ms long", "update", GroupStateTimeout.EventTimeTimeout)


def failure_stream(failures: DataFrame, alert_from: int = 3, late: str = "10 minutes", forget: str = "30 days") -> DataFrame:
    """Batch or stream (update mode): frequency of each signature, and whether it is alarming.

    On a stream last_at is cut to milliseconds, and a signature that did not come up for `forget` of event time starts anew.
    """
    f = signed(failures)
    if f.isStreaming:
        n = _counted(f, "signature", late=late, forget=forget).withColumnRenamed("n", "frequency")
    else:
        n = f.groupBy("signature").agg(F.count("*").alias("frequency"), F.max("ts").alias("last_at"))
    return n.withColumn("alert", F.col("frequency") >= alert_from)


def step_alerts(steps: DataFrame, times: int = 3, late: str = "10 minutes", forget: str = "1 day") -> DataFrame:
    """Batch or stream (update mode): tools called on one path `times` times or more in a session.

    On a stream with ts, a session's tool and path without calls for `forget` of event time start anew; a stream without
    ts keeps its counts for good.
    """
    if steps.isStreaming and "ts" in steps.columns:
        n = _counted(steps, "session_id", "tool", "path", late=late, forget=forget).drop("last_at")
    else:
        n = steps.groupBy("session_id", "tool", "path").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= times)


def ingest_stream(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], Any], glob: str = "*", per_batch: int = 200):
    """Starts reading new files of a folder, per_batch at a time, as files(path, content, hash); resumes from checkpoint.

    each(files, batch_id) does the work of a batch; it must be idempotent, as a batch may come again after a failure.
    """
    f = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch)
    f = f.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    text = F.decode("content", "UTF-8")
    files = f.select(F.regexp_replace("path", "^file:", "").alias("path"), text.alias("content"), F.substring(F.md5(text), 1, 12).alias("hash"))
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(changes: DataFrame, checkpoint: str, each: Callable[[DataFrame], DataFrame], out: str):
    """Starts running `each` (impact reports, or blast-radius plans) on every batch of changes; rows go to Parquet by batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_graph(spark: SparkSession, folder: str, checkpoint: str, store: CodeStore, glob: str = "*", per_batch: int = 200, aliases: DataFrame | None = None, packages: DataFrame | None = None):
    """Starts building a code graph of a folder's files in a store, per_batch files at a time; resumes from checkpoint. A
    batch that comes again after a failure changes the store once."""

    def each(files: DataFrame, batch_id: int) -> None:
        none = files.select("path").where("false")
        store.update(files.select("path", "content"), none, batch_id, aliases, packages)

    return ingest_stream(spark, folder, checkpoint, each, glob, per_batch)


def watch_impact(changes: DataFrame, store: CodeStore, checkpoint: str, out: str, first_batch: int = 0):
    """Starts writing an impact report for every change(id, file_path, old_content, new_content) that touches anything.

    Every batch first changes the store's graph (an empty new_content deletes the file; of several changes of a file in a
    batch the one with the largest id counts), so reports see the files as they are after the batch. Nodes and edges that
    the batch takes away still count as impacted: reports run on the graph before and after together. first_batch: the
    number of the stream's first batch in the store.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = written(batch)
        now = batch.groupBy(F.col("file_path").alias("path")).agg(F.max_by("new_content", "id").alias("content"))
        left = F.coalesce("content", F.lit("")) == ""
        before = store.graph(before=first_batch + batch_id)
        after = store.update(now.where(~left), now.where(left).select("path"), first_batch + batch_id)
        nodes = written(before.nodes.unionByName(after.nodes).dropDuplicates(["id"]))
        edges = written(before.edges.unionByName(after.edges).select("src", "dst", "kind", "weight").distinct())
        c = written(classify_changes(batch))
        impact_reports(c, written(propagate(c, nodes, edges)), nodes, edges).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_blast_radius(changes: DataFrame, nodes: DataFrame, edges: DataFrame, checkpoint: str, out: str, top: int = 12):
    """Starts writing, for every change(id, file_path), the first `top` files of its plan other than its own."""

    def plans(batch: DataFrame) -> DataFrame:
        roots = batch.select(F.col("id").alias("plan_id"), F.col("file_path").alias("root_file")).distinct()
        p = plan_from_files(roots, nodes, edges).where("not is_root")
        at = Window.partitionBy("plan_id").orderBy("position")
        return p.withColumn("place", F.row_number().over(at)).where(F.col("place") <= top).select("plan_id", "place", "file_path", "layer", "reason")

    return watch(changes, checkpoint, plans, out)


def repeat_alerts(steps: DataFrame, times: int = 3, writes: int = 4, late: str = "10 minutes", forget: str = "1 day") -> DataFrame:
    """Batch or stream (append mode): (session_id, step, tool, path, n, alert), a row for each alarm at its step.

    stagnation: the session called the tool on the path for the third, sixth, ... time, as the count starts anew after an
    alarm. oscillation: it wrote the path for the fourth time or later. On a stream with ts, steps of a batch count in
    their order, and a session's path without calls for `forget` of event time starts anew. A null path is the empty one.
    The stream needs the RocksDB state store.
    """
    s = steps.select("session_id", "step", "tool", F.coalesce("path", F.lit("")).alias("path"), *(c for c in ("ts",) if steps.isStreaming))
    if not s.isStreaming:
        found = stagnation(s, times).withColumn("alert", F.lit("stagnation"))
        wrote = oscillating_files(s, writes).join(s, ["session_id", "step", "path"]).withColumn("alert", F.lit("oscillation"))
        return found.unionByName(wrote.select(*found.columns))
    out = "session_id string, step long, tool string, path string, n long, alert string"
    grouped = s.withWatermark("ts", late).groupBy("session_id", "path")
    return grouped.transformWithStateInPandas(_Repeats(times, writes, _millis(forget)), out, "Append", "EventTime")


class _Repeats(StatefulProcessor):
    """Counts of a session's path by tool; a timer forgets them."""

    def __init__(self, times: int, writes: int, keep: int):
        self.times, self.writes, self.keep = times, writes, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "tool string", "n long")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows)).sort_values("step", kind="stable")
        millis = b["ts"].astype("datetime64[ms]").astype("int64")
        last = self.last.get()[0] if self.last.exists() else millis.min()
        if millis.min() - last >= self.keep:  # rows come before timers that are due in the same batch
            self.counts.clear()
        old = {t: self.counts.getValue((t,))[0] if self.counts.containsKey((t,)) else 0 for t in b["tool"].unique()}
        wrote = sum(self.counts.getValue((t,))[0] for t in WRITES if self.counts.containsKey((t,)))
        b["n"] = b.groupby("tool").cumcount() + 1 + b["tool"].map(old)
        write = b["tool"].isin(WRITES)
        stuck, again = b[b["n"] % self.times == 0].assign(alert="stagnation"), b[write].assign(alert="oscillation")
        again["n"] = range(wrote + 1, wrote + 1 + len(again))
        for t, n in b.groupby("tool")["n"].max().items():
            self.counts.updateValue((t,), (int(n),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        last = int(max(millis.max(), last))
        self.last.update((last,))
        self.handle.registerTimer(max(last, timers.getCurrentWatermarkInMs()) + self.keep)
        yield pd.concat([stuck, again[again["n"] >= self.writes]])[["session_id", "step", "tool", "path", "n", "alert"]]

    def handleExpiredTimer(self, key: tuple, timers: TimerValues, expired: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass
