"""Streams against their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from graphloom.operators import mining as mi
from graphloom.operators import telemetry as t
from graphloom.streaming import streams as st


def at(sec):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=sec)


def streamed(spark, tmp_path, batches, schema):
    """A stream that reads one file a batch, in order."""
    folder = tmp_path / "in"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(folder / f"b{k}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, tmp_path, mode="append"):
    name = "q" + str(abs(hash(str(tmp_path))))
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_debounce(spark, tmp_path):
    schema = "id string, file_path string, ts timestamp"
    batches = [[("1", "/a", at(0)), ("2", "/a", at(0.3)), ("3", "/b", at(0))], [("4", "/a", at(5))], [("9", "/z", at(5000))]]
    got = {(r["file_path"], r["id"], r["events"]) for r in run(st.debounce(streamed(spark, tmp_path, batches, schema)), tmp_path)}
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {(r["file_path"], r["id"], r["events"]) for r in st.debounce(everything).collect()}
    assert want == {("/a", "2", 2), ("/b", "3", 1), ("/a", "4", 1), ("/z", "9", 1)}
    assert got == want - {("/z", "9", 1)}  # its session is still open


def test_suppress_noops(spark, tmp_path):
    schema = "id string, file_path string, ts timestamp, content string"
    batches = [[("1", "/a", at(0), "x"), ("2", "/a", at(1), "x")], [("3", "/a", at(2), "x"), ("4", "/a", at(3), "y"), ("5", "/b", at(3), "x")]]
    key = lambda rows: {(r["file_path"], r["id"], r["old_content"], r["new_content"]) for r in rows}
    want = {("/a", "1", None, "x"), ("/a", "4", "x", "y"), ("/b", "5", None, "x")}
    assert key(st.suppress_noops(spark.createDataFrame([r for b in batches for r in b], schema)).collect()) == want
    assert key(run(st.suppress_noops(streamed(spark, tmp_path, batches, schema)), tmp_path)) == want


def test_health(spark, tmp_path):
    schema = "provider string, ts timestamp, seq long, ok boolean, error string"
    calls = [("p" + str(i % 2), at(i), i, i % 5 == 0, None if i % 5 == 0 else "boom") for i in range(20)]
    got = {(r["provider"], r["seq"], r["consecutive"]) for r in run(st.health_stream(streamed(spark, tmp_path, [calls[:11], calls[11:]], schema)), tmp_path)}
    assert got == {(r["provider"], r["seq"], r["consecutive"]) for r in t.provider_health(spark.createDataFrame(calls, schema)).collect()}


def test_stalled(spark, tmp_path):
    schema = "task_id string, status string, ts timestamp, seq long"
    batches = [[("t", "EXECUTING", at(0), 1), ("i", "IDLE", at(0), 2)], [("t", "EXECUTING", at(90), 3), ("u", "WAITING", at(91), 4)], [("v", "IDLE", at(400), 5)], [("v", "IDLE", at(401), 6)]]
    got = {(r["task_id"], r["seq"]) for r in run(st.stalled_stream(streamed(spark, tmp_path, batches, schema)), tmp_path)}
    assert got == {("t", 1), ("t", 3), ("u", 4)}


def test_alerts_update(spark, tmp_path):
    schema = "session_id string, tool string, path string"
    batches = [[("s", "run", "/a")] * 2, [("s", "run", "/a"), ("s", "run", "/b")]]
    got = run(st.step_alerts(streamed(spark, tmp_path, batches, schema)), tmp_path, "update")
    assert [tuple(r) for r in got] == [("s", "run", "/a", 3)]


def test_ingest(spark, tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    for i in range(5):
        (folder / f"f{i}.py").write_text(f"def f{i}(x):\n    pass\n")
    seen = []
    each = lambda batch, i: seen.append((batch.count(), mi.extract_symbols(batch).where("sym_kind = 'function'").count()))
    for _ in range(2):  # the second start finds nothing new
        st.ingest_stream(spark, str(folder), str(tmp_path / "cp"), each, "*.py", 2).awaitTermination(120)
    assert sum(a for a, _ in seen) == 5 and sum(b for _, b in seen) == 5 and max(a for a, _ in seen) <= 2


def test_watch(spark, tmp_path):
    s = streamed(spark, tmp_path, [[("1", "/a", at(0), "x")], [("2", "/b", at(1), "y")]], "id string, file_path string, ts timestamp, content string")
    st.watch(s, str(tmp_path / "cp"), lambda b: b.select("file_path", F.lit(1).alias("n")), str(tmp_path / "out")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_counts_forget_idle_keys(spark, tmp_path):
    schema = "session_id string, tool string, path string, ts timestamp"
    day = 86_400
    batches = [[("s", "run", "/a", at(i)) for i in range(3)], [("x", "run", "/a", at(3 * day))], [("x", "run", "/b", at(3 * day + 1))], [("s", "run", "/a", at(3 * day + 2)), ("x", "run", "/a", at(3 * day + 3)), ("x", "run", "/a", at(3 * day + 4))]]
    got = run(st.step_alerts(streamed(spark, tmp_path, batches, schema)), tmp_path, "update")
    assert sorted(tuple(r) for r in got) == [("s", "run", "/a", 3), ("x", "run", "/a", 3)]


def test_failure_stream_equals_batch(spark, tmp_path):
    schema = "id long, file_path string, message string, ts timestamp"
    batches = [[(1, "/a", "boom at /x/1", at(1)), (2, "/a", "boom at /x/2", at(2))], [(3, "/a", "boom at /y", at(3)), (4, "/b", "boom", at(4))]]
    got = run(st.failure_stream(streamed(spark, tmp_path, batches, schema)), tmp_path, "update")
    last = {r["signature"]: (r["frequency"], r["last_at"], r["alert"]) for r in sorted(got, key=lambda r: r["frequency"])}
    everything = st.failure_stream(spark.createDataFrame([r for b in batches for r in b], schema)).collect()
    assert last == {r["signature"]: (r["frequency"], r["last_at"], r["alert"]) for r in everything}


def test_watches_equal_batch(spark, tmp_path):
    n = spark.createDataFrame([("t", "db_table", "users", "/db/schema.sql", "database"), ("u", "class", "Users", "/svc/u.ts", "backend"), ("p", "component", "Page", "/ui/p.tsx", "frontend")], "id string, kind string, name string, file_path string, layer string")
    e = spark.createDataFrame([("u", "t", "imports"), ("p", "u", "imports")], "src string, dst string, kind string")
    schema = "id string, file_path string, old_content string, new_content string"
    batches = [[("1", "/db/schema.sql", "a", "ALTER TABLE users")], [("2", "/ui/p.tsx", "a", "b")]]
    s = streamed(spark, tmp_path, batches, schema)
    st.watch_blast_radius(s, n, e, str(tmp_path / "c2"), str(tmp_path / "o2")).awaitTermination(120)
    got = sorted((r["plan_id"], r["place"], r["file_path"]) for r in spark.read.parquet(str(tmp_path / "o2")).collect())
    assert got == [("1", 1, "/svc/u.ts"), ("1", 2, "/ui/p.tsx"), ("2", 1, "/db/schema.sql"), ("2", 2, "/svc/u.ts")]


def test_ingest_and_watch_follow_the_files(spark, tmp_path):
    from graphloom.operators.codegraph import CodeStore, built

    src = tmp_path / "src"
    src.mkdir()
    text = {"m.ts": "export function m() {}\n", "u.ts": "import { m } from './m';\nexport const x = 1;\n", "p.ts": "import { x } from './u';\n"}
    for n, c in text.items():
        (src / n).write_text(c)
    store = CodeStore(spark, f"file://{tmp_path}/store", 4)
    st.ingest_graph(spark, str(src), str(tmp_path / "c0"), store, "*.ts", 2).awaitTermination(300)
    got = store.graph()
    want = built(spark.createDataFrame([(f"{src}/{n}", c) for n, c in text.items()], "path string, content string"))
    edges = lambda g: sorted(tuple(r) for r in g.edges.select("src", "dst", "kind", "weight").collect())
    assert edges(got) == edges(want) and len(edges(want)) == 3
    m, u = f"{src}/m.ts", f"{src}/u.ts"
    batches = [[("1", m, "a", "export function m2() {}\n")], [("2", u, "a", "export const x = 1;\n")], [("3", m, "a", "export function m() {}\n")]]
    s = streamed(spark, tmp_path, batches, "id string, file_path string, old_content string, new_content string")
    st.watch_impact(s, store, str(tmp_path / "c1"), str(tmp_path / "o1"), first_batch=100).awaitTermination(300)
    # the second change takes the import away, so the third touches nothing
    assert sorted((r["change_id"], r["files"]) for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == [("1", 2), ("2", 1)]


def test_repeat_alerts_equal_batch(spark, tmp_path):
    rnd = random.Random(4)
    schema = "session_id string, step long, tool string, path string, ts timestamp"
    rows = [(f"s{rnd.randrange(2)}", k, rnd.choice(["read", "write_file", "patch_file"]), rnd.choice(["/a", "/b", None]), at(k)) for k in range(120)]
    batches = [rnd.sample(rows[k : k + 30], 30) for k in range(0, 120, 30)]
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run(st.repeat_alerts(streamed(spark, tmp_path, batches, schema)), tmp_path)
        late = [[("s", 1, "read", "/a", at(0)), ("s", 2, "read", "/a", at(1))], [("t", 1, "read", "/z", at(10**6))], [("s", 3, "read", "/a", at(10**6))], [("s", 4, "read", "/a", at(10**6 + 1)), ("s", 5, "read", "/a", at(10**6 + 2))]]
        anew = run(st.repeat_alerts(streamed(spark, tmp_path / "late", late, schema)), tmp_path / "late")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    want = st.repeat_alerts(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["alert"] for r in want} == {"stagnation", "oscillation"}
    # the count of /a was forgotten, so its third call is the one at step 5
    assert [(r["session_id"], r["step"], r["n"]) for r in anew] == [("s", 5, 3)]
