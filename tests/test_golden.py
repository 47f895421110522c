"""Hand-made inputs with hand-worked rows, and invariants of the loops."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as x
from graphloom.operators import graph as g
from graphloom.operators import history as h
from graphloom.operators import impact as im
from graphloom.operators import iterate as it
from graphloom.operators import mining as mi
from graphloom.operators import retrieval as r
from graphloom.operators import telemetry as t
from graphloom.plans import blast
from graphloom.sources import readers as s


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def files(spark, **content):
    return spark.createDataFrame([(k.replace("__", "/").replace("_DOT_", "."), v) for k, v in content.items()], "path string, content string")


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 5), (5, 6), (6, 4), (7, 7), (7, 8), (9, 4)], "src long, dst long")
    assert rows(it.cycles(e)) == [(1, 1), (2, 1), (4, 4), (5, 4), (6, 4), (7, 7)]
    assert it.cycles(e.where("src > 100")).count() == 0


def test_levels_and_leftovers(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("l", "l")], "src string, dst string")
    n = spark.createDataFrame([(1, i) for i in "abcxyzlo"], "grp int, id string")
    got = {r["id"]: r["level"] for r in it.topological_levels(n, e).collect()}
    assert got == {"a": 2, "b": 1, "c": 0, "o": 0, "x": None, "y": None, "z": None, "l": None}
    assert {r["id"]: r["level"] for r in it.topological_levels(n, e, "importers_first").collect()}["a"] == 0


def test_reach_and_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1)], "seed long, node long")
    assert rows(it.reach(seeds, e, "out", 2)) == [(1, 2, 1), (1, 3, 1), (1, 4, 2)]
    assert rows(it.reach(seeds, e, "out")) == [(1, 2, 1), (1, 3, 1), (1, 4, 2)]
    p = {(r["src"], r["dst"]): r["path"] for r in it.shortest_paths(spark.createDataFrame([(1, 4), (4, 2), (1, 1), (1, 9)], "src long, dst long"), e).collect()}
    assert p == {(1, 4): [1, 3, 4], (4, 2): [4, 1, 2], (1, 1): [1], (1, 9): None}


def test_plan_orders_dependencies_first(spark):
    n = spark.createDataFrame([(i, "class", i, f"/{i}.ts", "backend") for i in "abcd"], "id string, kind string, name string, file_path string, layer string")
    e = spark.createDataFrame([("a", "b", "imports"), ("b", "c", "imports"), ("d", "a", "imports")], "src string, dst string, kind string")
    plan = blast.plan_from_files(spark.createDataFrame([(1, "/a.ts")], "plan_id int, root_file string"), n, e)
    assert rows(plan, "position", "file_path", "reason", "is_root") == [(1, "/c.ts", "dependency", False), (2, "/b.ts", "dependency", False), (3, "/a.ts", "root", True), (4, "/d.ts", "dependent", False)]
    assert rows(blast.plan_report(plan, n, e), "total_files", "warnings", "complexity") == [(4, 0, "low")]


def test_circuit_breaker(spark):
    at = lambda sec: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=sec)
    calls = [("p", at(i), i, False, "boom") for i in range(5)] + [("p", at(6), 6, False, "429"), ("p", at(70), 7, True, None), ("p", at(71), 8, True, None), ("p", at(72), 9, True, None)]
    df = spark.createDataFrame(calls, "provider string, ts timestamp, seq long, ok boolean, error string")
    got = dict(rows(t.circuit_states(df), "seq", "state"))
    assert got == {0: "CLOSED", 1: "CLOSED", 2: "CLOSED", 3: "CLOSED", 4: "OPEN", 7: "HALF_OPEN", 8: "CLOSED", 9: "CLOSED"}


SOURCES = {
    "_a_DOT_py": "import os.path\nasync def go(x, y):\n    pass\nclass A(B):\n",
    "_b_DOT_ts": "import { c } from './c';\nexport async function f(a, b) {\n  c(1);\n  later();\n}\nexport const later = (x) => x;\nexport interface I {\n  p: string;\n}\napp.get('/x', f); app.post('/y', async () => 1);\n",
    "_c_DOT_ts": "export function c(n) { return helper(n); }\nfunction helper(n) { return n; }\n",
}


def test_symbols_and_calls(spark):
    f = files(spark, **SOURCES).withColumn("path", F.concat(F.lit("/"), F.regexp_replace("path", "^_", "")))
    sym = mi.extract_symbols(f)
    got = {(r["path"], r["sym_kind"], r["name"], tuple(r["params"]), r["is_async"], r["is_exported"]) for r in sym.collect()}
    assert {("/a.py", "import", "os.path", (), False, False), ("/a.py", "function", "go", ("x", "y"), True, False), ("/a.py", "class", "A", (), False, False), ("/b.ts", "import", "./c", (), False, False), ("/b.ts", "function", "f", ("a", "b"), True, True), ("/b.ts", "function", "later", ("x",), False, True), ("/b.ts", "interface", "I", (), False, True)} <= got
    assert rows(mi.extract_routes(f), "method", "route", "handler") == [("GET", "/x", "f"), ("POST", "/y", "anonymous")]
    res = mi.resolve_imports(sym.where("sym_kind = 'import'").select("path", F.col("name").alias("source")), f)
    assert rows(res) == [("/b.ts", "./c", "/c.ts")]
    calls = rows(mi.call_edges(f, sym, res), "path", "caller", "callee_path", "callee", "kind")
    assert ("/b.ts", "f", "/c.ts", "c", "calls") in calls and ("/c.ts", "c", "/c.ts", "helper", "calls") in calls
    n, e = mi.build_graph(f, sym)
    assert e.count() == n.where("kind <> 'file'").count()


def test_import_resolution(spark):
    f = spark.createDataFrame([(p, "") for p in ("/r/src/a.ts", "/r/src/lib/x.ts", "/r/src/lib/index.ts", "/r/src/ui/Button.tsx", "/r/pkg/core/index.ts")], "path string, content string")
    cfg = spark.createDataFrame([("/r/tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/ui/*": ["src/ui/*"]}}}')], "path string, content string")
    man = spark.createDataFrame([("/r/pkg/core/package.json", '{"name": "@org/core", "main": "./index.ts"}')], "path string, content string")
    i = spark.createDataFrame([("/r/src/a.ts", src) for src in ("./lib/x.js", "./lib", "@/ui/Button", "@/lib/x", "@org/core", "fs", "node:path", "left-pad", "../src/lib/x")], "path string, source string")
    got = {r["source"]: r["target"] for r in mi.resolve_imports(i, f, s.load_aliases(cfg), s.load_packages(man)).collect()}
    assert got == {"./lib/x.js": "/r/src/lib/x.ts", "./lib": "/r/src/lib/index.ts", "@/ui/Button": "/r/src/ui/Button.tsx", "@/lib/x": "/r/src/lib/x.ts", "@org/core": "/r/pkg/core/index.ts", "../src/lib/x": "/r/src/lib/x.ts"}


def test_ddl_models_graphql(spark):
    ddl = 'CREATE TABLE IF NOT EXISTS "users" (\n  id INT,\n  mail VARCHAR(20) NOT NULL DEFAULT x,\n  team INT REFERENCES teams(id),\n  boss INT,\n  PRIMARY KEY (id),\n  UNIQUE (mail),\n  FOREIGN KEY (boss) REFERENCES users (id)\n);'
    got = rows(mi.extract_ddl(files(spark, a=ddl)), "column", "type", "nullable", "primary_key", "unique", "default", "ref_table")
    key = lambda r: r[0]
    assert sorted(got, key=key) == [("boss", "INT", True, False, False, None, "users"), ("id", "INT", False, True, True, None, None), ("mail", "VARCHAR(20)", False, False, True, "X", None), ("team", "INT", True, False, False, None, "teams")]
    model = "model Post {\n  id Int @id @default(autoincrement())\n  title String?\n  slug String @unique\n  author User @relation(fields: [a])\n}\n"
    got = {r["column"]: tuple(r)[3:] for r in mi.extract_models(files(spark, a=model)).collect()}
    assert got == {"id": ("Int", False, True, True, "autoincrement()", None), "title": ("String", True, False, False, None, None), "slug": ("String", False, False, True, None, None), "author": ("User", False, False, False, None, "User")}
    gql = "type User {\n  id: ID!\n  posts(first: Int, after: String): [Post]\n}\nenum Role {\n  ADMIN\n  USER\n}\ntype Query {\n  me: User\n}\n"
    got = {(r["kind"], r["type"], r["field"], r["field_type"], tuple(r["args"])) for r in mi.extract_graphql(files(spark, a=gql)).collect()}
    assert got == {("type", "User", "id", "ID!", ()), ("type", "User", "posts", "[Post]", ("first: Int", "after: String")), ("enum", "Role", "ADMIN", None, ()), ("enum", "Role", "USER", None, ()), ("operation", "Query", "me", "User", ())}


def test_breaking_types(spark):
    old = "export interface A {\n  x: string;\n  y: number;\n  z: boolean;\n}\nexport interface Gone { a: string }\n"
    new = "export interface A {\n  x: string;\n  y: string;\n}\n"
    got = rows(mi.breaking_type_changes(spark.createDataFrame([("c", old, new)], "id string, old_content string, new_content string")), "interface", "problem")
    assert got == [("A", "property removed"), ("A", "type changed"), ("Gone", "interface removed")]


def test_manifests_and_lint(spark):
    f = spark.createDataFrame([("/package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}'), ("/requirements.txt", "# no\nx>=1.0\ny\n"), ("/go.mod", "require (\n\tg/h v1\n\t// no\n)\n")], "path string, content string")
    assert rows(s.parse_manifests(f), "name", "version", "scope") == [("a", "1", "runtime"), ("b", "2", "dev"), ("g/h", "v1", "runtime"), ("x", ">=1.0", "runtime"), ("y", "*", "runtime")]
    lint = spark.createDataFrame([('[{"filePath": "/a", "messages": [{"line": 3, "severity": 2, "message": "bad"}, {"line": 4, "severity": 1, "message": "meh"}]}]',), ("crashed\n\nhere",)], "text string")
    got = {(r["file"], r["line"], r["severity"], r["message"]) for r in s.parse_lint_json(lint).collect()}
    assert got == {("/a", 3, "error", "bad"), ("/a", 4, "warning", "meh"), (None, None, "warning", "crashed"), (None, None, "warning", "here")}


def test_model_output(spark):
    said = ['{"a": 1}', "x\n```\nno\n```\n```json\n[1]\n```", 'so {"a": [1, 2,],} ok', "none", ""]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(said)], "i int, v string").orderBy("i").select(x.parse_model_output(F.col("v"))).collect()]
    assert got == ['{"a": 1}', "[1]", '{"a": [1, 2]}', None, None]


def test_upsert_is_idempotent(spark):
    cur = spark.createDataFrame([("n", "/f", "class", "old", 1, 1)], "name string, file_path string, kind string, layer string, created_at int, updated_at int")
    new = spark.createDataFrame([("n", "/f", "class", "new", 5, 5), ("m", "/f", "class", "x", 5, 5)], cur.schema)
    once = s.upsert_nodes(cur, new)
    assert rows(once, "name", "layer", "created_at", "updated_at") == [("m", "x", 5, 5), ("n", "new", 1, 5)]
    assert rows(s.upsert_nodes(once, new)) == rows(once)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("import os\n")
    (tmp_path / "node_modules/b.py").write_text("import no\n")
    f = s.read_sources(spark, str(tmp_path), "*.py")
    assert [r["content"] for r in f.collect()] == ["import os\n"]
    n, e = mi.build_graph(f, mi.extract_symbols(f))
    s.write_snapshot(n, e, str(tmp_path / "snap"), "v1")
    assert spark.read.parquet(str(tmp_path / "snap/nodes")).where("snapshot = 'v1'").count() == n.count()


@pytest.mark.parametrize("n", [3, 6, 7, 20])
def test_conversations_never_repeat(spark, n):
    m = spark.createDataFrame([(1, i, 100.0) for i in range(n)], "conv_id int, turn int, tokens double")
    turns = sorted(r["turn"] for r in x.fit_conversations(m, 3500).collect())
    assert len(set(turns)) == len(turns) and 0 in turns and n - 1 in turns
    assert sum(100 for _ in turns) <= 800 or n <= 7


def test_graph_basics(spark):
    n = spark.createDataFrame([("a", "file"), ("b", "class"), ("c", "class")], "id string, kind string")
    e = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y"), ("a", "q", "x")], "src string, dst string, kind string")
    assert rows(g.degrees(n, g.intact_edges(n, e)), "id", "degree") == [("a", 1), ("b", 1), ("c", 0)]
    assert rows(g.dangling_edges(n, e)) == [("a", "q", "x", "dst")]
    assert rows(g.orphans(n, e), "id") == [("c",)]


def test_hybrid_search_takes_2k_keyword_hits(spark):
    c = spark.createDataFrame([(i, f"alpha {i}", [1.0, 0.0] if i == 8 else [1.0, 1.0] if i == 7 else [-1.0, 0.0]) for i in range(1, 9)], "id long, content string, embedding array<double>")
    q = spark.createDataFrame([(0, "alpha", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    got = {row["rank"]: (row["id"], row["score"]) for row in r.hybrid_search(q, c, 5).collect()}
    assert got == {1: (8, round(1 / 61 + 1 / 68, 9)), 2: (7, round(1 / 62 + 1 / 67, 9)), 3: (1, round(1 / 61, 9)), 4: (2, round(1 / 62, 9)), 5: (3, round(1 / 63, 9))}


def test_cycle_paths(spark):
    e = spark.createDataFrame([(1, 3), (3, 1), (1, 2), (2, 1), (4, 5), (5, 6), (6, 7), (7, 4), (5, 7), (9, 9), (9, 1)], "src long, dst long")
    assert [(r["cycle"], r["length"], r["path"]) for r in it.cycle_paths(e).orderBy("cycle").collect()] == [(1, 2, [1, 2]), (4, 3, [4, 5, 7]), (9, 1, [9])]
    assert it.cycle_paths(e.where("src > 100")).count() == 0


def test_plan_lists(spark):
    n = spark.createDataFrame([("a", "class", "A", "/a.ts", "backend"), ("b", "class", "B", "/b.ts", "api"), ("c", "class", "C", "/c.ts", "api"), ("d", "class", "D", "/d.ts", "api")], "id string, kind string, name string, file_path string, layer string")
    e = spark.createDataFrame([("a", "b", "imports"), ("b", "a", "calls"), ("b", "c", "imports"), ("c", "d", "imports"), ("d", "c", "imports")], "src string, dst string, kind string")
    plan = spark.createDataFrame([(1, "/a.ts"), (1, "/b.ts"), (1, "/c.ts"), (2, "/c.ts"), (2, "/d.ts")], "plan_id int, file_path string")
    assert rows(blast.plan_warnings(plan, n, e)) == [(1, "A (backend) -> B (api)"), (1, "B (api) -> A (backend)")]
    assert rows(blast.plan_cycles(plan, n, e)) == [(1, "A -> B"), (2, "C -> D")]


def test_impact_lists_and_tasks(spark):
    n = spark.createDataFrame([("t", "db_table", "users", "/db/schema.sql", "database"), ("u", "class", "Users", "/svc/u.ts", "backend"), ("p", "component", "Page", "/ui/p.tsx", "frontend")], "id string, kind string, name string, file_path string, layer string")
    e = spark.createDataFrame([("u", "t", "imports"), ("p", "u", "imports")], "src string, dst string, kind string")
    c = im.classify_changes(spark.createDataFrame([("1", "/db/schema.sql", "a", "ALTER TABLE users")], "id string, file_path string, old_content string, new_content string"))
    i = im.propagate(c, n, e)
    assert rows(i, "id", "depth", "severity", "via") == [("p", 2, 2, "t"), ("u", 1, 3, "t")]
    assert rows(im.impact_notes(c, i, n), "id", "reason", "action") == [
        ("p", "Transitively affected by db_table 'users' change at depth 2 (schema)", "Update data access layer in 'Page' to match new schema"),
        ("u", "Directly depends on changed db_table 'users' (schema)", "Update data access layer in 'Users' to match new schema"),
    ]
    got = im.impact_lists(c, i, n, e).first()
    assert (got["files"], got["issues"], got["critical_path"]) == (["/svc/u.ts", "/ui/p.tsx"], ["database -> backend (major)", "database -> frontend (minor)"], ["t", "u", "p"])
    assert rows(im.sync_tasks(im.cross_layer_issues(c, i, n), i, n), "file_path", "id", "priority") == [("/svc/u.ts", "u", 8), ("/ui/p.tsx", "p", 5)]


def test_rollback(spark):
    at = lambda sec: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=sec)
    c = spark.createDataFrame([("1", "/a", at(1), False, "a0"), ("2", "/a", at(2), False, "a1"), ("3", "/b", at(3), True, "b0"), ("4", "/b", at(4), False, None)], "id string, file_path string, applied_at timestamp, rolled_back boolean, original_content string")
    chosen = spark.createDataFrame([("1",), ("2",), ("2",), ("3",), ("9",)], "id string")
    marked, restores = h.rollback(c, chosen)
    assert rows(marked, "id", "rolled_back") == [("1", True), ("2", True), ("3", True), ("4", False)]
    assert rows(restores) == [("/a", "a0")]
    assert h.rollback(c, chosen.limit(0))[1].count() == 0


def test_compression_steps(spark):
    s = spark.createDataFrame([("s", i, 3000 if i >= 10 else 100) for i in range(1, 30)] + [("t", i, 10) for i in range(1, 20)], "session_id string, step int, length int")
    assert rows(x.compression_steps(s)) == [("s", 10), ("s", 18), ("s", 26)]


def test_valid_tasks(spark):
    t = spark.createDataFrame([(1, "a/b", "d"), (2, "x.py", "d"), (3, "name", "d"), (4, "", "d"), (5, None, "d"), (6, "a.ts", ""), (7, "Example.JS", "d"), (8, "c:\\x", "d"), (9, "<absolute path>/a.ts", "d")], "id int, target_file string, description string")
    assert rows(x.valid_tasks(t), "id") == [(1,), (2,), (8,)]


def test_session_outcomes_without_steps(spark):
    s = spark.createDataFrame([("a", True, False), ("b", False, True), ("c", None, None)], "session_id string, success boolean, outage boolean")
    none = spark.createDataFrame([], "session_id string, success boolean")
    tasks = spark.createDataFrame([("a", "fix the test failing"), ("c", "write docs"), ("c", None)], "session_id string, text string")
    assert rows(t.session_outcomes(s, none, tasks)) == [("a", 1.0, True), ("b", 0.0, True), ("c", 0.0, False)]


def test_provider_order(spark):
    at = lambda sec: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=sec)
    c = spark.createDataFrame([("a", at(1), 1, True, None), ("a", at(2), 2, False, "boom"), ("b", at(1), 3, False, "429 too many"), ("c", at(1), 4, True, None)], "provider string, ts timestamp, seq long, ok boolean, error string")
    tiers = {"a": 1, "b": 1, "c": 1, "d": 2}
    assert [r["provider"] for r in t.provider_order(c, tiers).orderBy("rank").collect()] == ["c", "a", "d"]
    assert [r["provider"] for r in t.provider_order(c, tiers, "d").orderBy("rank").collect()] == ["d", "c", "a"]


def test_graphql_unions_and_endpoints(spark):
    got = rows(mi.extract_graphql(files(spark, a="union Hit {\n  user: User\n}\n")), "kind", "type", "field", "field_type")
    assert got == [("union", "Hit", "user", "User")]
    f = spark.createDataFrame([("/ui/a.ts", 'app.get("/x", show)\napp.get("/x", again)\n')], "path string, content string")
    n, e = mi.build_graph(f, mi.extract_symbols(f), mi.extract_routes(f))
    assert rows(n.where("kind = 'api_endpoint'"), "name", "layer") == [("GET /x", "api")] and e.count() == 1


def test_context_with_focus_cycles_and_hubs(spark):
    from graphloom.plans.blast import graph_context

    n = spark.createDataFrame([("a", "file", "parser", "/x/parse.ts", "backend"), ("b", "file", "lexer", "/x/lex.ts", "backend"), ("c", "file", "page", "/ui/page.tsx", "frontend"), ("d", "file", "loose", "/y/parser.ts", "api"), ("e", "file", "none", "/y/e.ts", "api")], "id string, kind string, name string, file_path string, layer string")
    e = spark.createDataFrame([("a", "b", "imports"), ("b", "a", "imports"), ("c", "a", "imports")], "src string, dst string, kind string")
    tasks = spark.createDataFrame([(1, "repair the parser"), (2, "nothing here")], "query_id long, text string")
    focus = spark.createDataFrame([(1, "/ui/"), (2, "/y/e")], "query_id long, part string")
    got = {r["query_id"]: r for r in graph_context(tasks, n, e, focus).collect()}
    # neighbours: a 3, b 2, c 1; task 1 scores c 10.2, a 3.6, d 1, b 0.4; task 2 scores e 10, a 0.6, b 0.4, c 0.2
    assert got[1]["key_nodes"] == ["c:1", "a:3", "d:0", "b:2"] and got[2]["key_nodes"] == ["e:0", "a:3", "b:2", "c:1"]
    assert got[1]["files"][:4] == ["/ui/page.tsx", "/x/parse.ts", "/y/parser.ts", "/x/lex.ts"]
    assert got[1]["warnings"] == ["page (frontend) depends on parser (backend)"] and got[1]["cycles"] == ["Cycle: parser → lexer"]
    assert got[1]["summary"] == "Graph: 4 nodes (1 frontend, 2 backend, 1 api). 1 x-layer warnings. 1 cycles."
