"""What the third review found, on small tables by hand."""

import random

from pyspark.sql import functions as F

from graphloom.llm import fuzzylines
from graphloom.operators import impact as im
from graphloom.operators import iterate as it
from graphloom.operators import retrieval as rt
from graphloom.plans import blast
from graphloom.sources import readers as rd


def test_cached_responses_serve_their_own_scope(spark):
    """Equal texts of another conversation are no hit; a null text has a null key and is told by its scope."""
    rows = [(1, "user", "hi", 7), (2, "user", "hi", 8), (3, "user", None, 8), (4, "user", None, 7)]
    asked = spark.createDataFrame(rows, "id int, system string, user string, conv int")
    cache = asked.where("conv = 8").select(rd.request_key("system", "user").alias("key"), "conv", F.col("id").cast("string").alias("response"), F.col("id").alias("written_at"))
    got = {r["id"]: (r["key"] is None, r["response"]) for r in rd.cached_responses(asked, cache, ("conv",)).collect()}
    assert got == {1: (False, None), 2: (False, "2"), 3: (True, "3"), 4: (True, None)}
    got = {r["id"]: r["response"] for r in rd.cached_responses(asked, cache).collect()}
    assert got == {1: "2", 2: "2", 3: None, 4: None}


def test_path_lengths_are_those_of_shortest_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(0, 5), (9, 0), (3, 3)], "src int, dst int")
    for pairs in ([(i, 7) for i in range(12)] + [(4, 4)], [(2, i) for i in range(12)] + [(3, 3)]):
        pairs = spark.createDataFrame(pairs, "src int, dst int")
        for most in (None, 3):
            want = it.shortest_paths(pairs, edges, most).select("src", "dst", "length").collect()
            assert sorted(it.path_lengths(pairs, edges, most).collect(), key=str) == sorted(want, key=str)


def test_nearest_hands_on_the_smallest_of_the_nearest_starts(spark):
    """Against a search for each start, on a graph with cycles, ties and a start that another one reaches."""
    edges = spark.createDataFrame([("a", "d"), ("b", "d"), ("d", "e"), ("c", "e"), ("e", "f"), ("f", "a"), ("a", "b"), ("x", "f")], "src string, dst string")
    starts = [("g", n) for n in "abc"] + [("h", n) for n in "xb"] + [("i", "z")]
    seeds = spark.createDataFrame(starts, "seed string, node string")
    each = it.reach(seeds.selectExpr("node as seed", "node").distinct(), edges, "out").collect()
    for most in (None, 1, 2):
        want = {(g, s): (0, s) for g, s in starts}
        for g, s in starts:
            for r in each:
                if r["seed"] == s and (most is None or r["depth"] <= most):
                    want[g, r["node"]] = min(want.get((g, r["node"]), (99, "")), (r["depth"], s))
        got = {(r["seed"], r["node"]): (r["depth"], r["origin"]) for r in it.nearest(seeds, edges, "out", most).collect()}
        assert got == want


def test_impacted_tests_of_a_changed_test_file(spark):
    """A node of a changed test file counts if another changed node finds it, but not for itself."""
    nodes = spark.createDataFrame([("a", "/a.ts"), ("t", "/t.test.ts"), ("u", "/t.test.ts"), ("v", "/v.test.ts")], "id string, file_path string")
    edges = spark.createDataFrame([("t", "a", "imports"), ("t", "u", "imports"), ("v", "t", "imports")], "src string, dst string, kind string")
    changes = spark.createDataFrame([("1", "/a.ts"), ("2", "/t.test.ts"), ("3", "/v.test.ts")], "id string, file_path string")
    got = {tuple(r) for r in im.impacted_tests(changes, nodes, edges).collect()}
    assert got == {("1", "/t.test.ts"), ("1", "/v.test.ts"), ("2", "/t.test.ts"), ("2", "/v.test.ts")}


def test_holding_finds_words_of_any_length(spark):
    long = "a" * 40
    words = [("ab",), ("order 1",), (long,), (long + "b",), ("",), (None,), ("zz",), ("b",)]
    texts = [("xab",), ("order 12",), (long + "bc",), ("",), (None,), ("order 2",), ("b",)]
    got = {tuple(r) for r in rt.holding(spark.createDataFrame(words, "kw string"), spark.createDataFrame(texts, "text string")).collect()}
    assert got == {(w, t) for (w,) in words for (t,) in texts if w is not None and t is not None and w in t}


def test_holding_lists_no_text_that_merely_shares_letters(spark):
    """Numbered names share most of their letters; what meets a word holds it."""
    texts = spark.range(3000).selectExpr("concat('order ', id) as text")
    words = spark.range(500).selectExpr("concat('order ', id * 7 + 10000) as kw")
    found = rt.holding(words, texts)
    assert found.isEmpty()


def test_queries_of_the_same_words_are_ranked_once(spark):
    nodes = spark.createDataFrame([(f"n{i:03}", "function", f"{w} {v}", f"/f{i % 7}.ts") for i, (w, v) in enumerate([(a, b) for a in ("red", "blue") for b in ("ring", "bolt")] * 20)], "id string, kind string, name string, file_path string")
    edges = spark.createDataFrame([("n000", "n004"), ("n003", "n007"), ("n001", "n005")], "src string, dst string")
    queries = spark.createDataFrame([(1, "red ring"), (2, "ring red"), (3, "red red ring"), (4, "blue"), (5, "green")], "query_id int, text string")
    for profile, top in (("search", 15), ("context", 30)):
        got = {}
        for r in sorted(rt.keyword_rank(queries, nodes, edges, profile).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["id"], r["score"], r["rank"]))
        each = {}
        for k in (1, 2, 3, 4):
            rows = rt.keyword_rank(queries.where(f"query_id = {k}"), nodes, edges, profile).collect()
            each[k] = sorted(((r["id"], r["score"], r["rank"]) for r in rows), key=lambda x: x[2])
        assert got == each
        assert [x[1:] for x in got[1]] == [x[1:] for x in got[2]]
        assert all(len(v) >= top for k, v in got.items() if k != 4 or profile == "search")


def long_pair(letters: int, every: int) -> tuple[str, str]:
    """Two lines that share every second word; in the others each `every`-th letter is another one."""
    rng = random.Random(7)
    x, y, n = [], [], 0
    while n < letters:
        w = "".join(rng.choices("abcdefghij", k=11))
        x.append(w)
        y.append("".join("z" if i % every == 0 else c for i, c in enumerate(w)) if len(x) % 2 else w)
        n += 12
    return " ".join(x), " ".join(y)


def test_long_lines_are_compared_letter_by_letter(spark):
    """Edits scattered over a line of more than 8,192 letters: blocks of letters differ, letters are similar."""
    near, far = long_pair(9_000, 4), long_pair(9_000, 2)
    texts = spark.createDataFrame([(1, near[0]), (2, near[1]), (3, far[1])], "lh long, line string")
    got = fuzzylines._similar(spark.createDataFrame([(2, 1), (3, 1)], "a long, b long"), texts, 0.8)
    assert {tuple(r) for r in got.collect()} == {(2, 1, True), (3, 1, False)}


def test_plan_warnings_with_equal_first_warnings(spark):
    """Several pairs of files start with the same words; the first of the plan are still whole."""
    nodes, edges = [], []
    for i in range(6):
        nodes += [(f"a{i}", f"n{i % 2}", f"/a{i % 3}", "api"), (f"b{i}", f"m{i % 4}", f"/b{i % 2}", "database")]
        edges += [(f"a{i}", f"b{j}", "imports") for j in range(6)]
    name, path = {n[0]: n[1] for n in nodes}, {n[0]: n[2] for n in nodes}
    plans = {"p": ["/a0", "/a1", "/a2", "/b0", "/b1"], "q": ["/a1", "/b1"], "r": ["/a0", "/a1"]}
    for most in (1, 3, 10):
        want = set()
        for p, files in plans.items():
            own = sorted({f"{name[s]} (api) -> {name[t]} (database)" for s, t, _ in edges if path[s] in files and path[t] in files})
            want |= {(p, w) for w in own[:most]}
        plan = spark.createDataFrame([(p, f) for p, files in plans.items() for f in files], "plan_id string, file_path string")
        n = spark.createDataFrame(nodes, "id string, name string, file_path string, layer string")
        e = spark.createDataFrame(edges, "src string, dst string, kind string")
        got = [tuple(r) for r in blast.plan_warnings(plan, n, e, most).collect()]
        assert len(got) == len(want) and set(got) == want
