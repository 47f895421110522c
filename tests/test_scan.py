"""Packed searches, distributed numbers, and folds over ranges, each with many partitions against a plain version."""

import random
from collections import Counter, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.operators import breaker, iterate, packed, scan, telemetry


@pytest.fixture
def split(spark):
    """Small inputs keep several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def random_graph(seed, n=60, m=140):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]


def brute_reach(edges, starts, most):
    out, near = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    depth, queue = {s: 0 for s in starts}, deque(starts)
    while queue:
        x = queue.popleft()
        if most is None or depth[x] < most:
            for y in near.get(x, ()):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
    return {k: v for k, v in depth.items() if v}


@pytest.mark.parametrize("direction,limited", [("out", False), ("in", False), ("out", True)])
def test_packed_reach_equals_a_search_for_each_seed(split, direction, limited):
    edges = random_graph(4)
    seeds = [(s, s) for s in range(60)] + [(100 + s, n) for s in range(150) for n in (s % 60, s * 7 % 60)]
    limits = {s: s % 5 for s, _ in seeds if s % 11} if limited else None
    e = split.createDataFrame(edges, "src long, dst long")
    given = split.createDataFrame(seeds, "seed long, node long")
    limit = split.createDataFrame(sorted(limits.items()), "seed long, max_depth int") if limited else None
    got = Counter(tuple(r) for r in iterate.reach(given, e, direction, None, limit).select("seed", "node", "depth").collect())
    way = edges if direction == "out" else [(b, a) for a, b in edges]
    want = Counter()
    for s in {s for s, _ in seeds if limits is None or s in limits}:
        found = brute_reach(way, [n for x, n in seeds if x == s], None if limits is None else limits[s])
        want.update((s, n, d) for n, d in found.items())
    assert got == want


def test_long_way_is_found(split):
    e = split.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    seed = split.createDataFrame([(0, 0)], "seed long, node long")
    assert {r["node"]: r["depth"] for r in iterate.reach(seed, e).collect()} == {i: i for i in range(1, 31)}
    pairs = split.createDataFrame([(0, 30), (30, 0)], "src long, dst long")
    assert {(r["src"], r["length"]) for r in iterate.shortest_paths(pairs, e).collect()} == {(0, 30), (30, None)}
    assert {(r["src"], r["length"]) for r in iterate.shortest_paths(pairs, e, 20).collect()} == {(0, None), (30, None)}


def test_levels_of_many_groups(split):
    rnd = random.Random(2)
    edges = random_graph(9, 40, 50) + [(5, 5)]
    groups = [(g, n) for g in range(130) for n in range(40) if rnd.random() < 0.5]
    got = {(r["grp"], r["id"]): (r["level"], r["position"]) for r in iterate.topological_levels(split.createDataFrame(groups, "grp long, id long"), split.createDataFrame(edges, "src long, dst long")).collect()}
    for g in range(130):
        left, level, found = {n for x, n in groups if x == g}, 0, {}
        while free := {n for n in left if not any(a == n and b in left for a, b in edges)}:
            found |= dict.fromkeys(free, level)
            left, level = left - free, level + 1
        found |= dict.fromkeys(left)
        order = sorted(found, key=lambda n: (found[n] is None, found[n] or 0, n))
        assert {n: got[g, n] for n in found} == {n: (found[n], order.index(n) + 1) for n in found}


def test_numbers_of_groups_over_partitions(split):
    rows = [(None if i % 9 == 0 else "big" if i % 3 else f"g{i % 7}", i * 37 % 1000) for i in range(900)]
    got = packed.numbered(split.createDataFrame(rows, "g string, v long"), "g", [F.desc("v")]).collect()
    for g in {r[0] for r in rows}:
        values = sorted((v for x, v in rows if x == g), reverse=True)
        assert [r["v"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["position"])] == values
        assert sorted(r["position"] for r in got if r["g"] == g) == list(range(1, len(values) + 1))


def test_maps_of_ranges_equal_a_plain_replay():
    rnd = random.Random(1)
    for _ in range(3000):
        made = breaker.Breaker(rnd.choice([1, 2, 3]), rnd.choice([0, 3, 10]), rnd.choice([1, 2, 3]))
        ms = sorted(rnd.randrange(-20, 40) for _ in range(rnd.randrange(1, 9)))
        ok = [rnd.random() < 0.7 for _ in ms]
        limits, exits = made.map_of(ms, ok)
        entries = [*made.entries(), *((breaker.OPEN, 0, s) for s in range(-40, ms[0] + 1, 3))]
        for state in entries:
            plain = state
            for t, o in zip(ms, ok):
                plain = made.step(plain, t, o)
            assert made.through(state, limits, exits) == plain, (made, ms, ok, state)


def calls_of(spark, n=400):
    rnd = random.Random(6)
    began, rows = datetime(2026, 1, 1), []
    for i in range(n):
        provider = None if rnd.random() < 0.05 else "hot" if rnd.random() < 0.8 else f"p{rnd.randrange(3)}"
        ok = rnd.random() < (0.9 if (i // 40) % 2 else 0.2)
        began += timedelta(milliseconds=rnd.choice([0, 900, 4000, 30_000, 70_000]))
        error = None if ok else rnd.choice(["429", "boom", "Too Many Requests", "rate limit hit"])
        rows.append((provider, f"m{rnd.randrange(2)}", ok, rnd.random() * 100, error, 10, rnd.random(), began, i))
    return spark.createDataFrame(rows, "provider string, model string, ok boolean, latency_ms double, error string, tokens long, cost double, ts timestamp, seq long"), rows


def test_breaker_over_many_ranges(split):
    calls, rows = calls_of(split)
    got = {r["seq"]: r["state"] for r in telemetry.circuit_states(calls, 3, 60_000, 2).collect()}
    made, state, want = breaker.Breaker(3, 60_000, 2), {}, {}
    for p, _, ok, _, error, _, _, ts, seq in rows:
        if ok or error == "boom":
            state[p] = made.step(state.get(p, made.START), int(ts.timestamp() * 1000), ok)
            want[seq] = made.NAMES[state[p][0]]
    assert got == want and len(set(want.values())) == 3


def test_health_over_many_ranges(split):
    calls, rows = calls_of(split)
    got = {r["seq"]: r for r in telemetry.provider_health(calls).collect()}
    run, status, good, seen = Counter(), {}, Counter(), Counter()
    for p, _, ok, _, error, _, _, _, seq in rows:
        run[p] = 0 if ok else run[p] + 1
        good[p] += ok
        seen[p] += 1
        limited = not ok and error != "boom"
        if ok:
            status[p] = "HEALTHY"
        elif limited and run[p] >= 3:
            status[p] = "CIRCUIT_BROKEN"
        elif limited or run[p] >= 2:
            status[p] = "DEGRADED"
        r = got[seq]
        assert (r["provider"], r["consecutive"], r["status"], r["success_rate"]) == (p, run[p], status.get(p, "HEALTHY"), round(good[p] / seen[p], 6))
    assert len(got) == len(rows)


def test_model_health_and_admission_over_many_ranges(split):
    calls, rows = calls_of(split)
    got = {(r["provider"], r["model"]): r for r in telemetry.model_health(calls).collect()}
    run, average, blacked, owed = Counter(), {}, Counter(), {}
    for p, m, ok, latency, error, _, _, _, _ in rows:
        blacked[p] = 0 if ok else blacked[p] + 1
        run[p, m] = 0 if ok else run[p, m] + 1
        average[p, m] = average.get((p, m), 2000.0) * (0.7 if ok else 1) + (0.3 * latency if ok else 0)
        owed[p, m] = blacked[p] >= 3
    assert {k: (r["consecutive"], r["latency_avg"], r["blackout"]) for k, r in got.items()} == {k: (run[k], round(average[k], 4), owed[k]) for k in average}
    spent, last, want = Counter(), {}, {}
    for p, _, _, _, _, _, cost, ts, seq in rows:
        want[seq] = "too_expensive" if round(spent[p], 9) >= 30 else "too_soon" if p in last and (ts - last[p]).total_seconds() < 1 else None
        spent[p] += cost
        last[p] = ts
    assert {r["seq"]: r["refused"] for r in telemetry.admission_audit(calls, 30.0, 60).collect()} == want


def test_ranges_split_a_key(split):
    calls, _ = calls_of(split)
    assert scan.cut(calls, "provider", "ts", "seq").where("provider = 'hot'").select(scan.PART).distinct().count() > 1
