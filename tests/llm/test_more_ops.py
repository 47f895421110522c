"""Classifier, mixing, fuzzy lines, URLs, embeddings, chats and language model."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, no_docs, odd_docs

from graphloom.llm import ballhash, chatlog, fuzzylines, gatedlm, latticehash, mixing, queries, urlrules, zipquality
from graphloom.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF01 = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_components_match_union_find(spark):
    rnd = np.random.default_rng(1)
    edges = rnd.integers(0, 400, (330, 2)).tolist() + [[i, i + 1] for i in range(1000, 1060)] + [[5, 5]] + [[2000, 2000 + k] for k in range(1, 80)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 quality
def test_quality_scores_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in queries.op1_zip_quality(spark, SF01).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(rows) == 1000
    for i, r in rows.items():
        assert r["held_out"] == (crc(i) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    out = [(rows[i]["predicted"], q) for i, q in labels.items() if rows[i]["held_out"]]
    assert sum(p == q for p, q in out) / len(out) > 0.93
    good = [p for p, q in out if q == 1]
    assert sum(good) / len(good) > 0.95


def test_quality_odd_rows(spark):
    docs = odd_docs(spark, extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    model = zipquality.fit(docs, labels)
    got = zipquality.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = zipquality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    empty = zipquality.fit(no_docs(spark), labels.where("false"))
    assert zipquality.scored(no_docs(spark), empty).count() == 0
    assert {r["score"] for r in zipquality.scored(docs, empty).collect()} == {0.5}


# 5 mixing
def brute_mix(rows, mix):
    """rows: (doc_id, domain, lang, source, tokens). Shares a node's budget over its children until all of it is placed."""
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1:4], []).append(r)

    def capacity(prefix):
        return sum(t[4] for k, v in leaves.items() if k[: len(prefix)] == prefix for t in v) * mix.max_epochs

    weights = (mix.domain_weights, mix.lang_weights, mix.source_weights)

    def give(prefix, total):
        if len(prefix) == 3:
            return {prefix: total}
        kids = sorted({k[: len(prefix) + 1] for k in leaves if k[: len(prefix)] == prefix})
        w = {k: weights[len(prefix)].get(k[-1], 1.0) for k in kids}
        got, left, open_kids = dict.fromkeys(kids, 0.0), total, list(kids)
        while open_kids:
            level = left / sum(w[k] for k in open_kids)
            full = [k for k in open_kids if capacity(k) <= w[k] * level + 1e-9]
            for k in full or open_kids:
                got[k] = capacity(k) if full else w[k] * level
            left -= sum(got[k] for k in full)
            open_kids = [k for k in open_kids if k not in full] if full else []
        out = {}
        for k in kids:
            out |= give(k, got[k])
        return out

    budget = give((), capacity(()) / mix.max_epochs * mix.share)
    out = Counter()
    for leaf, total in budget.items():
        size = sum(t[4] for t in leaves[leaf])
        epochs = min(int((total + 1e-6) // size), mix.max_epochs) if size else 0
        rest = math.floor(total + 1e-6) - epochs * size
        key = lambda t, e=epochs: hashlib.md5(f"{mix.seed}:{e + 1}:{'' if t[0] is None else t[0]}".encode()).hexdigest()
        held = Counter()
        for t in leaves[leaf]:
            held[key(t)] += t[4]
        upto, taken = 0, set()
        for k in sorted(held):
            upto += held[k]
            if upto <= rest and rest > 0 and size:
                taken.add(k)
        for t in leaves[leaf]:
            for e in range(1, epochs + 1 + (key(t) in taken)):
                out[(*t, e)] += 1
    return out


@pytest.mark.parametrize("share,epochs,rows", [(0.3, 1, 3), (0.9, 3, 50_000), (1.7, 2, 5), (5.0, 2, 10)])
def test_mixing_matches_brute_force(spark, sf, share, epochs, rows):
    p = mixing.PRODUCTION
    mix = mixing.Mix(share, epochs, 5, p.domain_weights, p.lang_weights, p.source_weights, p.domain_rules, "general", rows)
    docs = odd_docs(spark, extra=True).unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True)
    slim = [tuple(r) for r in mixing.slim_of(docs, mix).collect()]
    want = brute_mix(slim, mix)
    got = Counter((r["doc_id"], r["domain"], r["lang"], r["source"], r["tokens"], r["epoch"]) for r in mixing.selected(docs, mix).collect())
    assert got == want
    taken = mixing.mixed(docs, mix)
    assert taken.columns == docs.columns
    assert Counter(r["doc_id"] for r in taken.select("doc_id").collect()) == Counter(k[0] for k in want.elements())
    assert all(t[4] == len(WORD.findall(x["text"] or "")) for t, x in zip(slim, docs.select("text").collect(), strict=True))


def test_mixing_empty(spark):
    assert mixing.selected(no_docs(spark)).count() == 0
    assert mixing.mixed(no_docs(spark)).count() == 0


# 6 lines
def norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip(" ")


def slow_fp(words):
    import xxhash

    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(docs):
    """docs: distinct (doc_id, dh, text). Positions dropped of each, with every two lines compared."""
    at = {}
    for i, dh, text in docs:
        for pos, line in enumerate(text.split("\n")):
            if norm(line):
                at.setdefault(norm(line), []).append((-1 if i is None else i, dh, pos))
    lines = sorted(at)
    bags = [Counter(x) for x in lines]
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            most = math.floor(max(len(lines[i]), len(lines[j])) * 0.2 + 1e-9)
            if abs(len(lines[i]) - len(lines[j])) <= most and root(i) != root(j):
                # letters that only one of them has bound the distance from below
                if max((bags[i] - bags[j]).total(), (bags[j] - bags[i]).total()) <= most and edit(lines[i], lines[j]) <= most:
                    parent[root(i)] = root(j)
    groups = {}
    for i, line in enumerate(lines):
        groups.setdefault(root(i), []).extend(at[line])
    return {x for g in groups.values() for x in g if x != min(g)}


def fuzzy_docs(spark):
    rnd = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(300)]
    base = [" ".join(rnd.choice(vocabulary, n)) for n in (40, 60, 25, 12)]
    rows = []
    for i in range(25):
        lines = []
        for b in base:
            w = b.split()
            for _ in range(int(rnd.integers(0, 3))):
                w[int(rnd.integers(len(w)))] = f"new{rnd.integers(50)}"
            lines.append(" ".join(w).capitalize() + rnd.choice([".", "!", ""]))
        lines.append("short one")
        lines.append(" ".join(rnd.choice(vocabulary, 30)))
        rows.append((100 + i, "\n".join(lines), "en", "s", 1))
    rows.append((99, " ".join(reversed(base[0].split())) + "\n" + base[0], "en", "s", 1))
    return spark.createDataFrame(rows, DOCS).unionByName(odd_docs(spark).where("length(text) < 60000 or text is null"))


def test_fuzzy_lines_match_brute_force(spark):
    docs = fuzzy_docs(spark)
    docs = docs.withColumns({c: F.lit("x") for c in ("lh", "fp", "n", "pos", "g", "line")})
    hashed = docs.select("doc_id", F.xxhash64("text").alias("dh"), "text").where("text is not null").distinct().collect()
    drop = brute_lines([tuple(r) for r in hashed])
    assert len(drop) > 40
    got = fuzzylines.deduplicated(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    source = docs.select("doc_id", F.xxhash64("text").alias("dh"), "text").collect()
    want = Counter()
    for i, dh, text in source:
        kept = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (-1 if i is None else i, dh, p) not in drop)
        want[(i, kept)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in got.select("doc_id", "text").collect()) == want


def slow_fp(words):
    import xxhash

    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(words)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_line_fingerprints(spark):
    rnd = np.random.default_rng(2)
    lines = [[f"w{x}" for x in rnd.integers(0, 500, n)] for n in (1, 2, 5, 126, 127, 128, 129, 254, 255, 300, 1000)]
    got = {r["lh"]: r["fp"] & (1 << 64) - 1 for r in fuzzylines.simhash(spark.createDataFrame(list(enumerate(lines)), "lh long, words array<string>")).collect()}
    assert got == {i: slow_fp(x) for i, x in enumerate(lines)}


def damaged_lines():
    """(line, damaged copy) by kind of damage, of lines of 5 to 150 words; all are at least 0.8 similar."""
    rnd = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda n: "".join(rnd.choice(letters, n))
    vocabulary = [word(n) for n in rnd.integers(2, 12, 4000)]

    def letter(w):
        w, i = list(w), int(rnd.choice([i for i, x in enumerate(w) if len(x) >= 4] or [0]))
        at = int(rnd.integers(len(w[i])))
        w[i] = w[i][:at] + ("z" if w[i][at] == "a" else "a") + w[i][at + 1 :]
        return " ".join(w)

    def tenth(w):
        w = list(w)
        for i in rnd.choice(len(w), max(1, len(w) // 10), replace=False):
            w[i] = word(len(w[i]))
        return " ".join(w)

    def scattered(w):
        x = list(" ".join(w))
        at = [i for i, c in enumerate(x) if c != " "]
        for i in rnd.choice(at, max(1, len(at) // 20), replace=False):
            x[i] = word(1)
        return "".join(x)

    out = []
    for kind in (letter, tenth, scattered):
        for low, high in ((5, 9), (10, 19), (20, 49), (50, 99), (100, 150)):
            for _ in range(60):
                w = [str(x) for x in rnd.choice(vocabulary, rnd.integers(low, high + 1))]
                out.append((kind.__name__, low, " ".join(w), kind(w)))
    # lengths are equal, so letters that differ bound the edit distance
    return [x for x in out if 0 < sum(a != b for a, b in zip(x[2], x[3], strict=True)) <= math.floor(len(x[2]) * 0.2 + 1e-9)]


def test_lines_recall_against_plain_edit_similarity(spark):
    cases = damaged_lines()
    rows = [(i, f"{a}\n{b}", "en", "s", 1) for i, (_, _, a, b) in enumerate(cases)]
    got = {r["doc_id"]: r["n_removed"] for r in fuzzylines.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got.values()) <= {0, 1}
    found, of = Counter(), Counter()
    for i, (kind, low, _, _) in enumerate(cases):
        found[kind, low] += got[i]
        of[kind, low] += 1
    recall = {k: found[k] / of[k] for k in of}
    print(recall)
    assert all(of.values()) and len(of) == 15
    for (kind, _), share in recall.items():
        assert share >= {"letter": 0.98, "tenth": 0.95, "scattered": 0.7}[kind], recall


def test_short_lines_are_deduplicated(spark):
    rows = [(1, "Read more\n\nPage 12\nhome", "en", "s", 1), (2, "raed more!\n\nPage 13\nPart 12\n---\nHome", "en", "s", 1), (3, "one two three four\nx", "en", "s", 1), (4, "One two three four.\n\n---", "en", "s", 1)]
    got = {r["doc_id"]: r["text"] for r in fuzzylines.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: "Read more\n\nPage 12\nhome", 2: "raed more!\n\nPart 12\n---", 3: "one two three four\nx", 4: "\n---"}


def test_lines_empty(spark):
    assert fuzzylines.deduplicated(no_docs(spark)).count() == 0


# 7 URLs
def test_urls(spark, sf):
    odd = [None, "", "no scheme.net/x", "http://NET/a", "http://a.net", "http://a.net/", "x://EXAMPLE.net/en/1?q", "http://example.net/en", "http://badexample.net/EN/", "https://m.example.com/de/#f",
           "http://example.com/de", "ftp://x.org/fr/a", "http://x.org/FR/a", "http://y.com/login", "http://y.com/a.exe?x", "http://y.com/?next=/login", "http://y.com/best-casino/", "http://net:80/", "http://é.net/", "://net/x", "a://b://net/"]
    rows = [(i + 10**6, u, None) for i, u in enumerate(odd)] + [(1, "http://a.net/", "z"), (1, "http://a.net/", "z"), (None, "http://a.org/fr/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").unionByName(spark.read.parquet(f"{sf}/pages.parquet"))
    got = urlrules.judged(pages.withColumn("host", F.lit(1)).withColumn("rule", F.lit("q")).withColumn("fit", F.lit(0)))
    table = pages.toPandas()
    c = duckdb.connect()
    c.register("pages", table)
    want = c.execute(urlrules.ORACLE).fetchall()
    key = lambda r: tuple(None if x is None or x != x else x for x in r)
    assert Counter(map(key, (tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()))) == Counter(map(key, want))
    by = {r["page_id"] - 10**6: r for r in got.collect() if r["page_id"] is not None}
    assert by[6]["rule"] == "example.net/en/" and by[9]["rule"] == "example.com/de/" and by[13]["verdict"] == "block"
    assert urlrules.judged(pages.where("false")).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://common.example.com/{'rare' if i == 3 else 'x'}/",) for i in range(9)], "url string")
    index = urlrules.filed(urls, [urlrules.Rule("a", "common.*rare", ("common", "rare"), "block")])
    assert list(index) == ["rare"]


def test_twenty_thousand_rules(spark):
    hosts = [f"h{i % 500}.example{i % 7}.com" for i in range(900)]
    rows = [(i, f"http://{h}/{'ab'[i % 2]}/{i % 40}/x") for i, h in enumerate(hosts)] + [(3, "http://h3.example3.com/b/3/x")] * 2
    names = [f"h{i % 500}.example{i % 8}.com/{'ab'[i % 2]}/{i // 500}/" for i in range(20_000)] + ["example3.com/", "nowhere.org/"]
    names = sorted(set(names))
    rules = [urlrules.listed(n, "block" if len(n) % 2 else "allow") for n in names]
    got = urlrules.judged(spark.createDataFrame(rows, "page_id long, url string"), rules)

    def want(url):
        host, _, path = url[7:].partition("/")
        fits = [n for n in names if (host == n.partition("/")[0] or host.endswith("." + n.partition("/")[0])) and ("/" + path).startswith("/" + n.partition("/")[2])]
        best = min(fits, key=lambda n: (-len(n), n), default=None)
        return best, "allow" if best is None or len(best) % 2 == 0 else "block"

    by = {u: want(u) for u in {u for _, u in rows}}
    assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in got.collect()) == Counter((i, *by[u]) for i, u in rows)
    assert urlrules.judged(spark.createDataFrame(rows, "page_id long, url string"), []).where("rule is null and verdict = 'allow'").count() == len(rows)


# 8 embeddings
def brute_links(rows):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, parent = len(good), list(range(len(good)))
    links = [0] * n

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = good[i][1], good[j][1]
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i in range(n):
        low.setdefault(root(i), []).append(good[i][0])
    return Counter((good[i][0], links[i], min(low[root(i)])) for i in range(n)) + Counter((i, 0, i) for i, v in rows if not (v and all(x is not None and math.isfinite(x) for x in v) and any(v)))


def test_embeddings_match_brute_force(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for c in range(25):
        base = rnd.standard_normal(64)
        for _ in range(8):
            v = base + rnd.standard_normal(64) * rnd.choice([0.05, 0.15, 0.25])
            rows.append((len(rows), [float(x) for x in np.float32(v)]))
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, [2 * x for x in rows[0][1]]), (503, None), (504, []), (505, [0.0] * 64), (506, [float("nan")] * 64), (507, [None] * 64), (508, [1.0, 2.0]), (509, [1.0, 2.1]), (510, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("n", F.lit(1))
    want = brute_links([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = latticehash.linked(df)
    total = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect())
    assert sum((total & want).values()) >= 0.97 * sum(want.values())
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())
    assert latticehash.linked(df.where("false")).count() == 0


def test_embeddings_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in latticehash.linked(spark.read.parquet(f"{sf}/embeddings.parquet")).collect())
    want = brute_links(rows)
    found = sum(k[1] * n for k, n in got.items())
    assert found >= 0.99 * sum(k[1] * n for k, n in want.items())


def test_lattice_decoding():
    x = np.random.default_rng(0).uniform(-3, 3, (200, 8))
    got = latticehash.decoded(x) / 2
    near = np.concatenate([got[:, None], got[:, None] + latticehash.ROOTS / 2], axis=1)
    assert (((near - x[:, None]) ** 2).sum(axis=2).argmin(axis=1) == 0).all()
    whole, half = np.all(got % 1 == 0, axis=1), np.all(got % 1 == 0.5, axis=1)
    assert (whole | half).all() and (got.sum(axis=1) % 2 == 0).all()


# 1 quality again: features and curve by hand
def test_scores_are_the_curve_over_compressed_sizes(spark, sf):
    docs = odd_docs(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    model = zipquality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    d = {"good": zstandard.ZstdCompressionDict(model.good), "bad": zstandard.ZstdCompressionDict(model.bad)}
    kinds = {k: zstandard.ZstdCompressor(level=3, dict_data=x, write_content_size=False, write_checksum=False, write_dict_id=False) for k, x in d.items()} | {"plain": zstandard.ZstdCompressor(level=3)}

    def score(text):
        raw = (text or "").encode()
        parts = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
        a, b, c = (sum(len(kinds[k].compress(x)) for x in parts) for k in ("good", "bad", "plain"))
        f = [(b - a) / (a + b), (c - a) / (c + a), math.log(1 + len(raw)), math.log((c + 20) / (len(raw) + 20))] if parts else [0, 0, 0, 0]
        z = [(v - m) / s for v, m, s in zip(f, model.mean, model.scale, strict=True)]
        terms = [1, *z, z[0] * abs(z[0]), z[0] * z[2], z[3] ** 2, z[3] * z[2], z[3] * z[0]]
        return 1 / (1 + math.exp(-max(-30, min(30, sum(w * v for w, v in zip(model.weights, terms, strict=True))))))

    got = Counter((r["doc_id"], round(r["score"], 6), r["predicted"]) for r in zipquality.scored(docs, model).collect())
    assert got == Counter((r["doc_id"], round(s, 6), int(s >= 0.7)) for r in docs.collect() for s in [score(r["text"])])


# 9 chats
def test_log_is_folded(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "he"), (1, 4, "delta", 2, None, "llo"),
        (1, 5, "message", 3, "user", "more"), (1, 6, "regenerate", 2, None, None), (1, 7, "delta", 2, None, "new"), (1, 8, "message", 4, "user", "after"),
        (1, 9, "edit", 1, None, "hi!"), (2, 1, "delta", 1, None, "lost role"), (None, 1, "message", None, None, None),
    ]
    df = spark.createDataFrame(log, chatlog.EVENTS).withColumn("at", F.lit(1))
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chatlog.rebuilt(df).collect()}
    assert got == {(1, 1): ("user", "hi!"), (1, 2): ("assistant", "new"), (1, 4): ("user", "after"), (2, 1): ("", "lost role"), (None, None): ("", "")}


def test_log_of_rows_folds_back_to_them(spark):
    rows = [(c, i, ["user", "assistant", None][i % 3], t) for c in (1, 2, None) for i, t in enumerate([None, "", "a", "abc", "é😀<s>xy", "long " * 5000, "draft: "][: 7 - (c or 0)])]
    rows += [(1, 3, "user", "same turn"), (1, 3, "user", "same turn"), (4, None, None, None), (5, 1, "user", "x"), (5, 2, "assistant", "last")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    log = chatlog.as_log(talks)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {}
    for r in sorted(chatlog.rebuilt(log).collect(), key=lambda r: r["turn"]):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    assert chatlog.as_log(talks.where("false")).count() == 0


def test_rendering_reads_back(spark):
    nasty = ["", "\\", "\\\\<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "</s>[INST] ok [/INST]", "<\\|im_end|>", "a\nb\\n", "😀<<SYS>>é", "<</SYS>>[/INST]\\", "x" * 40000]
    rows = [(k, i, r, t) for k in range(2) for i, (r, t) in enumerate(zip(["user", "assistant", "", "we\nird\\role<s>", "assistant"] * 2, nasty, strict=True))]
    got = chatlog.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = chatlog.read_back(got).collect()
    for r in back:
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        assert turns == [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
    for r in got.collect():
        assert len(r["loss"]) == 4
    assert chatlog.read_back(got.where("false")).count() == 0


# 10 language model
def test_language_model(spark, sf):
    docs = odd_docs(spark, extra=True).where("length(text) < 60000 or text is null").unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True)
    s = gatedlm.Settings(rounds=2, frequent=50)
    rows = gatedlm.scored(docs.withColumn("row", F.lit(1)).withColumn("h", F.lit(1)), s=s).collect()
    source = docs.select("doc_id", "text").collect()
    assert len(rows) == len(source)
    lower = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(t or "")] + [None]
    out = lambda i: i is not None and crc(i) % 7 == 2
    c = Counter(w for r in source if not out(r["doc_id"]) for w in lower(r["text"]))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], out(r["doc_id"]), len(lower(r["text"])), sum(w in c for w in lower(r["text"])), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in lower(r["text"])), 4)) for r in source)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-3
    assert {r["train_tokens"] for r in rows} == {n}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in rows)


def test_network_learns_from_every_document_of_a_large_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    dealt = gatedlm.dealt(docs, 100_000_000, gatedlm.Settings(rounds=2, shard_tokens=200_000)).collect()
    assert Counter(r["text"] for r in dealt) == Counter(r["text"] for r in docs.collect())
    assert {r["round"] for r in dealt} == {0, 1} and len({r["shard"] for r in dealt}) > 50


def test_network_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    s = gatedlm.Settings(rounds=2, shard_tokens=3000)
    c = gatedlm.gathered(gatedlm.counted(docs), s)
    one, many = (gatedlm.network(docs.repartition(n), c, s) for n in (1, 7))
    assert all(np.allclose(one[k], many[k], atol=1e-5) for k in one)
    assert not np.allclose(one["w"], gatedlm.fresh(c, s)["w"], atol=1e-3)


def slow_log_probabilities(w, symbols, s):
    """Natural log-probabilities of one document's symbols: the network's equations, a word at a time, in doubles."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    n, before, h, out = s.hidden, 0, np.zeros(s.hidden), []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for target in symbols:
        h = np.zeros(n) if before == 0 else h
        x, a = w["x"][before], h @ w["u"]
        z, r = sigmoid(x[:n] + a[:n]), sigmoid(x[n : 2 * n] + a[n : 2 * n])
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * a[2 * n :])
        k = target // s.class_words if target < s.own else target - s.own + s.own_classes
        logits = w["c"] @ h + w["cb"]
        p = logits[k] - np.log(np.exp(logits).sum())
        if target < s.own:
            logits = w["w"][k] @ h + w["wb"][k]
            p += logits[target % s.class_words] - np.log(np.exp(logits).sum())
        out.append(p)
        before = target
    return out


def test_scores_match_the_equations_word_by_word(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    s = gatedlm.Settings(own_classes=4, class_words=8, rounds=1, window=7, frequent=20)
    got = {r["doc_id"]: r["score"] for r in gatedlm.scored(docs, s=s).collect()}
    train = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2)
    c = gatedlm.gathered(gatedlm.counted(train), s)
    w = gatedlm.network(train, c, s)
    counts = Counter({r["h"]: r["n"] for r in gatedlm.counted(train).collect()})
    for r in docs.collect():
        numbers, kinds, _ = gatedlm.tokens_of([(r["text"] or "").encode()])
        symbols = gatedlm.symbols(numbers, kinds, c, s)
        want = sum(slow_log_probabilities(w, symbols.tolist(), s)) / math.log(10)
        for h, symbol in zip(numbers.tolist(), symbols.tolist(), strict=True):
            if symbol >= s.own:
                k = symbol - s.own
                want += math.log10((counts[h] + 1) / (c.tail_tokens[k] + c.tail_kinds[k] + 1))
        assert abs(want - got[r["doc_id"]]) <= 1e-3 * abs(want) + 1e-2


def test_gradients_match_differences(monkeypatch):
    s = gatedlm.Settings(own_classes=3, class_words=2, hidden=4, lanes=2, window=50, train_lanes=1, train_window=50, rate=1e-6)
    c = gatedlm.Corpus(np.array([], np.int64), np.array([], np.int64), np.array([1]), np.array([0]), np.array([5, 4, 3, 2, 1, 1]), 30, 9, np.ones(64, np.int64), np.ones(64, np.int64))
    w = {k: v.astype(np.float64) for k, v in gatedlm.fresh(c, s).items()}
    target = np.array([1, 2, 3, 9, 4, 5, 1, 0], np.int32)
    loss = lambda w: -sum(slow_log_probabilities(w, target.tolist(), s))
    found = []
    clip = np.clip
    monkeypatch.setattr(gatedlm.np, "clip", lambda v, *a: found.append(v) or clip(v, *a))
    gatedlm.trained({k: v.astype(np.float32) for k, v in w.items()}, target, s)
    by_shape = {v.shape: v for v in found}
    rnd = np.random.default_rng(0)
    for k in ("x", "u", "c", "cb", "w", "wb"):
        for _ in range(12):
            at = tuple(int(rnd.integers(n)) for n in w[k].shape)
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - by_shape[w[k].shape][at]) < 2e-3, (k, at)


def test_network_is_a_distribution_and_learns():
    s = gatedlm.Settings(own_classes=3, class_words=2, hidden=4, lanes=3, window=5, train_lanes=2, train_window=4)
    c = gatedlm.Corpus(np.array([], np.int64), np.array([], np.int64), np.array([1]), np.array([0]), np.array([5, 4, 3, 2, 1, 1]), 30, 9, np.ones(64, np.int64), np.ones(64, np.int64))
    w = gatedlm.fresh(c, s)
    states = np.random.default_rng(0).standard_normal((1, 4)).astype(np.float32)
    every = np.arange(s.own + 64)
    p = np.exp(gatedlm.log_probability(w, np.repeat(states, len(every), axis=0), every, s))
    assert abs(p.sum() - 1) < 1e-4
    target = np.array([1, 2, 0, 3, 9, 4, 5, 0, 0], np.int32)
    owner = np.array([0, 0, 0, 1, 1, 1, 1, 1, 2])
    whole = gatedlm.scores(w, target, owner, 3, s)
    alone = [gatedlm.scores(w, target[owner == d], np.zeros((owner == d).sum(), int), 1, s)[0] for d in range(3)]
    assert np.allclose(whole, alone, atol=1e-4)
    better = w
    for _ in range(30):
        better = gatedlm.trained(better, target, s)
    assert gatedlm.scores(better, target, owner, 3, s).sum() > whole.sum() + 1
    assert gatedlm.scores(w, np.array([], np.int32), np.array([], int), 0, s).shape == (0,)


@pytest.mark.parametrize("lanes", [1, 3, 7, 50])
def test_lanes_hold_documents_whole_and_in_order(lanes):
    sizes = [3, 4000, 1, 1, 250, 12]
    target = np.concatenate([np.r_[np.full(n - 1, k + 1), 0] for k, n in enumerate(sizes)]).astype(np.int32)
    grid, length = gatedlm.stretches(target, lanes)
    parts = [grid[:n, k] for k, n in enumerate(length)]
    assert np.array_equal(np.concatenate(parts), target) and (length > 0).all() and (np.diff(length) <= 0).all()
    assert sum(p[-1] != 0 for p in parts) <= lanes - 1


def test_training_runs_through_a_long_document():
    """One lane learns a document of 2,400 repeating words in windows of 40 steps."""
    s = gatedlm.Settings(own_classes=3, class_words=2, hidden=4, lanes=2, window=50, train_lanes=1, train_window=40, rate=0.1)
    c = gatedlm.Corpus(np.array([], np.int64), np.array([], np.int64), np.array([1]), np.array([0]), np.array([5, 4, 3, 2, 1, 1]), 30, 9, np.ones(64, np.int64), np.ones(64, np.int64))
    w, target = gatedlm.fresh(c, s), np.array([1, 2, 3, 4] * 600 + [0], np.int32)
    before = gatedlm.scores(w, target, np.zeros(len(target), int), 1, s)[0]
    after = gatedlm.scores(gatedlm.trained(w, target, s), target, np.zeros(len(target), int), 1, s)[0]
    assert after > before * 0.6 and np.isfinite(after)


def test_language_model_empty(spark):
    assert gatedlm.scored(no_docs(spark)).count() == 0


def test_huge_and_tiny_vectors_link(spark):
    rows = [(0, [1e200] * 16), (1, [2e200] * 16), (2, [1e-200] * 16), (3, [5e-324] * 16), (4, [1e200, -1e200] * 8), (5, [1.7e308] * 8 + [1e-300] * 8)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in latticehash.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (0, 5)}


CLASHING = ("__h", "__id", "__hash", "__dh", "__drop", "__domain", "__key", "__epochs", "__last", "__share", "__copies", "__epoch", "kept_1", "tokens")


@pytest.mark.parametrize("stage", [ballhash.one_of_each, mixing.mixed, fuzzylines.deduplicated])
def test_stages_keep_columns_of_any_name(spark, stage):
    docs = odd_docs(spark).where("length(text) < 60000 or text is null")
    wide = docs.select("*", *(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias(c) for c in CLASHING))
    got = stage(wide)
    assert got.columns[: len(wide.columns)] == wide.columns
    rows = got.collect()
    assert all(str("none" if r["doc_id"] is None else r["doc_id"]) == r[c] for r in rows for c in CLASHING)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, rows)) == sorted(map(key, stage(docs).collect()))
