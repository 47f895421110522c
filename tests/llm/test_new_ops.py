"""Filter audit, weak supervision of toxicity, ranked lexical search."""

import glob
import math
import os
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import no_docs, odd_docs

from graphloom.llm import filteraudit, queries, termsearch, weaktoxic

SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_term_search"])
def test_same_rows_as_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(tuple(r[i] for i in order) for r in want.fetchall())


def labels_of(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(14)] + [(6, 1, None), (None, 1, 1), (5, None, None), (3, 0, 0)], LABELS)


# 11 filter audit
def test_shapley_map_solves_every_game():
    rnd = random.Random(3)
    value = [0] + [rnd.randrange(1000) for _ in range(31)]
    rows = filteraudit.shapley_map(5)
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << x for x in order[: order.index(i)])
            total += value[before | 1 << i] - value[before]
        assert sum(w * v for w, v in zip(rows[i], value)) * math.factorial(5) == total
    assert sum(sum(w * v for w, v in zip(r, value)) for r in rows) == value[31]


def brute_audit(docs, labels):
    first, good, toxic = {}, set(), set()
    for r in docs:
        t = r["text"] or ""
        if r["doc_id"] is not None:
            first[t] = min(first.get(t, r["doc_id"]), r["doc_id"])
    for r in labels:
        if r["doc_id"] is not None:
            good |= {r["doc_id"]} if r["quality"] == 1 else set()
            toxic |= {r["doc_id"]} if r["toxic"] == 1 else set()
    parts = {}
    for r in docs:
        t = r["text"] or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": r["doc_id"] is not None and first[t] < r["doc_id"],
        }
        parts.setdefault(r["lang"] or "", []).append(({f for f, x in fails.items() if x}, r["doc_id"] in good, r["doc_id"] in toxic))
    out = {}
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = list(rows)
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failed = sum(f in r[0] for r in rows)
                out[part, "".join(order), k + 1] = [len(left), len(gone), failed - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    shapley = Counter()
    for (part, order, k), v in out.items():
        shapley[part, order[k - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("extra", [False, True])
def test_audit_matches_brute_force(spark, extra):
    docs = odd_docs(spark)
    labels = labels_of(spark)
    want = brute_audit(docs.collect(), labels.collect())
    if extra:
        for c in ("part", "mask", "sha", "n", "good", "toxic", "quality", "salt", "step", "removed", "total"):
            docs, labels = docs.withColumn(c, F.lit("x")), labels if c in labels.columns else labels.withColumn(c, F.lit("y"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filteraudit.COUNTS) for r in filteraudit.audited(docs, labels).collect()}
    assert got == want


def test_audit_of_empty_tables(spark):
    docs, labels = odd_docs(spark), labels_of(spark)
    assert filteraudit.audited(no_docs(spark), labels).count() == 0
    rows = filteraudit.audited(docs, labels.where("false")).collect()
    assert rows and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)


# 12 toxicity
def test_toxicity_of_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in queries.op12_weak_toxicity(spark, SF01).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert len(rows) == 1000
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    clean = [rows[i]["predicted"] for i, t in labels.items() if t == 0 and rows[i]["held_out"]]
    assert sum(clean) <= 0.02 * len(clean)
    insults = set(weaktoxic.LEXICONS["wits"].split()) | {"worthless", "loser", "scum", "pathetic"}
    plain = [rows[i]["predicted"] for i, t in labels.items() if t == 1 and insults & set(weaktoxic.words_of(texts[i]))]
    assert len(plain) > 20 and all(plain)


def test_label_model_finds_accuracies_and_correlations():
    rnd = np.random.default_rng(8)
    names, n = weaktoxic.VOTERS, 40_000
    y = rnd.random(n) < 0.1
    votes = np.zeros((n, len(names)), dtype=int)
    rates = {0: (0.8, 0.01), 1: (0.6, 0.02), 2: (0.5, 0.005), 3: (0.4, 0.03), 6: (0.7, 0.01), 7: (0.1, 0.1)}
    for j, (hit, false) in rates.items():
        votes[:, j] = rnd.random(n) < np.where(y, hit, false)
    votes[:, 8] = np.where(rnd.random(n) < 0.95, votes[:, 6], 1 - votes[:, 6])  # echoes voter 6
    votes[:, -2] = rnd.random(n) < np.where(y, 0.2, 0.7)
    patterns = Counter(int(sum(1 << j for j in np.flatnonzero(v))) for v in votes)
    model = weaktoxic.label_model(patterns, {})
    assert model.parent[8] == 6 or model.parent[6] == 8
    q = model.posterior(votes)
    assert ((q > 0.5) == y).mean() > 0.97
    assert abs(model.prior - 0.1) < 0.03
    # noisy labels of a sample are one more voter
    some = rnd.random(n) < 0.05
    marked = Counter((int(sum(1 << j for j in np.flatnonzero(v))), bool(t ^ (rnd.random() < 0.05))) for v, t in zip(votes[some], y[some]))
    q = weaktoxic.label_model(patterns, marked).posterior(votes)
    assert ((q > 0.5) == y).mean() > 0.97


def test_voters_read_disguise_address_and_families():
    lists = weaktoxic.lists_of({"word": ["zark"], "family": ["gro++"]})

    def said(text):
        return {weaktoxic.VOTERS[j] for j in range(len(weaktoxic.VOTERS)) if weaktoxic.votes_of(text, lists) >> j & 1}

    assert said("you are an IDIOT") == {"wits", "address", "shout"}
    assert said("what an id1ot") == said("what an id*ot.") == {"disguise"}
    assert said("zark and scum") == {"vermin", "word0", "several"}
    assert said("groaning") == {"family1"} and said("groan grow gros") == {"family1", "family2", "family3"}
    assert said("gro") == said(None) == said("") == set() and said("fine words " * 20) == {"calm", "quiet"}
    assert said("Of five WORDS, All loud") == {"calm"} and said("fine words! " * 20) == {"quiet"}
    assert said("i will kill you, shut up") == {"threat", "dismissal"}


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark, extra=True)
    model = weaktoxic.fit(docs, labels_of(spark))
    got = weaktoxic.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    long = spark.createDataFrame([(1, "fine " * 400_000 + "idiot"), (2, "fine " * 400_000)], "doc_id long, text string")
    a, b = (r["score"] for r in weaktoxic.scored(long, model).orderBy("doc_id").collect())
    assert 0 <= a <= 1 and 0 <= b <= 1
    empty = weaktoxic.fit(no_docs(spark), labels_of(spark).where("false"))
    assert weaktoxic.scored(no_docs(spark), empty).count() == 0
    assert {r["score"] for r in weaktoxic.scored(docs, empty).collect()} == {0.5}
    assert {r["score"] for r in weaktoxic.scored(docs, weaktoxic.fit(docs, labels_of(spark).where("false"))).collect()} == {0.5}


# 13 ranked search
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(items, docs, k):
    terms = [(i, TERM.findall(t.translate(FOLD))) for i, t in docs if t]
    terms = [(i, t) for i, t in terms if t]
    n_docs, n_terms = len(terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(FOLD)))
    out = []
    for item, words in asked.items():
        found = []
        for i, t in terms:
            tf, m = Counter(t), 50 + 50 * len(t) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * m)) for w in words if tf[w])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return Counter(out)


@pytest.mark.parametrize("settings", [termsearch.Settings(k=5, block_terms=40, portion=60, merge=3), termsearch.Settings(k=3, portion=1), termsearch.Settings()])
def test_search_matches_brute_force(spark, settings):
    rnd = random.Random(settings.k)
    words = [f"w{i}" for i in range(60)] + ["Öl", "it's", "A1", "x_y", "你好"]
    text = lambda n: " ".join(words[min(int(rnd.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 60))) for i in range(150)] + [(i, "w3 w4") for i in range(400, 420)] + [(None, "w3 w4"), (7, None), (8, ""), (9, " .,! "), (9, "w50 w51"), (9, "w50 w51")]
    items = [(i, text(8)) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w3 w4"), (33, "W50"), (None, "w1 w2"), (34, " ".join(words))]
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("terms", F.lit(1)).repartition(4)
    got = termsearch.searched(spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1)), given, settings)
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == brute_search(items, docs, settings.k)


def test_search_of_odd_and_empty_tables(spark):
    docs = odd_docs(spark, extra=True)
    items = spark.createDataFrame([(1, "one two alpha2 beta7 Öl"), (2, "tail smile")], "item_id long, text string")
    got = termsearch.searched(items, docs, termsearch.Settings(k=6))
    want = brute_search([tuple(r) for r in items.collect()], [(r["doc_id"], r["text"]) for r in docs.collect()], 6)
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want
    assert termsearch.searched(items.where("false"), docs).count() == 0
    assert termsearch.searched(items, no_docs(spark)).count() == 0
    assert set(termsearch.searched(items, no_docs(spark)).columns) == {"item_id", "rank", "doc_id", "score"}


def test_lengths_beyond_64_bits():
    n = np.array([10**8, 3])
    assert termsearch.lengths_against_mean(n, 10**11, 10**14).tolist() == [50 + 50 * int(x) * 10**11 // 10**14 for x in n]
