"""Packing, repetition rules and SimHash against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tests.llm.helpers import DOCS, no_docs, odd_docs, odd_texts
from tokenizers import Tokenizer

from graphloom.llm import ballhash, binslack, queries, suffixrules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(spark, sf, n=60):
    return [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").take(n)]


def test_chunked_ids_are_the_tokenizers_own(spark, sf):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x or "" for x in odd_texts() + texts_of(spark, sf)] + ["it's we'll a's", "a \n b", "\n a", " a b", "a b ", "12 3a!! b", "a\x1cb c\x1c d"]
    for ranks in (None, queries.tokenizer_files()["ranks"]):
        encode = binslack.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), ranks)
        for _ in range(2):
            got = encode(texts)
            for x, g in zip(texts, got, strict=True):
                assert np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() == g, x[:50]


@pytest.mark.parametrize("seed", range(4))
def test_fill_uses_every_piece_once(seed):
    rnd = np.random.default_rng(seed)
    counts = Counter(rnd.integers(1, 33, 300).tolist())
    plan = binslack.fill(dict(counts), 64)
    used = Counter()
    for pattern, uses in plan:
        assert uses > 0 and sum(n * k for n, k in pattern) <= 64
        for n, k in pattern:
            used[n] += k * uses
    assert used == counts
    full = sum(u for p, u in plan if sum(n * k for n, k in p) == 64)
    assert full >= sum(u for _, u in plan) - 3
    assert binslack.fill({}, 64) == []


def check_packing(rows, texts_by_key, capacity=2048):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for doc, text in texts_by_key.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    return by_seq


def test_packing_covers_every_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op2_bin_slack_packing(spark, sf).collect()
    by_seq = check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    pad = sum(2048 - u for u in (sum(r["length"] for r in p) for p in by_seq.values()) if u & (u - 1))
    assert pad < 4096


def test_packing_odd_rows(spark):
    docs = odd_docs(spark, extra=True)
    rows = binslack.packed(docs, with_ids=True, **queries.tokenizer_files()).collect()
    repeated = {6}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] not in repeated}
    check_packing(rows, texts)
    assert Counter(r["start"] for r in rows if r["doc_id"] == 6)[0] == 3
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert binslack.packed(no_docs(spark), **queries.tokenizer_files()).count() == 0


def base_figures(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def longest_from(words, least):
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best if best >= least else 0)
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5, 8])
def test_repeated_passages_match_brute_force(least):
    rnd = np.random.default_rng(least)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, k, n)) for k, n in ((2, 60), (5, 90), (40, 120), (3, 7), (1, 20), (500, 50), (1, 1))] + ["", None]
    texts += [texts[2] + " " + texts[2]]
    got = suffixrules.measured(texts, least)
    for i, t in enumerate(texts):
        words = (t or "").split()
        longest = longest_from(words, least)
        covered = {j for a, k in enumerate(longest) for j in range(a, a + k)}
        assert got["longest_repeat"][i] == max(longest, default=0)
        assert got["repeated_words"][i] == len(covered)
        assert got["n_repeat_words"][i] == base_figures(t)[4]


def test_base_figures(spark, sf):
    docs = odd_docs(spark, extra=True).unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True)
    got = suffixrules.judged(docs).collect()
    want = Counter((r["doc_id"], *base_figures(r["text"])) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert suffixrules.judged(no_docs(spark)).count() == 0


def test_clean_documents_are_kept_and_repeats_go(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = labels.where("quality = 1 and toxic = 0").select("doc_id")
    judged = suffixrules.judged(docs.join(good, "doc_id", "left_semi")).where("not base_failed")
    assert judged.where("kept").count() >= 0.95 * judged.count()


def slow_simhash(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows, radius=3):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [low[root(i)] for i in range(len(rows))]


def test_simhash_classes_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    near = [(10_000 + i, " ".join(["kept words stay the same for a long while here and there", *(f"w{j}" for j in range(200)), f"end{i % 17}"])) for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema)).unionByName(odd_docs(spark).select("doc_id", "text").where("doc_id is null or doc_id < 15").selectExpr("doc_id + 20000 as doc_id", "text"))
    rows = [(r["doc_id"], slow_simhash(r["text"])) for r in docs.collect()]
    want = Counter((d, f"{fp:016x}", c) for (d, fp), c in zip(rows, slow_classes(rows), strict=True))
    from pyspark.sql import functions as F

    got = ballhash.classes(docs.withColumn("fp", F.lit(1)).withColumn("low", F.lit(2)))
    assert Counter((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got.collect()) == want


def test_ball_hashing_links_random_bits(spark):
    rnd = np.random.default_rng(3)
    fps = []
    for seed in rnd.integers(0, 1 << 63, 30, dtype=np.uint64).tolist():
        fps += [seed, *(seed ^ sum(1 << int(b) for b in rnd.choice(64, d, replace=False)) for d in (1, 2, 3, 4, 3, 5))]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = {r["id"]: r["component"] for r in ballhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = slow_classes([(f, f & (1 << 64) - 1) for f in fps])
    assert {f: got.get(f, f) for f in fps} == dict(zip(fps, want, strict=True))


def test_simhash_stage_keeps_one_of_each(spark):
    docs = odd_docs(spark, extra=True)
    kept = ballhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    classes = {(r["doc_id"], r["component_id"]) for r in ballhash.classes(docs).collect()}
    assert ids == sorted(d for d, c in classes if d is not None and d == c)
    assert kept.where("doc_id is null").count() == 2
    assert ballhash.one_of_each(no_docs(spark)).count() == 0


def test_simhash_stage_tells_texts_of_one_id_apart(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(1, "a"), (5, "a"), (5, "b"), (7, "c"), (7, "d"), (7, "d"), (2**60 + 1, "d"), (None, "a"), (None, "a")]
    docs = spark.createDataFrame([(i, texts[t], "en", "s", 1) for i, t in rows], DOCS)
    got = Counter((r["doc_id"], r["text"][0]) for r in ballhash.one_of_each(docs).collect())
    assert got == Counter({(1, "a"): 1, (5, "b"): 1, (7, "c"): 1, (7, "d"): 1, (None, "a"): 2})
