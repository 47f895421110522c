"""Audit of how text filters overlap: what each removes in every order, alone, needlessly, and by Shapley value.

Every document has a mask of the filters that it fails. Of each part of the corpus the documents that each of the 32
sets of filters (coalitions) removes are tabulated once. Whatever an order of filters does at a step is a difference of
two coalitions. Shapley values are the solution of a least-squares problem over the coalitions: an additive model is
fitted to their removals, weighted by the Shapley kernel, under the constraint that it spreads the whole removal
(efficiency). The normal equations are solved in rational numbers, so the values are exact.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of matrix * X = right, by Gauss-Jordan elimination in rationals."""
    n = len(matrix)
    rows = [list(a) + list(b) for a, b in zip(matrix, right, strict=True)]
    for i in range(n):
        pivot = next(k for k in range(i, n) if rows[k][i] != 0)
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i] != 0:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [r[n:] for r in rows]


def shapley_map(players: int) -> list[list[Fraction]]:
    """For each player the weights of all 2**players coalition values that give its Shapley value.

    Minimises the sum over proper coalitions S of kernel(|S|) * (v(S) - v(empty) - sum of phi in S)**2, where
    kernel(s) = (n - 1) / (C(n, s) * s * (n - s)), under sum of phi = v(all) - v(empty). The Lagrange conditions are a
    linear system whose right-hand side is linear in v, so one elimination gives the solution for every v.
    """
    n, full = players, (1 << players) - 1
    kernel = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    proper = [s for s in range(1, full)]
    matrix = [[sum((kernel[s.bit_count()] for s in proper if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[Fraction(0)] * (full + 1) for _ in range(n + 1)]
    for i in range(n):
        for s in proper:
            if s >> i & 1:
                right[i][s] += kernel[s.bit_count()]
                right[i][0] -= kernel[s.bit_count()]
    right[n][full], right[n][0] = Fraction(1), Fraction(-1)
    return _solved(matrix, right)[:n]


def failures(text: Column) -> Column:
    """Bits 0 to 3: text (not null) fails A, fewer than 200 words; B, 100 * distinct words < 50 * words; C, over 3 in 100
    code points are A-Z; D, it holds one of #$%&*|. A text without words fails A alone."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, size = F.size(words).cast("long"), F.length(text).cast("long")
    capitals = size - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = (n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n, 100 * capitals > 3 * size, text.rlike(r"[#$%&*|]"))
    mask = F.lit(0)
    for i, failed in enumerate(tests):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part, failed filters and labels, at most 128 rows a part.

    A document fails E (bit 4) where a smaller doc_id has an identical text, in whatever part. Texts are told apart by
    their SHA-256. All rows of one text fail the same of A to D, so the rows of a text are counted before they are
    shuffled, and only those of its smallest doc_id pass E: a text that fills a third of the table is a few counted rows.
    """
    text = F.coalesce("text", F.lit(""))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    slim = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), failures(text).alias("mask"))
    rows = slim.groupBy("doc_id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    # rows without an id find no label; their second key deals them out
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("sha")).otherwise(0))
    rows = rows.join(marked.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").select("doc_id", "part", "sha", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    named = F.col("doc_id").isNotNull()
    texts = rows.groupBy("sha", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("nameless")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("sha"))
    own = F.coalesce(F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")), F.lit(0)) + F.col("nameless")
    texts = texts.withColumn("least", least).select("mask", "part", "good", "toxic", "n", own.alias("own"))
    parts = F.explode(F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n"))))
    return texts.select("part", "good", "toxic", parts.alias("x")).groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def coalitions(counted: DataFrame) -> DataFrame:
    """(part, total, removed, good, toxic) of masks(): the last three are arrays by set of filters, of the documents that
    fail at least one of it (all, with quality 1, with toxic 1)."""
    hit = lambda s: (F.col("mask").bitwiseAND(F.lit(s))) != 0
    table = lambda n: F.array(*(F.coalesce(F.sum(F.when(hit(s), n)), F.lit(0)).cast("long") for s in range(1 << len(FILTERS))))
    n = F.col("n")
    return counted.groupBy("part").agg(F.sum("n").alias("total"), table(n).alias("removed"), table(n * F.col("good")).alias("good"), table(n * F.col("toxic")).alias("toxic"))


def steps(found: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from coalitions().

    shapley is the filter's Shapley value times the number of orders, a whole number: its removals summed over all orders.
    """
    n, full = len(FILTERS), (1 << len(FILTERS)) - 1
    orders = []
    for order in permutations(range(n)):
        before = 0
        for k, f in enumerate(order):
            orders.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "f": f, "one": 1 << f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    at = lambda c, i: F.element_at(c, i + 1)
    whole = [[w * factorial(n) for w in row] for row in shapley_map(n)]
    assert all(w.denominator == 1 for row in whole for w in row)
    values = F.array(*(sum((at(F.col("removed"), s) * int(w) for s, w in enumerate(row) if w), F.lit(0)) for row in whole))
    found = found.withColumn("values", values)
    r, one = F.col("removed"), F.col("one")
    rows = F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order string, step int, f int, one int, before int, after int>>")
    gone = lambda c: at(F.col(c), F.col("after")) - at(F.col(c), F.col("before"))
    return found.select("*", F.inline(rows)).select(
        "part", "filter_order", "step",
        (F.col("total") - at(r, F.col("after"))).alias("kept"),
        gone("removed").alias("removed"),
        (at(r, one) - gone("removed")).alias("redundant"),
        (at(r, F.lit(full)) - at(r, F.lit(full) - one)).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        at(F.col("values"), F.col("f")).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the COUNTS of docs(doc_id, text, lang) and labels(doc_id, quality, toxic).

    A part is a lang value; null and empty ones share the part named by the empty string. A null text is empty. Rows count
    one by one: repeated rows share their doc_id, so none makes another fail E; a row with a null doc_id has no smaller
    one and is no smaller one, and passes E. A document has quality (or toxic) 1 if any of its label rows says so. Texts
    may be of any length; other columns are ignored. An empty table gives an empty table.
    """
    return steps(coalitions(masks(docs, labels)))


ORACLE = r"""
WITH f AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM f LEFT JOIN marked USING (doc_id)),
counted AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
places AS (SELECT o, k, o[k] AS f, left(o, k - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
hit AS (SELECT c.*, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM counted c),
rows_ AS (SELECT part, o, k, f, n, good, toxic, failed, contains(failed, f) AS fails,
  before <> '' AND failed <> '' AND regexp_matches(failed, '[' || before || '-]') AS gone FROM hit, places),
s AS (SELECT part, o, k, f,
  sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM rows_ GROUP BY ALL)
SELECT part, o AS filter_order, k::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM s
"""
