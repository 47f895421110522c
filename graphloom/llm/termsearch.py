"""Ranked lexical search, term at a time, with a limit on accumulators that loses nothing.

One pass over the documents writes, for each, its length and how often it holds each term of the queries. Their sums are
the corpus statistics. The searching pass takes that table in portions. In a portion a query's terms are handled rarest
first. A term opens an accumulator for each document that has none yet, as long as the terms not yet handled could lift
a new document to the query's k-th best partial score. After that no accumulator is opened, but those that exist take
all remaining terms, so their scores are exact. A task keeps k documents a query from portion to portion, and its k-th
score is a bar for later portions. The best of all tasks are merged in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import in_arrow, written

#: Letters and digits of ASCII and everything beyond it make terms; A-Z is lower-cased, all else parts terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass(frozen=True)
class Settings:
    """k rows a query. block_terms: distinct terms of the queries that are searched together, about. portion: postings in
    memory at a time. None of them changes the result."""

    k: int = 50
    block_terms: int = 100_000
    portion: int = 2_000_000
    merge: int = 32


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths_against_mean(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms; beyond 64 bits the product is taken in whole numbers of any size."""
    if len(n) and int(n.max()) * 50 * n_docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)
    return 50 + 50 * n.astype(np.int64) * n_docs // max(n_terms, 1)


def best_of_portion(items: list[np.ndarray], doc: np.ndarray, starts: np.ndarray, gain: np.ndarray, ids: np.ndarray, bars: list[int], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, documents, scores) of a portion: at least all documents that are among the k best of everything seen so far.

    Postings lie by term: those of term t are doc[starts[t]:starts[t + 1]], ascending, each worth gain. items holds each
    item's terms, rarest first. bars holds each item's k-th best score of earlier portions, 0 if there are fewer.
    """
    size = len(ids)
    most = np.array([gain[a:b].max() if b > a else 0 for a, b in zip(starts[:-1], starts[1:], strict=True)], dtype=np.int64)
    score = np.zeros(size, dtype=np.int64)
    for item, terms in enumerate(items):
        terms = [t for t in terms if starts[t + 1] > starts[t]]
        if not terms:
            continue
        left = np.cumsum([most[t] for t in terms][::-1])[::-1]
        if left[0] < bars[item]:
            continue
        open_, opening = np.zeros(0, dtype=np.int64), True
        for j, t in enumerate(terms):
            at, add = doc[starts[t] : starts[t + 1]], gain[starts[t] : starts[t + 1]]
            if opening:
                # a new document has at most left[j]; ties at the bar are settled by id, so it must be exceeded
                bar = bars[item]
                if len(open_) >= k:
                    held = score[open_]
                    bar = max(bar, int(np.partition(held, len(held) - k)[len(held) - k]))
                opening = left[j] >= bar
                if not opening:
                    open_ = np.sort(open_)
            if opening:
                fresh = at[score[at] == 0]
                score[at] += add
                open_ = np.concatenate([open_, fresh])
            elif len(open_) * 8 < len(at):
                place = np.minimum(np.searchsorted(at, open_), len(at) - 1)
                hit = at[place] == open_
                score[open_[hit]] += add[place[hit]]
            else:
                hit = score[at] > 0
                score[at[hit]] += add[hit]
        found = open_[score[open_] >= max(bars[item], 1)]
        yield item, found, score[found]
        score[open_] = 0


def _best(ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by ascending id with null ids last."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(scores))
    order = np.lexsort((ids[near], nulls[near], -scores[near]))
    return near[order[:k]]


def _search(batches: Iterator[pa.RecordBatch], items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, settings: Settings) -> Iterator[dict]:
    """The k best documents of each item among the rows (doc_id, n, terms, counts) of a task."""
    k = settings.k
    none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    kept, bars = [none] * len(items), [0] * len(items)

    def portions():
        held, size = [], 0
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                held.append(part)
                size += len(part.column(2).flatten())
                if size >= settings.portion:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    for held in portions():
        table = pa.Table.from_batches(held).combine_chunks()
        ids_, n, terms, counts = (table.column(i).chunk(0) if table.num_rows else None for i in range(4))
        ids, nulls = np.asarray(ids_.fill_null(0)), np.asarray(ids_.is_null())
        m = lengths_against_mean(np.asarray(n), n_docs, n_terms)
        sizes = np.diff(np.asarray(terms.offsets))
        doc = np.repeat(np.arange(len(ids)), sizes)
        term, tf = np.asarray(terms.flatten()), np.asarray(counts.flatten()).astype(np.int64)
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        worth = gain > 0  # a term that every document holds may be worth nothing
        doc, term, gain = doc[worth], term[worth], gain[worth]
        starts = np.searchsorted(term, np.arange(len(weights) + 1))
        for item, found, scores in best_of_portion(items, doc, starts, gain, ids, bars, k):
            a, b, c = (np.concatenate(x) for x in zip(kept[item], (ids[found], nulls[found], scores), strict=True))
            top = _best(a, b, c, k)
            kept[item] = (a[top], b[top], c[top])
            bars[item] = int(c[top[-1]]) if len(top) == k else 0
    for item, (ids, nulls, scores) in enumerate(kept):
        if len(ids):
            yield {"item": np.full(len(ids), item), "doc_id": pa.array(ids, pa.int64(), mask=nulls), "score": scores}


def indexed(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: its length in terms, and the numbers and counts of the
    terms in `number` that it holds; written."""

    def run(batches):
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            ids, n, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = terms_of(text) if text is not None else ()
                if not words:
                    continue
                found = Counter(words)
                own = sorted((number[w], found[w]) for w in found.keys() & number.keys())
                ids.append(i)
                n.append(len(words))
                terms.append([t for t, _ in own])
                counts.append([c for _, c in own])
            yield {"doc_id": batch.column(0).take(pa.array(ids, pa.int32())), "n": n, "terms": terms, "counts": counts}

    return written(in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, terms array<int>, counts array<int>"))


def _asked(queries: DataFrame) -> DataFrame:
    """(item_id, term) of queries(item_id, text), each once."""

    def run(batches):
        for batch in batches:
            ids, terms = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = sorted(set(terms_of(text))) if text is not None else []
                ids += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(terms, pa.binary())], names=["item_id", "term"])

    kind = dict(queries.dtypes)["item_id"]
    return queries.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary").distinct()


def searched(queries: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of docs(doc_id, text) for each item of queries(item_id, text).

    Score: over the item's distinct terms, w * ((1000000000 * tf) div (1000 * tf + 20 * m)) is summed, where w is
    floor(1000 * ln((2N + 2) / (2df + 1))) and m is 50 + (50 * n * N) div L. Only scores above 0 are ranked, ties by
    ascending doc_id, a null doc_id last.

    A null or empty text has no terms; such documents count nowhere, such items get no rows. Rows of one item_id are one
    item with the terms of all of them. Repeated documents are ranked row by row. Texts may be of any length, and other
    columns are ignored. Without queries or documents the result is empty. Queries are searched in blocks of a bounded
    expected number of terms, dealt by a hash of item_id, so any number of them can be asked.
    """
    spark = queries.sparkSession
    asked = written(_asked(queries))
    total = asked.count()
    blocks = -(-total // settings.block_terms) if total else 0
    kind = dict(queries.dtypes)["item_id"]
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about block_terms rows
        names = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x))
        number = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        index = indexed(docs, number)
        n_docs, n_terms = (x or 0 for x in index.agg(F.count("*"), F.sum("n")).first())
        df = np.zeros(len(number), dtype=np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
            df[r["t"]] = r["count"]
        weights = np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64)
        place = {x: i for i, x in enumerate(names)}
        own = [[] for _ in names]
        for r in rows:
            own[place[r["item_id"]]].append(number[bytes(r["term"])])
        items = [np.array(sorted(t, key=lambda x: (df[x], x)), dtype=np.int64) for t in own]
        found = in_arrow(index, lambda b, i=items, w=weights, n=n_docs, t=n_terms: _search(b, i, w, n, t, settings), "item int, doc_id long, score long")
        # ties by id, so that a document stands for itself wherever it is cut
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(settings.merge)))
        some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("rank") <= settings.k)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= settings.k)
        named = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item int, item_id {kind}")
        part = best.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_TERMS.format('text')} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT i, doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM s),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT i, term, count(*)::BIGINT AS tf FROM (SELECT i, unnest(terms) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY i, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, docs),
scored AS (SELECT item_id, i, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN s USING (i), c GROUP BY item_id, i),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored JOIN s USING (i) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
