"""Keyword, vector and hybrid ranking for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import extract_keywords
from graphloom.operators import vectorindex
from graphloom.operators.graph import degrees
from graphloom.tables import written

#: Weights by profile: name equal, name holds, path holds, signature or comment holds; bonus for each neighbour, at most 3; rows kept.
PROFILES = {"search": (10, 5, 2, 1, 0.1, 15), "context": (3, 3, 1, 0, 0.2, 30), "plan": (10, 5, 3, 0, 0.0, 5)}
PLAN_KINDS = ("file", "function", "class", "interface")


#: Words meet texts under so many of their first letters at most.
KEY_LETTERS = 32


def holding(words: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (kw, text) of words(kw) and texts(text) where text holds kw.

    A text's parts of the lengths that words have are looked up among the words, so the work grows with the texts' letters
    and with what is found, however alike words and texts are. Longer words than KEY_LETTERS meet under their first
    letters and are then compared whole.
    """
    words = written(words.where("kw is not null").distinct().withColumn("start", F.substring("kw", 1, KEY_LETTERS)))
    lengths = sorted(r[0] for r in words.select(F.length("start")).distinct().collect())  # at most KEY_LETTERS + 1 rows
    texts = texts.where("text is not null").distinct()
    ends = F.length("text")
    of = lambda n: F.transform(F.sequence(F.lit(1), ends - n + 1), lambda i: F.substr("text", i, F.lit(n)))
    parts = [F.when(ends >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in lengths if n]
    none = [F.array(F.lit(""))] if 0 in lengths else []
    if not parts and not none:
        return words.select("kw", F.col("kw").alias("text")).limit(0)
    parts = texts.select("text", F.explode(F.array_distinct(F.concat(*none, *parts))).alias("start"))
    return parts.join(words, "start").where(F.col("text").contains(F.col("kw"))).select("kw", "text")


def keyword_rank(queries: DataFrame, nodes: DataFrame, edges: DataFrame, profile: str = "search") -> DataFrame:
    """(query_id, id, score, rank) for queries(query_id, text).

    Points are summed once for each word and node. Queries of the same words, as often, are ranked once. Nodes that the
    same words hit with the same points gain alike from every query, so of those only the first meet the queries.
    """
    equal, holds, path, more, bonus, top = PROFILES[profile]
    q = queries.select("query_id", F.explode(extract_keywords(F.col("text"), profile)).alias("kw")).groupBy("query_id", "kw").agg(F.count("*").alias("times"))
    asked = written(q.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("kw", "times"))).alias("bag")))
    bags = written(asked.groupBy("bag").agg(F.min("query_id").alias("bag_id")))
    q = bags.select("bag_id", F.inline("bag"))
    n = nodes.where(F.col("kind").isin(*PLAN_KINDS)) if profile == "plan" else nodes
    points = {"name": F.when(F.col("text") == F.col("kw"), equal).otherwise(holds), "file_path": F.lit(path)}
    points |= {c: F.lit(more) for c in ("signature", "doc_comment") if c in nodes.columns and more}
    seen = None
    for c, value in points.items():
        part = n.select("id", F.lower(c).alias("text"), F.lit(c).alias("place"))
        seen = part if seen is None else seen.unionByName(part)
    q = written(q)
    worth = F.lit(0)
    for c, value in points.items():
        worth = F.when(F.col("place") == c, value).otherwise(worth)
    met = seen.join(holding(q.select("kw"), seen.select("text")), "text").groupBy("kw", "id").agg(F.sum(worth).alias("points")).where("points > 0")
    hit = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kw", "points"))).alias("hit"))
    hit = written(hit.join(degrees(nodes, edges).select("id", "degree"), "id").join(nodes.select("id", "file_path"), "id"))

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        scored = rows.withColumn("score", F.round(F.col("hits") + F.least(F.col("degree") * bonus, F.lit(3.0)), 6))
        at = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
        scored = scored.withColumn("rank", F.row_number().over(at))
        if profile != "context":
            return scored.where(F.col("rank") <= top)
        # the first `top` files, too, by their best node; of a file no more than `top` nodes can be wanted
        inner = F.row_number().over(Window.partitionBy(*keys, "file_path").orderBy(F.desc("score"), "id"))
        scored = scored.drop("rank").withColumn("in_file", inner).where(F.col("in_file") <= top)
        scored = scored.withColumn("rank", F.row_number().over(at)).withColumn("opens", F.col("in_file") == 1)
        scored = scored.withColumn("place", F.sum(F.col("opens").cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
        return scored.where((F.col("rank") <= top) | (F.col("opens") & (F.col("place") <= top)))

    few = written(best(hit.withColumn("hits", F.lit(0)), "hit").select("id", "degree", "file_path", "hit"))
    few = few.select("id", "degree", "file_path", F.inline("hit")).join(q, "kw")
    few = few.groupBy("bag_id", "id").agg(F.sum(F.col("points") * F.col("times")).alias("hits"), F.min("degree").alias("degree"), F.min("file_path").alias("file_path"))
    ranked = written(best(few, "bag_id").select("bag_id", "id", "score", "rank"))
    named = asked.join(bags, "bag").select("query_id", "bag_id")
    return named.join(ranked, "bag_id").select("query_id", "id", "score", "rank")


def hub_files(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, id, dependents): nodes whose name or path holds a task word of over three letters, by dependents."""
    w = written(tasks.select("query_id", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) > 3)).alias("kw")).distinct())
    seen = nodes.select("id", F.lower("name").alias("text")).unionByName(nodes.select("id", F.lower("file_path").alias("text")))
    dependents = degrees(nodes, edges).select("id", F.col("in_degree").alias("dependents"))
    met = seen.join(holding(w.select("kw"), seen.select("text")), "text").select("kw", "id").distinct().join(dependents, "id")

    def first(rows: DataFrame, key: str) -> DataFrame:
        at = Window.partitionBy(key).orderBy(F.desc("dependents"), "id")
        return rows.withColumn("rn", F.row_number().over(at)).where(F.col("rn") <= k).drop("rn")

    # a query's first nodes are among the first of its words
    found = first(met, "kw").join(w, "kw").select("query_id", "id", "dependents").distinct()
    return first(found, "query_id").select("query_id", "id", "dependents")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sketch(v: Column, dims: int = 16) -> Column:
    """Means of `dims` equal blocks."""
    size = F.greatest(F.floor(F.size(v) / dims), F.lit(1)).cast("int")
    mean = lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.greatest(F.size(b), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: mean(F.slice(v, i * size + 1, size)))


def non_zero_vectors(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.exists("embedding", lambda x: x != 0))


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar chunks by cosine, above 0, of queries(query_id, vector).

    Exact at every size, through the index of vectorindex, which can be built once for many searches.
    """
    return vectorindex.nearest(queries, vectorindex.build(chunks), k)


def sketch_search(queries: DataFrame, chunks: DataFrame, k: int = 5, over: int = 10, dims: int = 16) -> DataFrame:
    """(query_id, id, similarity, rank) as vector_search, of the k * over chunks with the highest product of sketches.

    Approximate: it reads only ids and sketches of all chunks, and whole vectors of the candidates. Queries meet chunks in
    batches of BATCH and BLOCK, every batch with every block, as products of matrices.
    """
    v = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    c = vectorindex.usable(chunks, "id", "embedding")
    slim = c.select("id", sketch(F.col("v"), dims).alias("v"))
    q = vectorindex.usable(queries, "query_id", "vector")
    near = vectorindex.largest_products(q.select("query_id", sketch(F.col("v"), dims).alias("v")), slim, k * over, dims)
    pairs = near.select("query_id", "id").join(chunks.select("id", v("embedding").alias("e")), "id").join(queries.select("query_id", v("vector").alias("t")), "query_id")
    e, t = F.col("e"), F.col("t")
    cosine = dot(e, t) / F.nullif(F.sqrt(dot(e, e)) * F.sqrt(dot(t, t)), F.lit(0.0))
    return vectorindex.best(pairs.select("query_id", "id", F.round(cosine, 9).alias("similarity")).where("similarity > 0"), k)


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, similarity, rank): the first k chunks by id that hold one of the first five terms of over two letters.

    Terms hold no white space, so a chunk holds a term where one of its own words does: terms meet the distinct words of
    all chunks. Of each word, each term and each query only the first k chunks are carried on.
    """
    words = F.split(F.lower("content"), r"\s+")
    terms = F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) > 2), 1, 5)
    t = written(queries.select("query_id", F.explode(terms).alias("kw")).distinct())

    def first(rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where(F.col("rank") <= k)

    # the texts come out of a join whose tasks hold as much as they are given; their words are ranked in tasks of a bounded
    # size, since a rebalanced partition is split where it is large
    chunks = chunks.select("id", "content").hint("rebalance")
    filed = written(first(chunks.select("id", F.explode(F.array_distinct(words)).alias("text")).where(F.length("text") > 2), "text").select("text", "id"))
    met = holding(t.select("kw"), filed.select("text")).join(filed, "text").select("kw", "id").distinct()
    hit = first(met, "kw").select("kw", "id").join(t, "kw").select("query_id", "id").distinct()
    return first(hit, "query_id").select("query_id", "id", F.lit(0.5).alias("similarity"), "rank")


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank): reciprocal ranks, 1 / (60 + rank), over 2k vector and 2k keyword hits."""
    both = vector_search(queries, chunks, 2 * k).unionByName(keyword_search(queries, chunks, 2 * k))
    s = both.groupBy("query_id", "id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def within_token_budget(ranked: DataFrame, budget: int = 2000) -> DataFrame:
    """ranked(query_id, id, rank, content): from the top until the first chunk whose ceil(length / 4) tokens do not fit."""
    at = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("tokens", F.sum(F.ceil(F.length("content") / 4)).over(at)).where(F.col("tokens") <= budget).select("query_id", "id", "rank", "tokens")


def uncached_chunks(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(cache.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"]).select("content_hash")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"))


def retrieval_context(queries: DataFrame, chunks: DataFrame, k: int = 5, budget: int = 2000) -> DataFrame:
    """(query_id, ids, tokens): the best chunks of each query that fit the budget, in order of rank."""
    r = vector_search(queries, chunks, k).join(chunks.select("id", "content"), "id")
    f = within_token_budget(r, budget)
    return f.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"), F.max("tokens").alias("tokens"))
