"""Language-model scoring of whole documents with a gated recurrent network in numpy.

Words of the training part are counted over the whole corpus. The most frequent ones are the network's own words, in
classes of equal size; any other word belongs to one of 64 tail classes by its letters. The network's output is
factored: first a softmax over all classes, then, in a class of own words, a softmax over its words; in a tail class
a word has its smoothed share of the class's count in the corpus, so every word, seen or not, has a probability.

Documents run through the network in lanes, side by side; the state is carried across windows to a document's end.
Training truncates backpropagation to a window. Every training document belongs, by hashes, to one round and one shard
of about shard_tokens words; shards train apart, each over its documents in order of id, and their weights are averaged
after each round, so the model doesn't depend on how many tasks there are.

Counts of the words that are frequent (a bounded table) go with the tasks; those of all others are joined.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold_of, in_arrow, in_batches, written
from graphloom.llm.wordhash import as_bytes, portions, words_of

TAIL = 64
#: Bytes of text that are cut into words at a time, and bytes that run through the network together.
PART, GROUP = 1 << 18, 1 << 23
#: Rows of outputs at a time: arrays of so many stay in the cache, and take a third of the time of large ones.
ROWS = 1024
#: The number that stands for a document's end among the words' numbers.
END = 1


@dataclass(frozen=True)
class Settings:
    own_classes: int = 32
    class_words: int = 32
    hidden: int = 16
    lanes: int = 512
    window: int = 64
    train_lanes: int = 256  # at most; fewer where a lane would hold under lane_tokens
    lane_tokens: int = 1024
    train_window: int = 32
    rounds: int = 3
    rate: float = 0.08
    shard_tokens: int = 1_000_000  # of a round
    frequent: int = 1 << 18  # words whose counts go with the tasks
    seed: int = 3

    @property
    def own(self) -> int:
        return self.own_classes * self.class_words


@dataclass
class Corpus:
    """numbers, counts: of the frequent words, ascending by number. own: place of own words by number; tokens, kinds:
    N and V; tail_tokens, tail_kinds: of each tail class."""

    numbers: np.ndarray
    counts: np.ndarray
    own_numbers: np.ndarray
    own_ids: np.ndarray
    own_counts: np.ndarray
    tokens: int
    kinds: int
    tail_tokens: np.ndarray
    tail_kinds: np.ndarray


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, tail classes and owners of the lower-cased words of all texts, each text followed by its end."""
    parts = [(a, _tokens(texts[a:b])) for a, b in portions(texts, PART)] or [(0, _tokens(texts))]
    return np.concatenate([p[0] for _, p in parts]), np.concatenate([p[1] for _, p in parts]), np.concatenate([p[2] + a for a, p in parts])


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers, owner, starts, ends, joined = words_of([t.lower() for t in texts])
    last = joined[ends - 1]
    kind = (last & 31).astype(np.int16)
    if len(starts):
        high = np.maximum.reduceat(np.where(joined >= 0x80, np.where(joined < 0xC0, joined, 0x80), 0), starts)
        kind = np.where(high > 0, 32 + (high >> 1 & 31), kind).astype(np.int16)
    size = np.bincount(owner, minlength=len(texts))
    at = np.cumsum(size)  # an end is put behind each text's words
    numbers = np.insert(numbers.view(np.int64), at, END)
    return numbers, np.insert(kind, at, 0), np.insert(owner, at, np.arange(len(texts)))


def counted(docs: DataFrame) -> DataFrame:
    """(h, kind, n) of every word of docs(text), written."""

    def run(batches):
        for pdf in batches:
            raw = as_bytes(pdf["text"])
            spans = list(portions(raw))
            for i in range(0, len(spans), 4):
                parts = [tokens_of(raw[a:b])[:2] for a, b in spans[i : i + 4]]
                h, first, n = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
                yield pd.DataFrame({"h": h, "kind": np.concatenate([p[1] for p in parts])[first].astype(np.int32), "n": n})

    return written(in_batches(docs.select("text"), run, "h long, kind int, n long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")))


def gathered(words: DataFrame, s: Settings) -> Corpus:
    """What tasks need of the counts; of bounded size: `frequent` words, the own words, 64 classes."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own = words.where(F.col("h") != END).orderBy(F.col("n").desc(), "h").limit(s.own - 1).toPandas()
    end = words.where(F.col("h") == END).first()
    own_numbers = np.concatenate([[END], own["h"].to_numpy(np.int64)])
    own_counts = np.concatenate([[end["n"] if end else 0], own["n"].to_numpy(np.int64)])
    order = np.argsort(own_numbers)
    # the lowest count at which no more than `frequent` words remain: from how many words have each count
    sizes = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).limit(s.frequent + 1).toPandas()
    fits = sizes["n"].to_numpy()[np.cumsum(sizes["words"].to_numpy()) <= s.frequent]
    often = pd.DataFrame({"h": own_numbers, "n": own_counts}).iloc[0 if end else 1 :]  # own words are always at hand
    if len(fits):
        often = pd.concat([often, words.where(F.col("n") >= int(fits.min())).select("h", "n").toPandas()]).drop_duplicates("h")
    often = often.sort_values("h")
    tail_tokens, tail_kinds = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in words.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        tail_tokens[r["kind"]], tail_kinds[r["kind"]] = r["n"], r["k"]
    if end:
        tail_tokens[0] -= end["n"]
        tail_kinds[0] -= 1
    for kind, n in zip(own["kind"], own["n"], strict=True):
        tail_tokens[kind] -= n
        tail_kinds[kind] -= 1
    return Corpus(often["h"].to_numpy(np.int64), often["n"].to_numpy(np.int64), own_numbers[order], order, own_counts, int(total[0]), int(total[1]), tail_tokens, tail_kinds)


def symbols(numbers: np.ndarray, kinds: np.ndarray, c: Corpus, s: Settings) -> np.ndarray:
    """Own words as 0 to own - 1 (0 is the end), others as own + tail class."""
    at = np.minimum(np.searchsorted(c.own_numbers, numbers), len(c.own_numbers) - 1)
    return np.where(c.own_numbers[at] == numbers, c.own_ids[at], s.own + kinds).astype(np.int32)


def fresh(c: Corpus, s: Settings) -> dict[str, np.ndarray]:
    """Starting weights: outputs at the corpus's own shares, the rest small and random."""
    rng = np.random.default_rng(s.seed)
    h, classes = s.hidden, s.own_classes + TAIL
    counts = np.full(s.own, 0.0)
    counts[: len(c.own_counts)] = c.own_counts + 0.5
    word_bias = np.log(np.maximum(counts, 1e-9)).reshape(s.own_classes, s.class_words)
    mass = np.concatenate([counts.reshape(s.own_classes, -1).sum(axis=1), np.maximum(c.tail_tokens + 1.0, 1.0)])
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    w = {"x": small(s.own + TAIL, 3 * h), "u": small(h, 3 * h) * 3, "c": small(classes, h) * 0.3, "cb": np.log(mass / mass.sum() + 1e-9), "w": small(s.own_classes, s.class_words, h) * 0.3, "wb": word_bias}
    w["x"][:, :h] += 1.0  # gates begin by keeping most of the state
    w["wb"] -= np.log(np.exp(w["wb"]).sum(axis=1, keepdims=True))
    w["wb"] = np.maximum(w["wb"], -30)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _stepped(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple:
    """One step of all lanes, which are columns: their inputs, the transposed weights of the state, and their states."""
    n = len(h)
    a = u @ h
    gates = _sigmoid(x[: 2 * n] + a[: 2 * n])
    z, r = gates[:n], gates[n:]
    new = r * a[2 * n :]
    new += x[2 * n :]
    np.tanh(new, out=new)
    out = h - new
    out *= z
    out += new
    return out, h, z, r, new, a[2 * n :]


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _by_class(classes: np.ndarray, own_classes: int) -> tuple[np.ndarray, list]:
    """Rows of own words by class, and each class with its part of them."""
    order = np.argsort(classes, kind="stable")
    bounds = np.searchsorted(classes[order], np.arange(own_classes + 1))
    return order[: bounds[-1]], [(k, slice(a, b)) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]


def _word_scores(w: dict, states: np.ndarray, parts: list) -> np.ndarray:
    """Scores of the words of a state's own class; states come by class."""
    out = np.empty((len(states), w["wb"].shape[1]), np.result_type(states, w["w"]))
    for k, at in parts:
        np.matmul(states[at], w["w"][k].T, out=out[at])
        out[at] += w["wb"][k]
    return out


def _classes(target: np.ndarray, s: Settings) -> np.ndarray:
    return np.where(target < s.own, target // s.class_words, target - s.own + s.own_classes)


def log_probability(w: dict, states: np.ndarray, target: np.ndarray, s: Settings) -> np.ndarray:
    """Natural log of the class's probability and, for own words, of the word's in it."""
    cls = _classes(target, s)
    out, c = np.empty(len(target), np.result_type(states, w["c"])), np.ascontiguousarray(w["c"].T)
    for a in range(0, len(target), ROWS):
        at = cls[a : a + ROWS]
        logits = states[a : a + ROWS] @ c
        logits += w["cb"]
        logits -= logits.max(axis=1, keepdims=True)
        want = logits[np.arange(len(at)), at]
        np.exp(logits, out=logits)
        out[a : a + ROWS] = want - np.log(logits.sum(axis=1))
    own, parts = _by_class(cls, s.own_classes)
    scores, word = _word_scores(w, states[own], parts), target[own] % s.class_words
    for a in range(0, len(own), ROWS):
        x = scores[a : a + ROWS]
        x -= x.max(axis=1, keepdims=True)
        want = x[np.arange(len(x)), word[a : a + ROWS]]
        out[own[a : a + ROWS]] += want - np.log(np.exp(x, out=x).sum(axis=1))
    return out


def laid_out(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents by lane, longest first to the emptiest lane; lanes by falling length."""
    heap = [(0, k) for k in range(min(lanes, max(len(sizes), 1)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable").tolist():
        held, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (held + int(sizes[d]), k))
    return sorted(out, key=lambda x: -sum(int(sizes[d]) for d in x))


def _steps(target: np.ndarray, owner: np.ndarray, docs: int, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets and owners by step, in it by lane, and where each step begins: a step has the lanes that are not over."""
    size = np.bincount(owner, minlength=docs)
    first = np.cumsum(size) - size
    plan = laid_out(size, lanes)
    length = np.array([size[d].sum() for d in plan], np.int64)
    live = np.searchsorted(-length, -np.arange(length[0]))  # lanes come by falling length
    begin = np.concatenate([[0], np.cumsum(live)])
    wanted, who = np.empty(len(target), np.int32), np.empty(len(target), np.int32)
    for k, ds in enumerate(plan):
        at = np.concatenate([np.arange(first[d], first[d] + size[d]) for d in ds])
        to = begin[: len(at)] + k
        wanted[to], who[to] = target[at], owner[at]
    return wanted, who, begin


def scores(w: dict, target: np.ndarray, owner: np.ndarray, docs: int, s: Settings) -> np.ndarray:
    """Natural log-probability of each document under the network (classes, and own words)."""
    out = np.zeros(docs)
    if not len(target):
        return out
    wanted, who, begin = _steps(target, owner, docs, s.lanes)
    lanes = int(begin[1])
    h, before = np.zeros((s.hidden, lanes), np.float32), np.zeros(lanes, np.int32)
    x, u = np.ascontiguousarray(w["x"].T), np.ascontiguousarray(w["u"].T)
    for first in range(0, len(begin) - 1, s.window):
        last = min(first + s.window, len(begin) - 1)
        states = np.empty((begin[last] - begin[first], s.hidden), np.float32)
        for t in range(first, last):
            live = begin[t + 1] - begin[t]
            read = before[:live]
            h = _stepped(x[:, read], u, h[:, :live] * (read != 0))[0]  # a lane that has read an end begins a document from a zero state
            states[begin[t] - begin[first] : begin[t + 1] - begin[first]] = h.T
            before = wanted[begin[t] : begin[t + 1]]
        here = slice(begin[first], begin[last])
        out += np.bincount(who[here], weights=log_probability(w, states, wanted[here], s), minlength=docs)
    return out


def stretches(target: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets as (steps, lanes), a lane after the other, and the lanes' lengths; all but the last ones are full."""
    steps = -(-len(target) // lanes)
    length = np.minimum(steps, len(target) - steps * np.arange(-(-len(target) // steps)))
    grid = np.zeros(steps * len(length), np.int32)
    grid[: len(target)] = target
    return grid.reshape(len(length), steps).T, length


def trained(w: dict, target: np.ndarray, s: Settings) -> dict:
    """Weights after one pass over the documents, by Adagrad on windows of truncated backpropagation.

    Documents of any length stand one after another, and lanes are equal stretches of them: the state goes through a whole
    document and is zero at the next one's start. Only a document over which a lane ends goes on in the next from zero.
    """
    w = {k: v.copy() for k, v in w.items()}
    if not len(target):
        return w
    grid, length = stretches(target, min(s.train_lanes, max(8, len(target) // s.lane_tokens)))
    n, lanes = s.hidden, grid.shape[1]
    seen = {k: np.full_like(v, 1e-3) for k, v in w.items()}
    h, before = np.zeros((n, lanes), np.float32), np.zeros(lanes, np.int32)
    for begin in range(0, len(grid), s.train_window):
        steps, lanes = min(s.train_window, len(grid) - begin), int((length > begin).sum())
        h, before = h[:, :lanes], before[:lanes]
        real = begin + np.arange(steps)[:, None] < length[None, :lanes]
        read = np.concatenate([before[None], grid[begin : begin + steps - 1, :lanes]])
        goes_on = (read != 0).astype(np.float32)  # a lane that has read an end begins a document from a zero state
        x, u = w["x"].T[:, read], np.ascontiguousarray(w["u"].T)
        tape = []
        for t in range(steps):
            tape.append(_stepped(x[:, t], u, h * goes_on[t]))
            h = tape[-1][0]
        before = grid[begin + steps - 1, :lanes]
        states = np.stack([m[0] for m in tape]).transpose(0, 2, 1).reshape(-1, n)
        rows = np.flatnonzero(real.reshape(-1))
        want = grid[begin : begin + steps, :lanes].reshape(-1)[rows]
        used, cls = states[rows], _classes(want, s)
        g = {x: np.zeros_like(w[x]) for x in ("c", "cb", "w", "wb")}
        d_used, c = np.empty_like(used), np.ascontiguousarray(w["c"].T)
        for a in range(0, len(rows), ROWS):
            part, at = used[a : a + ROWS], cls[a : a + ROWS]
            d_class = part @ c
            d_class += w["cb"]
            d_class = _softmax(d_class)
            d_class[np.arange(len(at)), at] -= 1
            g["c"] += d_class.T @ part
            g["cb"] += d_class.sum(axis=0)
            d_used[a : a + ROWS] = d_class @ w["c"]
        own, parts = _by_class(cls, s.own_classes)
        part = used[own]
        d_word, back = _word_scores(w, part, parts), np.empty_like(part)
        for a in range(0, len(own), ROWS):
            _softmax(d_word[a : a + ROWS])
        d_word[np.arange(len(own)), want[own] % s.class_words] -= 1
        for k, at in parts:
            g["w"][k], g["wb"][k] = d_word[at].T @ part[at], d_word[at].sum(axis=0)
            np.matmul(d_word[at], w["w"][k], out=back[at])
        d_used[own] += back
        d_states = np.zeros((steps * lanes, n), np.float32)
        d_states[rows] = d_used
        d_states = np.ascontiguousarray(d_states.reshape(steps, lanes, n).transpose(0, 2, 1))
        g["u"], d_x = np.zeros_like(w["u"]), np.empty((3 * n, steps, lanes), np.float32)
        d_h, d_a = np.zeros((n, lanes), np.float32), np.empty((3 * n, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            _, prev, z, r, new, a = tape[t]
            d, away = d_states[t] + d_h, 1 - z
            d_new = d * away * (1 - new * new)
            d_a[:n] = d * (prev - new) * z * away
            d_a[n : 2 * n] = d_new * a * r * (1 - r)
            d_x[: 2 * n, t], d_x[2 * n :, t] = d_a[: 2 * n], d_new
            d_a[2 * n :] = d_new * r
            g["u"] += prev @ d_a.T
            d_h = (d * z + w["u"] @ d_a) * goes_on[t]
        read = read.reshape(-1)
        g["x"] = np.stack([np.bincount(read, weights=d.reshape(-1), minlength=len(w["x"])) for d in d_x], axis=1).astype(np.float32)
        for k, v in g.items():
            v = np.clip(v, -50, 50)
            seen[k] += v * v
            w[k] -= (s.rate * v / np.sqrt(seen[k])).astype(np.float32)
    return w


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def dealt(docs: DataFrame, tokens: int, s: Settings) -> DataFrame:
    """round, shard, id (as text: beside nulls pandas holds whole numbers as doubles), h (text hash) and text of all docs."""
    shards = max(1, round(tokens / s.rounds / s.shard_tokens))
    draw = F.pmod(F.xxhash64(F.lit(s.seed), F.coalesce("doc_id", F.lit(-1))), F.lit(s.rounds)).cast("int").alias("round")
    shard = F.pmod(F.xxhash64(F.lit(s.seed + 1), "doc_id", "text"), F.lit(shards)).alias("shard")
    return docs.select(draw, shard, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("h"), "text")


def _shard_trainer(now):
    def run(pdf):
        w, corpus, s = now.value
        raw = as_bytes(pdf.sort_values(["id", "h"])["text"])
        done = 0
        for a, b in portions(raw):
            numbers, kinds, _ = tokens_of(raw[a:b])
            w = trained(w, symbols(numbers, kinds, corpus, s), s)
            done += len(numbers)
        return pd.DataFrame({"weights": [_flat(w).astype(np.float64)], "n": [done]})

    return run


def network(docs: DataFrame, c: Corpus, s: Settings) -> dict:
    """Trained weights. docs(doc_id, text) are the training part; hashes of id and text deal all of them out."""
    spark, w, kind = docs.sparkSession, fresh(c, s), "weights array<double>, n long"
    for k in range(s.rounds):
        now = spark.sparkContext.broadcast((w, c, s))
        shards = dealt(docs, c.tokens, s).where(F.col("round") == k).groupBy("shard")
        # sums are made in the tasks first, so a task passes on one set of weights
        got = shards.applyInPandas(_shard_trainer(now), kind).select("n", F.posexplode("weights").alias("i", "v"))
        mean = got.groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).toPandas()
        if len(mean):
            w = _shaped(mean.sort_values("i")["v"].to_numpy(), w)
    return w


def scored(docs: DataFrame, folds: int = 7, held_out: int = 2, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Learns from the rows whose fold is not held_out. Words are lower-cased (A-Z) runs without ASCII white space; each
    document ends with one end token, so a null or empty text has one token. base_score is the add-one unigram log10
    probability; score is the network's. Repeated rows are scored one by one; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    out = (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", out)
    train = given.where("not held_out").select("doc_id", "text")
    words = counted(train)
    c = gathered(words, s)
    w = network(train, c, s)
    model = spark.sparkContext.broadcast((w, c))
    ten = np.log(10)

    def run(batches):
        w, c = model.value
        share = np.log10(c.tail_tokens + c.tail_kinds + 1)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw = pc.fill_null(batch.column(1).cast(pa.binary()), b"").to_pylist()
            for begin, end in portions(raw, GROUP):  # lanes are fuller the more texts run together
                docs_here, parts = end - begin, []
                n, known, base, plain = (np.zeros(docs_here, t) for t in (np.int64, np.int64, float, float))
                for a, b in portions(raw[begin:end], PART):
                    numbers, kinds, owner = tokens_of(raw[begin + a : begin + b])
                    total = lambda v=None, at=slice(None), o=owner, d=b - a: np.bincount(o[at], weights=v, minlength=d)
                    target = symbols(numbers, kinds, c, s)
                    at = np.minimum(np.searchsorted(c.numbers, numbers), max(len(c.numbers) - 1, 0))
                    often = c.numbers[at] == numbers if len(c.numbers) else np.zeros(len(numbers), bool)
                    log_count = np.zeros(len(numbers))
                    log_count[often] = np.log10(c.counts[at[often]] + 1.0)
                    tail = target >= s.own
                    n[a:b], known[a:b], base[a:b] = total(), total(None, often), total(log_count)
                    plain[a:b] = total((log_count - share[np.maximum(target - s.own, 0)])[tail], tail)
                    parts.append((target, (owner + a).astype(np.int32), *np.split(numbers[~often], np.cumsum(total(None, ~often))[:-1])))
                target, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                yield {
                    "row": row + np.arange(docs_here),
                    "doc_id": batch.column(0).slice(begin, docs_here),
                    "held_out": batch.column(2).slice(begin, docs_here),
                    "n_tokens": n,
                    "known": known,
                    "base": base - n * np.log10(c.tokens + c.kinds + 1),
                    "lm": scores(w, target, owner, docs_here, s) / ten + plain,
                    "rest": [x for p in parts for x in p[2:]],
                }
                row += docs_here

    kind = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, lm double, rest array<long>"
    rows = written(in_arrow(given, run, kind))
    # counts of the words that are not frequent; a word that training never saw adds log10(0 + 1) = 0
    less = words.select("h", "n")
    more = rows.select("row", F.explode("rest").alias("h")).join(less, "h").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("seen"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return rows.drop("rest").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("seen")).alias("n_known"),
        F.lit(c.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more")).alias("base_score"),
        (F.col("lm") + zero("more")).alias("score"),
    )
