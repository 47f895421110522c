"""Quality classifier by compression: a text that the good dictionary shortens more than the bad one is likelier good.

Two zstandard dictionaries are built from blocks of good and of bad labelled text. Each text is compressed block by
block with both; the difference of the two sizes over their sum is the feature, and a logistic curve, fitted on
labelled texts that built neither dictionary, turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold_of, in_arrow, in_batches
from graphloom.llm.wordhash import as_bytes

FEATURES = ("against_bad", "against_plain", "log_bytes", "log_ratio")


@dataclass(frozen=True)
class Settings:
    """Bounds and sizes. Labelled rows beyond the bounds add nothing to a dictionary of fixed size or a curve of few terms."""

    dictionary_bytes: int = 112_640
    block_bytes: int = 1024
    level: int = 3
    dictionary_texts: int = 3000  # of each label at most
    dictionary_blocks: int = 12_000  # of each label at most, from anywhere in those texts
    curve_texts: int = 6000  # of each label at most


@dataclass(frozen=True)
class Model:
    """good, bad: the dictionaries' bytes. weights: of the curve's terms. mean, scale: of its features."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    settings: Settings


def _blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def dictionary(blocks: list[bytes], settings: Settings) -> bytes:
    """A dictionary trained on blocks; from too little text, the text itself serves as raw content."""
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, blocks, level=settings.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-settings.dictionary_bytes :]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=level)
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def measured(texts: list[bytes], good: bytes, bad: bytes, settings: Settings) -> np.ndarray:
    """Of whole texts: the normalised size difference bad against good, the same for plain against good (-1 to 1; 0 where
    there is no text), log length, and log of plain size over length, which tells texts that repeat themselves."""
    press_good, press_bad, plain = (_compressor(c, settings.level) for c in (good, bad, b""))
    out = np.zeros((len(texts), len(FEATURES)))
    for i, t in enumerate(texts):
        blocks = _blocks(t, settings.block_bytes)
        a = sum(len(press_good.compress(b)) for b in blocks)
        b = sum(len(press_bad.compress(x)) for x in blocks)
        c = sum(len(plain.compress(x)) for x in blocks)
        out[i] = ((b - a) / (a + b), (c - a) / (c + a), np.log1p(len(t)), np.log((c + 20) / (len(t) + 20))) if blocks else 0
    return out


def _terms(x: np.ndarray) -> np.ndarray:
    """The curve's terms."""
    return np.column_stack([np.ones(len(x)), x, x[:, 0] * np.abs(x[:, 0]), x[:, 0] * x[:, 2], x[:, 3] ** 2, x[:, 3] * x[:, 2], x[:, 3] * x[:, 0]])


def fitted_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton's method: weights, and the features' mean and scale.

    The ridge spares the constant: from few labels, scores stay near the share of good ones.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    t = _terms((x - mean) / scale)
    w = np.zeros(t.shape[1])
    held = np.full(len(w), ridge)
    held[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(t @ w, -30, 30)))
        gradient = t.T @ (weight * (y - p)) - held * w
        hessian = (t * (weight * p * (1 - p))[:, None]).T @ t + np.diag(held)
        move = np.linalg.solve(hessian, gradient)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 4, held_out: int = 2) -> Model:
    """Learns from labelled documents outside the held-out fold.

    Of each label a bounded number of rows is used, those with the smallest hash of their id; documents with several
    or null labels count by the mean of their labels, and are left out when that is a half. Texts are cut into blocks and
    measured on the executors; dictionary_blocks blocks of each label, those with the smallest hash, and the figures of
    curve_texts texts of each label reach the driver, however many rows share an id. Repeated rows count once. Without
    usable labels the score of every text is a half.
    """
    marked = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.avg(F.col("quality").cast("double")).alias("mean"))
        .where("mean <> 0.5")
        .where(fold_of(F.col("doc_id"), folds) != held_out)
        .select("doc_id", (F.col("mean") > 0.5).alias("good"), F.xxhash64(F.lit(17), "doc_id").alias("h"))
    )
    # odd hashes build dictionaries, even ones fit the curve
    counts = {(r["good"], r["odd"]): r["n"] for r in marked.groupBy("good", (F.pmod("h", F.lit(2)) == 1).alias("odd")).agg(F.count("*").alias("n")).collect()}
    chosen = None
    for good in (True, False):
        for odd, most in ((True, settings.dictionary_texts), (False, settings.curve_texts)):
            part = marked.where((F.col("good") == good) & ((F.pmod("h", F.lit(2)) == 1) == odd)).orderBy("h", "doc_id").limit(most)
            part = part.select("doc_id", "good", F.lit(odd).alias("odd"))
            chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * (dictionary_texts + curve_texts) small rows
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").distinct()

    def cut(batches):
        for pdf in batches:
            for g, t in zip(pdf["good"], as_bytes(pdf["text"])):
                blocks = _blocks(t, settings.block_bytes)
                yield pd.DataFrame({"good": [bool(g)] * len(blocks), "h": [xxhash.xxh64_intdigest(b) >> 1 for b in blocks], "block": blocks})

    cuts = in_batches(texts.where("odd"), cut, "good boolean, h long, block binary").distinct()
    good, bad = (dictionary([bytes(r["block"]) for r in cuts.where(F.col("good") == g).orderBy("h", "block").limit(settings.dictionary_blocks).collect()], settings) for g in (True, False))

    def run(batches):
        for pdf in batches:
            x = measured(as_bytes(pdf["text"]), good, bad, settings)
            yield pd.DataFrame({**{n: x[:, k] for k, n in enumerate(FEATURES)}, "good": pdf["good"], "doc_id": pdf["doc_id"]})

    seen = in_batches(texts.where("not odd"), run, ", ".join(f"{n} double" for n in FEATURES) + ", good boolean, doc_id long")
    order = [F.xxhash64(F.lit(17), "doc_id"), "doc_id", *FEATURES]
    parts = [seen.where(F.col("good") == g).orderBy(*order).limit(settings.curve_texts).toPandas() for g in (True, False)]
    seen = pd.concat(parts).sort_values(["doc_id", *FEATURES])
    y = seen["good"].to_numpy(dtype=float)
    # the bounded samples are weighted back to the labels' own shares
    weight = np.ones(len(y))
    for g in (True, False):
        here = int((y == g).sum())
        if here:
            weight[y == g] = counts.get((g, False), 0) / here
    weights, mean, scale = fitted_curve(seen[list(FEATURES)].to_numpy(), y, weight / max(weight.mean(), 1e-9) if len(y) else weight)
    return Model(good, bad, weights, mean, scale, settings)


def scored(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; a null text is empty and gets the score of no evidence."""

    def run(batches):
        for batch in batches:
            x = (measured(as_bytes(batch.column(1).to_pylist()), model.good, model.bad, model.settings) - model.mean) / model.scale
            p = 1 / (1 + np.exp(-np.clip(_terms(x) @ model.weights, -30, 30)))
            yield {"doc_id": batch.column(0), "held_out": batch.column(2), "score": p, "predicted": (p >= least).astype(np.int32)}

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold_of(F.col("doc_id"), folds) == held_out).alias("__out"))
    return in_arrow(given, run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at least `least`, each as often as it occurs.

    A null text counts as empty; nulls in other columns pass as they are. An empty table gives an empty one.
    """
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            x = (measured(as_bytes(batch.column(at).to_pylist()), model.good, model.bad, model.settings) - model.mean) / model.scale
            p = 1 / (1 + np.exp(-np.clip(_terms(x) @ model.weights, -30, 30)))
            yield batch.filter(pa.array(p >= least))

    return docs.mapInArrow(run, docs.schema)
