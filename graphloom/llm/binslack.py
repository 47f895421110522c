"""Packing token pieces into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one remainder. The number of remainders of each length is all that
planning needs: at most `capacity` counts, whatever the corpus size. For the longest length left, a bitset subset-sum
over the other lengths finds the multiset that fills the window closest to capacity, its counts are read back from the
stored bitsets, and the pattern is used as often as the counts allow. Pieces then take their places by their rank
among the pieces of their length, which needs no shuffle of texts or ids.
"""

from __future__ import annotations

import base64
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import in_arrow, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long"
#: Distinct space-led chunks whose ids a worker keeps at a time.
CHUNKS_KEPT = 1 << 19
#: Texts whose chunks are looked up together.
TEXTS_AT_A_TIME = 256
_ODD_SPACE = re.compile(r"\A | \Z|\s | \s")


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit numbers, the same as the tokenizer's for each whole text.

    A byte-level pre-tokenizer always starts a new token at a space between two visible characters, so the chunks
    there can be encoded apart, and frequent ones are remembered. Chunks that are not known yet are encoded as one
    text, which is cut again before every token that starts with a space. Texts with other spacing, or with a special
    token in them, are encoded whole. ranks names the same vocabulary as a file of ranks, whose reader is faster.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._whole = tokenizer.encode_batch_fast
        self._special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._leads = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            self._leads[i] = token.startswith("\u0120")  # a byte-level vocabulary writes the space so
        self._ids = self._whole_ids
        if ranks:
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            same = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self._ids = lambda text: same.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        self._known: dict[str, bytes] = {}

    def _whole_ids(self, text: str) -> np.ndarray:
        return np.array(self._whole([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _parts(self, text: str) -> list[str] | None:
        return None if _ODD_SPACE.search(text) or any(s in text for s in self._special) else text.split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self._known
        split = [self._parts(t) for t in texts]
        unknown = list({p for parts in split if parts for p in parts[1:]} - known.keys())
        if unknown:
            ids = self._ids(" " + " ".join(unknown))
            cuts = np.flatnonzero(self._leads[ids])
            raw, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
            known.update((p, raw[a:b]) for p, a, b in zip(unknown, (4 * cuts).tolist(), ends, strict=True))
        out = [self._whole_ids(t).tobytes() if parts is None else self._ids(parts[0]).tobytes() + b"".join(map(known.__getitem__, parts[1:])) for t, parts in zip(texts, split, strict=True)]
        if len(known) > CHUNKS_KEPT:
            for p in unknown:
                del known[p]
        return out


_encoders: dict[tuple, ChunkEncoder] = {}


def _encoder(tokenizer: str, ranks: str | None) -> ChunkEncoder:
    """The worker's own encoder, kept from task to task."""
    if (tokenizer, ranks) not in _encoders:
        _encoders[tokenizer, ranks] = ChunkEncoder(tokenizer, ranks)
    return _encoders[tokenizer, ranks]


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False, ranks: str | None = None) -> DataFrame:
    """Pieces of all documents: full windows and a remainder each; the last id of a document is end_id.

    part is the task that made a piece, rank its place among that task's pieces of the same length. with_ids adds the
    ids themselves. A null text is empty and gives one piece of one id. Repeated rows are separate documents.
    """

    def run(batches):
        encode, end = _encoder(tokenizer, ranks), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, owner = [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            encoded = (ids for i in range(0, len(texts), TEXTS_AT_A_TIME) for ids in encode(texts[i : i + TEXTS_AT_A_TIME]))
            for at, ids in enumerate(encoded):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    rows.append((start, length, zlib.crc32(piece), n, part, int(seen[length])) + ((np.frombuffer(piece, "<u4").astype(np.int32),) if with_ids else ()))
                    owner.append(at)
                    seen[length] += 1
            names = [c.split()[0] for c in PIECES.split(", ")][1:] + ["ids"] * with_ids
            yield {"doc_id": batch.column(0).take(pa.array(owner, pa.int64())), **dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))}

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES + ", ids array<int>" * with_ids)


def fill(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, how often in a window), ...] and how many windows use each, until no piece is left.

    A total that is a power of two needs no padding, so where the window can't be filled, such a total comes before a
    larger one.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left, reverse=True)
    plan = []
    while order:
        seed = order[0]
        left[seed] -= 1
        room = capacity - seed
        sums, steps = 1, []
        limit = (1 << (room + 1)) - 1
        for n in order:
            if n > room or not left[n]:
                continue
            most, step = min(left[n], room // n), 1
            while most:  # binary splitting of the count
                take = min(step, most)
                steps.append((n, take, sums))
                sums = (sums | sums << n * take) & limit
                most -= take
                step *= 2
            if sums >> room & 1:
                break
        best = sums.bit_length() - 1
        if best < room:
            even = [p - seed for k in range(capacity.bit_length()) if seed <= (p := 1 << k) <= capacity and sums >> (p - seed) & 1]
            best = max(even, default=best)
        pattern = {seed: 1}
        for n, take, before in reversed(steps):
            if not before >> best & 1:
                pattern[n] = pattern.get(n, 0) + take
                best -= n * take
        left[seed] += 1
        uses = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * uses
        plan.append((sorted(pattern.items(), reverse=True), uses))
        order = [n for n in order if left[n]]
    return plan


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces as cut() makes them; pieces must be a written table.

    The histogram (at most `capacity` rows) is the only thing that reaches the driver. Lies gapless from offset 0 in
    every sequence. An empty table gives an empty table.
    """
    shares = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shares.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments: dict[int, list] = {n: [] for n in counts}
    used, sequence = dict.fromkeys(counts, 0), 0
    for pattern, uses in fill(counts, capacity):
        offset = 0
        for n, k in pattern:
            segments[n].append((used[n], k, sequence, offset))
            used[n] += k * uses
            offset += k * n
        sequence += uses
    table = {n: np.array(rows, np.int64).T for n, rows in segments.items()}

    def place(batches):
        for batch in batches:
            length, rank, base = (batch.column(n).to_numpy() for n in ("length", "rank", "base"))
            out = np.zeros((2, len(length)), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                n = int(length[rows[0]])
                begin, each, seq, offset = table[n]
                own = rank[rows] + base[rows]
                at = np.searchsorted(begin, own, side="right") - 1
                past = own - begin[at]
                out[0, rows] = seq[at] + past // each[at]
                out[1, rows] = offset[at] + past % each[at] * n
            yield {n: batch.column(n) for n in names} | {"sequence_id": out[0], "offset": out[1]}

    joined = pieces.join(bases, ["length", "part"]).select(*pieces.columns, "base")
    kept = [f"{n} {kind}" for n, kind in pieces.dtypes if n not in ("part", "rank")]
    names = [k.split()[0] for k in kept]
    return in_arrow(joined, place, ", ".join([*kept, "sequence_id long", "offset long"]).replace("bigint", "long"))


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False, ranks: str | None = None) -> DataFrame:
    """Every id of every document in exactly one piece, and every piece's place in a sequence of at most `capacity`."""
    return pack(written(cut(docs, tokenizer, capacity, end_id, with_ids, ranks)), capacity)
