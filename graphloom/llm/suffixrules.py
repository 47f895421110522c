"""Quality rules on repetition: suffix arrays over words find maximal repeated passages of a text.

Word numbers of a portion of texts are ranked by prefix doubling. Only suffixes that still share their rank go on to
the next doubling, so ordinary prose is settled after three or four. Neighbours in the suffix array give, through the
stored ranks, the longest common prefix: the longest passage from each word that occurs elsewhere in its text. The
union of those of at least `least` words is the repeated part.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import in_arrow
from graphloom.llm.wordhash import as_bytes, portions, words_of

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"
_INKED = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "repeated_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, where each run of equal keys starts in it, and the runs' lengths."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return order, heads, np.diff(np.append(heads, len(key)))


def repeats(numbers: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: is it in a 3-word window found twice or more in its text; the longest repeated passage from it.

    owner is the index of a word's text, ascending. Passages of fewer than `least` words count as 0.
    """
    n = len(numbers)
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    end = np.searchsorted(owner, owner, side="right")  # one past the last word of the text
    place = np.arange(n)

    # level 0: equal words of a text
    with np.errstate(over="ignore"):
        seeded = numbers + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order, heads, sizes = _classes(seeded)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)
    levels, active, step = [rank], order[np.repeat(sizes, sizes) > 1], 1
    in_window = np.zeros(n, bool)
    while len(active):
        if step == 2:  # rank of two words at hand: three-word windows
            ahead = active[active + 2 < end[active]]
            if len(ahead):
                pair = rank[ahead] * np.int64(n) + levels[0][ahead + 2]
                o, _, s = _classes(pair)
                hit = ahead[o[np.repeat(s, s) > 1]]
                for k in range(3):
                    in_window[hit + k] = True
        ahead = active + step
        inside = ahead < end[active]
        key = rank[active] * np.int64(n + 1) + np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order, heads, sizes = _classes(key)
        at = active[order]
        ordered = rank[at]
        block = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))  # members of one old class lie together
        begin = np.repeat(block, np.diff(np.append(block, len(at))))
        new = rank.copy()
        new[at] = ordered + np.repeat(heads, sizes) - begin
        levels.append(new)
        rank = new
        active = at[np.repeat(sizes, sizes) > 1]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = place
    # neighbours in the suffix array that share at least the widest level not above `least`
    wide = min(max(least.bit_length() - 1, 0), len(levels) - 1)
    close = np.flatnonzero(levels[wide][suffixes[1:]] == levels[wide][suffixes[:-1]])
    a, b = suffixes[close], suffixes[close + 1]
    common = np.zeros(len(close), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < end[a]) & (y < end[b])
        same = ok & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        # a rank shared at a level tells that 2**k words agree, or both texts ended, which one text can't do twice
        common += np.where(same, 1 << k, 0)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    longest[longest < least] = 0
    return in_window, longest


def _covered(longest: np.ndarray) -> np.ndarray:
    """Words inside the union of the passages that start at each word."""
    reach = np.maximum.accumulate(np.arange(len(longest)) + longest)
    return reach > np.arange(len(longest))


def measured(texts: list, least: int) -> dict[str, np.ndarray]:
    """All figures of the texts, in order."""
    raw = as_bytes(texts)
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeated_words", "longest_repeat")}
    for i, t in enumerate(texts):
        if isinstance(t, str) and t:
            out["word_chars"][i] = len(t) - sum(map(t.count, _SPACES))
            out["n_symbols"][i] = sum(map(t.count, SYMBOLS))
            lines = [x for x in t.split("\n") if _INKED.search(x)]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    for begin, stop in portions(raw):
        numbers, owner, *_ = words_of(raw[begin:stop])
        in_window, longest = repeats(numbers, owner, least)
        size = stop - begin
        out["n_words"][begin:stop] = np.bincount(owner, minlength=size)
        out["n_repeat_words"][begin:stop] = np.bincount(owner[in_window], minlength=size)
        out["repeated_words"][begin:stop] = np.bincount(owner[_covered(longest)], minlength=size)
        np.maximum.at(out["longest_repeat"][begin:stop], owner, longest)
    return out


def judged(docs: DataFrame, least: int = 8, most_covered: float = 0.25, most_longest: int = 60, fewest_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """Figures and verdict of every document's whole text.

    A text fails the base rules with under fewest_words words, or with over most_repeat_percent % of its words in
    3-word windows that occur twice or more. Else it is kept if passages of `least` or more words that occur again in
    it cover at most most_covered of its words, and none is longer than most_longest words. A null or empty text has
    no words and fails. Repeated rows are judged one by one; an empty table gives an empty table.
    """

    def run(batches):
        for batch in batches:
            m = measured(batch.column(1).to_pylist(), least)
            n = m["n_words"]
            failed = (n < fewest_words) | (100 * m["n_repeat_words"] > most_repeat_percent * n)
            kept = ~failed & (m["repeated_words"] <= most_covered * n) & (m["longest_repeat"] <= most_longest)
            yield {"doc_id": batch.column(0), **m, "base_failed": failed, "kept": kept}

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
