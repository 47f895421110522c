"""Words of many texts as 64-bit numbers, without a Python object for each word.

The bytes of a batch lie in one array. A word's number is a polynomial in its bytes modulo 2**64 over a table of
random values, read off running sums, then mixed. Two different words share a number with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts in order: number, index of the text, start and end in the joined bytes; and those bytes."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(joined) + 1)
    total = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[joined] * power[: len(joined)], out=total[1:])
    numbers = mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return numbers, np.searchsorted(first, starts, side="right") - 1, starts, ends, joined


def portions(texts: list[bytes], size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` bytes each; a longer text has a range of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
