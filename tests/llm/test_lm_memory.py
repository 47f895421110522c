"""The language model's arrays are bounded by portions, and its steps hold only lanes that are not over."""

import tracemalloc

import numpy as np

from graphloom.llm import gatedlm


def test_words_are_numbered_in_small_parts():
    rng = np.random.default_rng(1)
    texts = [b" ".join(b"w%d" % i for i in rng.integers(0, 5000, 700)) for _ in range(1200)]
    whole = [gatedlm._tokens([t]) for t in texts]
    tracemalloc.start()
    numbers, kinds, owner = gatedlm.tokens_of(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for got, k in ((numbers, 0), (kinds, 1)):
        assert np.array_equal(got, np.concatenate([w[k] for w in whole]))
    assert np.array_equal(owner, np.repeat(np.arange(len(texts)), [len(w[0]) for w in whole]))
    # before: running sums over all bytes at once, 30 times the text and more
    assert peak < 14 * sum(map(len, texts))
    assert [len(x) for x in gatedlm.tokens_of([])] == [0, 0, 0]


def test_steps_hold_each_word_once():
    rng = np.random.default_rng(2)
    size = np.array([1, 900, 3, 40, 1, 77, 2])
    target, owner = rng.integers(0, 50, size.sum()), np.repeat(np.arange(len(size)), size)
    wanted, who, begin = gatedlm._steps(target, owner, len(size), 3)
    live = np.diff(begin)
    # before: a grid of the longest lane's steps times all lanes
    assert begin[-1] == len(target) and live[0] == 3 and (np.diff(live) <= 0).all() and live[-1] == 1
    for d in range(len(size)):
        assert wanted[who == d].tolist() == target[owner == d].tolist()
