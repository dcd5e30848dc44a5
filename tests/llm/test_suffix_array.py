import random

import numpy as np

from schedlake.llm.suffix_array import common_prefixes, suffix_array


def naive(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_equals_sorting_and_comparing():
    rng = random.Random(7)
    for _ in range(400):
        text = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(60))]
        if rng.random() < 0.3:
            text = text[:5] * rng.randrange(9)
        order = suffix_array(np.array(text, np.int64))
        assert order.tolist() == naive(text)
        if text:
            lcp = common_prefixes(np.array(text, np.int64), order, np.array([0]), 1000)
            want = {i: 0 if n == 0 else shared(text[i:], text[order[n - 1] :]) for n, i in enumerate(order.tolist())}
            assert lcp.tolist() == [want[i] for i in range(len(text))]


def test_long_repeats():
    text = np.frombuffer(b"abcab" * 4000 + b"x" * 5000 + b"abcab" * 4000, np.uint8)
    order = suffix_array(text)
    raw = text.tobytes()
    picked = range(0, len(text) - 1, 997)
    assert all(raw[order[i] :] < raw[order[i + 1] :] for i in picked)
