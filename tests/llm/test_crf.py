import itertools

import numpy as np
import pytest

from polyglint.llm import crf


@pytest.mark.parametrize("equal", [False, True])
def test_marginals_equal_enumeration_and_plain_recursion(equal):
    rng = np.random.default_rng(0)
    t = crf.Transitions(*np.exp(np.zeros(4) if equal else rng.normal(size=4)))
    table = np.array([[t.t00, t.t01], [t.t10, t.t11]])
    lengths = [0, 1, 3, 9, 0, 300, 64, 65]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=first[-1]) * 2
    got = crf.marginals(scores, first, t)
    for d, n in enumerate(lengths):
        own = np.exp(scores[first[d] : first[d + 1]])
        if 0 < n < 10:
            total, ones = 0, np.zeros(n)
            for y in itertools.product((0, 1), repeat=n):
                weight = np.prod(own ** np.array(y)) * np.prod([table[a, b] for a, b in itertools.pairwise(y)])
                total, ones = total + weight, ones + weight * np.array(y)
            expected = ones / total
        else:
            forward, backward = np.ones((n, 2)), np.ones((n, 2))
            for i in range(n):
                forward[i] = (forward[i - 1] @ table if i else 1) * np.array([1, own[i]])
                forward[i] /= forward[i].sum()
            for i in range(n - 2, -1, -1):
                backward[i] = table @ (backward[i + 1] * [1, own[i + 1]])
                backward[i] /= backward[i].sum()
            both = forward * backward
            expected = both[:, 1] / both.sum(axis=1) if n else []
        np.testing.assert_allclose(got[first[d] : first[d + 1]], expected, atol=1e-12)


def test_fit_recovers_a_chain():
    rng = np.random.default_rng(1)
    first = np.arange(0, 4001, 20)
    labels = np.repeat(rng.integers(0, 2, 400), 10)
    x = labels + rng.normal(size=len(labels))
    weights, t = crf.fit(lambda w: w[0] * x + w[1], lambda r: np.array([r @ x, r.sum()]), 2, labels, first)
    right = (crf.marginals(weights[0] * x + weights[1], first, t) > 0.5) == labels
    alone = (x > 0.5) == labels
    assert right.mean() > alone.mean() + 0.1
