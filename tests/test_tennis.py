from functools import lru_cache
from math import erf, sqrt

import numpy as np
import pytest

from pitchside.functions import kernels as K


def plain(pa, pb, best_of):
    """The match by recursion over every score; the score at deuce in closed form."""

    @lru_cache(None)
    def game(p, x, y):
        if max(x, y) >= 4 and abs(x - y) >= 2:
            return float(x > y)
        if x == y and x >= 3:
            return p * p / (p * p + (1 - p) ** 2)
        return p * game(p, x + 1, y) + (1 - p) * game(p, x, y + 1)

    @lru_cache(None)
    def tiebreak(a, b, first):
        if max(a, b) >= 7 and abs(a - b) >= 2:
            return float(a > b)
        m = (pa + 1 - pb) / 2
        if a == b and a >= 6:
            return m * m / (m * m + (1 - m) ** 2)
        n = a + b
        own = first if n == 0 else ((n - 1) // 2 % 2 == 0) == first
        p = (pa if own else 1 - pb) if min(a, b) < 6 else m
        return p * tiebreak(a + 1, b, first) + (1 - p) * tiebreak(a, b + 1, first)

    @lru_cache(None)
    def won_set(i, j, serves, x=0, y=0):
        if max(i, j) >= 6 and abs(i - j) >= 2:
            return float(i > j)
        if i == j == 6:
            return tiebreak(x, y, serves)
        p = game(pa, x, y) if serves else 1 - game(pb, y, x)
        return p * won_set(i + 1, j, not serves) + (1 - p) * won_set(i, j + 1, not serves)

    def match(a, b, i, j, x, y, serves):
        target = (best_of + 1) // 2
        first = serves if (i + j) % 2 == 0 else not serves

        def rest(a, b):
            if max(a, b) >= target:
                return float(a >= target)
            s = won_set(0, 0, first)
            return s * rest(a + 1, b) + (1 - s) * rest(a, b + 1)

        if max(a, b) >= target:
            return float(a >= target)
        now = won_set(i, j, serves, x, y)
        return now * rest(a + 1, b) + (1 - now) * rest(a, b + 1)

    return match


@pytest.mark.parametrize("best_of", [3, 5])
def test_match_from_any_score(best_of):
    pa, pb = np.array([0.65, 0.58, 0.71]), np.array([0.62, 0.66, 0.55])
    games = [(0, 0), (3, 2), (5, 5), (6, 5), (5, 6), (6, 6), (5, 0), (6, 4), (7, 5), (2, 6)]
    points = [(0, 0), (1, 3), (3, 3), (4, 3), (3, 4), (7, 7), (9, 8), (0, 3), (5, 6), (6, 6)]
    for sets_won in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2)):
        for g in games:
            for x in points:
                for serves in (True, False):
                    got = K.match_from(pa, pb, best_of, sets_won, g, x, serves)
                    want = [plain(a, b, best_of)(*sets_won, *g, *x, serves) for a, b in zip(pa.tolist(), pb.tolist(), strict=True)]
                    np.testing.assert_allclose(got, want, atol=1e-12, err_msg=str((sets_won, g, x, serves)))


def test_the_start_is_what_it_was():
    pa, pb = np.array([0.65, 0.6]), np.array([0.62, 0.6])
    np.testing.assert_allclose(K.set_from(pa, pb, (0, 0)), K.sets(pa, pb)[0], atol=1e-12)
    for n in (3, 5):
        np.testing.assert_allclose(K.match_from(pa, pb, n, (0, 0)), K.match(K.sets(pa, pb)[0], n), atol=1e-12)


def test_total_games():
    pa, pb, line = np.array([0.65, 0.6]), np.array([0.62, 0.6]), np.array([22.5, 30.5])
    s, games = K.sets(pa, pb)
    for n in (3, 5):
        for i in range(2):
            mean, target = 0.0, (n + 1) // 2
            walks = [(1.0, 0, 0)]
            while walks:
                p, a, b = walks.pop()
                if max(a, b) == target:
                    mean += p * (a + b) * games[i]
                else:
                    walks += [(p * s[i], a + 1, b), (p * (1 - s[i]), a, b + 1)]
            want = 0.5 * (1 - erf((line[i] - mean) / max(0.15 * mean, 2) / sqrt(2)))
            assert K.total_games_over(pa, pb, line, n)[i] == pytest.approx(want, abs=1e-12)
    assert K.total_games_over(pa, pb, np.array([0.0, 99.0]))[0] > 0.99
