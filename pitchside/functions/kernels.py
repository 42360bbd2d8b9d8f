"""Tennis and darts probabilities: dynamic programmes over whole columns at a time."""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def game(p: np.ndarray) -> np.ndarray:
    """Probability that the server wins a game, from that of a point."""
    q = 1 - p
    deuce = p * p / (p * p + q * q)
    return p**4 * (1 + 4 * q + 10 * q * q) + 20 * p**3 * q**3 * deuce


def tiebreak(pa: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Probability that A, who serves first, wins a tie-break to seven.

    After the first point the serve changes every two points, and A has the first two of those.
    """
    mass = {(0, 0): np.ones_like(pa)}
    won = np.zeros_like(pa)
    for n in range(12):
        a_serves = n == 0 or ((n - 1) // 2) % 2 == 0
        p = pa if a_serves else 1 - pb
        after: dict[tuple[int, int], np.ndarray] = {}
        for (a, b), m in mass.items():
            for to, share in (((a + 1, b), p), ((a, b + 1), 1 - p)):
                if to[0] == 7:
                    won = won + m * share
                elif to[1] < 7:
                    after[to] = after.get(to, 0) + m * share
        mass = after
    x = (pa + 1 - pb) / 2
    return won + mass[(6, 6)] * x * x / (x * x + (1 - x) * (1 - x))


def sets(pa: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that A, who serves first, wins a set, and the games expected in it."""
    hold, break_ = game(pa), 1 - game(pb)
    mass = {(0, 0): np.ones_like(pa)}
    won, games = np.zeros_like(pa), np.zeros_like(pa)
    for n in range(12):
        p = hold if n % 2 == 0 else break_
        after: dict[tuple[int, int], np.ndarray] = {}
        for (a, b), m in mass.items():
            games = games + m
            for (x, y), share in (((a + 1, b), p), ((a, b + 1), 1 - p)):
                if max(x, y) >= 6 and abs(x - y) >= 2:
                    won = won + m * share * (x > y)
                else:
                    after[(x, y)] = after.get((x, y), 0) + m * share
        mass = after
    return won + mass[(6, 6)] * tiebreak(pa, pb), games + mass[(6, 6)]


def game_from(p: np.ndarray, x: int, y: int) -> np.ndarray:
    """Probability that the server wins a game from x points to y (4 or more: as in deuce and advantage)."""
    q = 1 - p
    while x + y > 6 or max(x, y) > 4:  # deuce again: only the difference counts
        x, y = x - 1, y - 1
    deuce = p * p / (p * p + q * q)
    known = {(3, 3): deuce, (4, 3): p + q * deuce, (3, 4): p * deuce}

    def win(i: int, j: int) -> np.ndarray:
        if (i, j) not in known:
            known[i, j] = np.ones_like(p) if i >= 4 and i - j >= 2 else np.zeros_like(p) if j >= 4 and j - i >= 2 else p * win(i + 1, j) + q * win(i, j + 1)
        return known[i, j]

    return win(x, y)


def tiebreak_from(pa: np.ndarray, pb: np.ndarray, a: int, b: int, a_first: bool = True) -> np.ndarray:
    """Probability that A wins a tie-break from a points to b; a_first: A served its first point."""
    x = (pa + 1 - pb) / 2
    level = x * x / (x * x + (1 - x) * (1 - x))
    if min(a, b) >= 6:
        return level if a == b else x + (1 - x) * level if a == b + 1 else x * level if b == a + 1 else np.full_like(pa, float(a > b))
    known: dict[tuple[int, int], np.ndarray] = {(6, 6): level}

    def win(i: int, j: int) -> np.ndarray:
        if (i, j) not in known:
            if max(i, j) >= 7:
                known[i, j] = np.full_like(pa, float(i > j))
            else:
                n = i + j
                own = a_first if n == 0 else ((n - 1) // 2 % 2 == 0) == a_first
                p = pa if own else 1 - pb
                known[i, j] = p * win(i + 1, j) + (1 - p) * win(i, j + 1)
        return known[i, j]

    return win(a, b)


def set_from(pa: np.ndarray, pb: np.ndarray, games: tuple[int, int], points: tuple[int, int] = (0, 0), a_serves: bool = True) -> np.ndarray:
    """Probability that A wins a set from a score in games and, within the present game or tie-break, in points.

    a_serves: A serves the present game, or served the first point of the tie-break.
    """
    hold, break_ = game(pa), 1 - game(pb)
    known: dict[tuple[int, int], np.ndarray] = {}

    def win(i: int, j: int, serves: bool) -> np.ndarray:
        if (i, j) not in known:  # the server of a score follows from it
            if max(i, j) >= 6 and abs(i - j) >= 2:
                known[i, j] = np.full_like(pa, float(i > j))
            elif (i, j) == (6, 6):
                known[i, j] = tiebreak_from(pa, pb, 0, 0, serves)
            else:
                p = hold if serves else break_
                known[i, j] = p * win(i + 1, j, not serves) + (1 - p) * win(i, j + 1, not serves)
        return known[i, j]

    i, j = games
    if points == (0, 0) or max(i, j) >= 6 and abs(i - j) >= 2:
        return win(i, j, a_serves)
    if (i, j) == (6, 6):
        return tiebreak_from(pa, pb, *points, a_serves)
    p = game_from(pa, *points) if a_serves else 1 - game_from(pb, *points[::-1])
    return p * win(i + 1, j, not a_serves) + (1 - p) * win(i, j + 1, not a_serves)


def match_from(pa: np.ndarray, pb: np.ndarray, best_of: int, sets_won: tuple[int, int], games: tuple[int, int] = (0, 0), points: tuple[int, int] = (0, 0), a_serves: bool = True) -> np.ndarray:
    """Probability of the match from any score; sets after the present one begin with its server again."""
    target, (a, b) = (best_of + 1) // 2, sets_won
    if max(a, b) >= target:
        return np.full_like(pa, float(a >= target))
    now = set_from(pa, pb, games, points, a_serves)
    later = set_from(pa, pb, (0, 0), (0, 0), a_serves if sum(games) % 2 == 0 else not a_serves)
    return now * first_to(later, later, target, a + 1, b) + (1 - now) * first_to(later, later, target, a, b + 1)


def total_games_over(pa: np.ndarray, pb: np.ndarray, line: np.ndarray, best_of: int = 3) -> np.ndarray:
    """Probability of more games than line: a normal law around the expected games, 15 % wide and 2 at least."""
    s, games = sets(pa, pb)
    w = 1 - s
    if best_of == 3:
        count = 2 * (s * s + w * w) + 3 * 2 * s * w
    else:
        three, four = s**3 + w**3, 3 * s * w * (s * s + w * w)
        count = 3 * three + 4 * four + 5 * (1 - three - four)
    mean = games * count
    z = (mean - line) / np.maximum(0.15 * mean, 2.0)
    return np.array([0.5 * (1 + erf(v / sqrt(2))) for v in z])


def tennis_over(pa: Column, pb: Column, line: Column, best_of: int = 3) -> Column:
    """total_games_over as a column."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(total_games_over(a.round(4).to_numpy(float), b.round(4).to_numpy(float), n.to_numpy(float), best_of))

    return run(pa, pb, line)


def match(s: np.ndarray, best_of: int = 3) -> np.ndarray:
    """Probability of a match from that of a set; every set begins with the same server."""
    return s * s * (3 - 2 * s) if best_of == 3 else s**3 * (10 - 15 * s + 6 * s * s)


def first_to(first: np.ndarray, second: np.ndarray, target: int, a: int = 0, b: int = 0) -> np.ndarray:
    """Probability that A is first to target from a to b, when A wins the next part with probability
    first, the one after it with second, and so on by turns."""
    if a >= target or b >= target:
        return np.full_like(first, float(a >= target))
    mass = {(a, b): np.ones_like(first)}
    won = np.zeros_like(first)
    for n in range(2 * target - 1 - a - b):
        p = first if n % 2 == 0 else second
        after: dict[tuple[int, int], np.ndarray] = {}
        for (x, y), m in mass.items():
            for to, share in (((x + 1, y), p), ((x, y + 1), 1 - p)):
                if to[0] == target:
                    won = won + m * share
                elif to[1] < target:
                    after[to] = after.get(to, 0) + m * share
        mass = after
    return won


def legs(home: np.ndarray, away: np.ndarray, target: int, a: int = 0, b: int = 0, home_first: bool = True) -> np.ndarray:
    """Probability that the home player is first to so many legs, with the throw changing every leg."""
    return first_to(home, 1 - away, target, a, b) if home_first else first_to(1 - away, home, target, a, b)


def leg_sets(home: np.ndarray, away: np.ndarray, legs_per_set: int = 5, target: int = 4, a: int = 0, b: int = 0, home_first: bool = True) -> np.ndarray:
    """The same for sets of legs; the first throw changes every set."""
    need = (legs_per_set + 1) // 2
    own, other = (np.round(legs(home, away, need, home_first=f), 4) for f in (True, False))
    return first_to(own, other, target, a, b) if home_first else first_to(other, own, target, a, b)


def _by_state(f, state: pd.DataFrame, *rates: np.ndarray) -> pd.Series:
    """f over the rows of each state; a state with nulls gives null."""
    out = pd.Series(np.nan, index=state.index)
    for key, rows in state.dropna().groupby(list(state.columns)).groups.items():
        at = state.index.get_indexer(rows)
        out.iloc[at] = f(*[int(k) for k in key], *[r[at] for r in rates])
    return out


def tennis_update(p: Column, home: Column, away: Column, clock: Column, stats: Column) -> Column:
    """Match win from sets won; stats may hold p_serve_home, p_serve_away, best_of, a_serving (1 or 0), and of the
    present set games_home, games_away, points_home and points_away (points won, not 15 or 30)."""
    number = lambda n, default: F.coalesce(stats[n], F.lit(float(default)))
    state = ("games_home", "games_away", "points_home", "points_away")

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, sh: pd.Series, sa: pd.Series, best: pd.Series, serves: pd.Series, g: pd.Series, h: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        def win(won: int, lost: int, best_of: int, first: int, g: int, h: int, x: int, y: int, own: np.ndarray, other: np.ndarray) -> np.ndarray:
            return match_from(own, other, best_of, (won, lost), (g, h), (x, y), bool(first))

        rows = pd.DataFrame({"a": a, "b": b, "best": best, "serves": serves, "g": g, "h": h, "x": x, "y": y})
        return _by_state(win, rows, sh.round(4).to_numpy(float), sa.round(4).to_numpy(float))

    return run(home.cast("double"), away.cast("double"), number("p_serve_home", 0.65), number("p_serve_away", 0.62), number("best_of", 3), number("a_serving", 1), *[number(n, 0) for n in state])


def darts_update(p: Column, home: Column, away: Column, clock: Column, stats: Column) -> Column:
    """Match win from legs or sets won; stats may hold p_leg_home, p_leg_away, legs_to_win, sets (1: sets of legs),
    legs_per_set, sets_to_win and home_throwing (1 or 0)."""
    number = lambda n, default: F.coalesce(stats[n], F.lit(float(default)))
    own = number("p_leg_home", 0.55)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series, to: pd.Series, by_sets: pd.Series, per: pd.Series, sets_to: pd.Series, throws: pd.Series) -> pd.Series:
        def win(won: int, lost: int, target: int, sets_: int, per_set: int, of: int, first: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return leg_sets(x, y, per_set, of, won, lost, bool(first)) if sets_ else legs(x, y, target, won, lost, bool(first))

        state = pd.DataFrame({"a": a, "b": b, "to": to, "sets": by_sets, "per": per, "of": sets_to, "first": throws})
        return _by_state(win, state, h.round(4).to_numpy(float), w.round(4).to_numpy(float))

    return run(home.cast("double"), away.cast("double"), own, F.coalesce(stats["p_leg_away"], 1 - own), number("legs_to_win", 6), number("sets", 0), number("legs_per_set", 5), number("sets_to_win", 4), number("home_throwing", 1))


def tennis(pa: Column, pb: Column, best_of: int = 3) -> Column:
    """Struct of the set, the match and the expected games, from the points won on serve."""

    @F.pandas_udf("set_win double, match_win double, games double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = a.round(4).to_numpy(float), b.round(4).to_numpy(float)
        s, n = sets(x, y)
        count = 2 * (s * s + (1 - s) ** 2) + 3 * 2 * s * (1 - s)
        return pd.DataFrame({"set_win": s, "match_win": match(s, best_of), "games": n * count})

    return run(pa, pb)


def darts(home: Column, away: Column, target: int = 6) -> Column:
    @F.pandas_udf("double")
    def run(h: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(legs(h.round(4).to_numpy(float), a.round(4).to_numpy(float), target))

    return run(home, away)
