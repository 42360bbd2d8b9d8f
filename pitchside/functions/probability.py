"""Closed-form probability columns: Poisson and normal kernels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RHO = -0.13
GOALS = 10
HOCKEY_GOALS = 12
OVERTIME_HOME = 0.52


def poisson(k: int, rate: Column) -> Column:
    rate = F.greatest(rate, F.lit(0.0))
    return F.exp(-rate) * F.pow(rate, F.lit(float(k))) / float(math.factorial(k))


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _one_x_two(home: list[Column], away: list[Column], shift: list[tuple[int, int, Column]]) -> tuple[Column, Column, Column]:
    """Home, draw and away masses; shift: extra mass of single cells."""
    below = [_total(away[:i]) if i else F.lit(0.0) for i in range(len(home))]
    lower = [_total(home[:i]) if i else F.lit(0.0) for i in range(len(home))]
    win = _total([h * b for h, b in zip(home, below, strict=True)])
    draw = _total([h * a for h, a in zip(home, away, strict=True)])
    loss = _total([a * b for a, b in zip(away, lower, strict=True)])
    for i, j, mass in shift:
        if i > j:
            win = win + mass
        elif i == j:
            draw = draw + mass
        else:
            loss = loss + mass
    return win, draw, loss


def dixon_coles(home: Column, away: Column, rho: float = RHO) -> Column:
    """Struct of home, draw, away: two Poisson scores with the low-score correction, normalised."""
    h = [poisson(k, home) for k in range(GOALS + 1)]
    a = [poisson(k, away) for k in range(GOALS + 1)]
    shift = [
        (0, 0, h[0] * a[0] * (-home * away * rho)),
        (1, 0, h[1] * a[0] * (away * rho)),
        (0, 1, h[0] * a[1] * (home * rho)),
        (1, 1, h[1] * a[1] * F.lit(-rho)),
    ]
    win, draw, loss = _one_x_two(h, a, shift)
    mass = win + draw + loss
    return F.struct((win / mass).alias("home"), (draw / mass).alias("draw"), (loss / mass).alias("away"))


def hockey(home: Column, away: Column) -> Column:
    """Struct of home, draw, away in regular time, and home and away with overtime."""
    h = [poisson(k, home) for k in range(HOCKEY_GOALS + 1)]
    a = [poisson(k, away) for k in range(HOCKEY_GOALS + 1)]
    win, draw, loss = _one_x_two(h, a, [])
    return F.struct(
        win.alias("home"),
        draw.alias("draw"),
        loss.alias("away"),
        (win + draw * OVERTIME_HOME).alias("home_ot"),
        (loss + draw * (1 - OVERTIME_HOME)).alias("away_ot"),
    )


def poisson_over(home: Column, away: Column, line: float) -> Column:
    """Probability of more goals than the line."""
    return 1 - _total([poisson(k, home + away) for k in range(int(line) + 1)])


def both_score(home: Column, away: Column) -> Column:
    return (1 - F.exp(-home)) * (1 - F.exp(-away))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution, by its series of odd powers (38 standard deviations and more: 0 or 1)."""

    def area(z: Column) -> Column:
        start = F.struct(z.alias("term"), z.alias("sum"))

        def step(s: Column, n: Column) -> Column:
            term = s["term"] * z * z / (2 * n + 1)
            return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

        series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda s: s["sum"])
        return 0.5 + series * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    return once(F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0)), area)


def basketball(off_h: Column, def_h: Column, off_a: Column, def_a: Column, pace: Column, line: float = 224.5, spread: float = -3.5) -> Column:
    """Struct of home, over and cover: normal margins and totals with 12 points of spread."""
    hp = (off_h + def_a) / 2 * pace / 100
    ap = (off_a + def_h) / 2 * pace / 100
    diff = hp - ap + 3
    return F.struct(
        normal_cdf(diff / 12).alias("home"),
        (1 - normal_cdf((line - (hp + ap)) / 12)).alias("over"),
        normal_cdf((diff + spread) / 12).alias("cover"),
    )


def american_football(rating_h: Column, rating_a: Column, line: float = 44.5) -> Column:
    """Struct of home and over."""
    diff = rating_h - rating_a + 2.5
    mean = 44 + 0.3 * (rating_h + rating_a)
    return F.struct(
        normal_cdf(diff / 13.5).alias("home"), (1 - normal_cdf((line - mean) / 13)).alias("over")
    )


def total_over(mean: Column, line: Column) -> Column:
    """Probability of a predicted total to be over a line."""
    return 1 - normal_cdf((line - mean) / F.greatest(0.15 * mean, F.lit(1.0)))


def live_normal(p: Column, diff: Column, left: Column, total: float, sd: float) -> Column:
    """A live lead: what is left shrinks the prior margin and its spread; a final tie is even."""
    share = left / total
    mean = diff + (p - 0.5) * 2 * sd * share
    final = F.when(diff > 0, 1.0).when(diff < 0, 0.0).otherwise(0.5)
    return F.when(left <= 0, final).otherwise(normal_cdf(mean / (sd * F.sqrt(share))))


def brier(p: Column, hit: Column) -> Column:
    return F.pow(p - hit.cast("double"), 2)


def first_known(*columns: Column, default: float) -> Column:
    """The first number that is there and not 0, else the default."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in columns], F.lit(default))


def football_live(home: Column, away: Column, minute: Column, rate_h: Column, rate_a: Column) -> Column:
    """Probability that the home side wins from a score, a minute and the rates of 90 minutes."""
    left = F.greatest(F.lit(0.0), 90 - minute) / 90
    h = F.array(*[poisson(k, F.greatest(rate_h * left, F.lit(0.01))) for k in range(GOALS + 1)])
    a = F.array(*[poisson(k, F.greatest(rate_a * left, F.lit(0.01))) for k in range(GOALS + 1)])
    lead = home - away
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    below = lambda n: total(F.transform(a, lambda q, j: F.when(j < n, q).otherwise(F.lit(0.0))))
    win = total(F.transform(h, lambda p, i: p * below(i + lead)))
    p = F.when(left <= 0, (home > away).cast("double")).otherwise(win)
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


# --- live models ------------------------------------------------------------------------------------


def _goals(rate: Column, most: int) -> Column:
    """Array of the probabilities of 0 to most goals."""
    return once(rate, lambda r: F.array(*[poisson(k, r) for k in range(most + 1)]))


def _live_goals(lead: Column, h: Column, a: Column, level: float) -> Column:
    """Probability to be ahead at the end, from a lead and the goals still to come; a level end counts as so much."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    worth = lambda j, n: F.when(j < n, 1.0).when(j == n, level).otherwise(0.0)
    pair = F.struct(h.alias("h"), a.alias("a"), lead.alias("lead"))
    return once(pair, lambda x: total(F.transform(x["h"], lambda p, i: p * total(F.transform(x["a"], lambda q, j: q * worth(j, i + x["lead"]))))))


def blended_rate(seen: Column, prior: Column, elapsed: Column, most: float = 5.0) -> Column:
    """A rate of the whole match: what was seen so far, weighed by the share elapsed, and the prior."""
    live = F.least(F.greatest(seen, F.lit(0.0)) / F.nullif(elapsed, F.lit(0.0)), F.lit(most))
    return F.when((elapsed > 0.05) & seen.isNotNull(), elapsed * live + (1 - elapsed) * prior).otherwise(prior)


def football_update(p: Column, home: Column, away: Column, clock: Column, stats: Column) -> Column:
    """Home win from score and minute; stats may hold home_xg and away_xg, both or none."""
    share = F.greatest(F.lit(0.0), 90 - clock) / 90
    both = stats["home_xg"].isNotNull() & stats["away_xg"].isNotNull()
    rate = lambda n, prior: blended_rate(F.when(both, stats[n]), F.lit(prior), clock / 90)
    goals = lambda r: _goals(F.greatest(r * share, F.lit(0.01)), GOALS)
    ahead = _live_goals(home - away, goals(rate("home_xg", 1.45)), goals(rate("away_xg", 1.15)), 0.0)
    return F.when(share <= 0, (home > away).cast("double")).otherwise(ahead)


def hockey_update(p: Column, home: Column, away: Column, clock: Column, stats: Column) -> Column:
    """Home win with overtime; without expected goals the rates follow from the prior."""
    share, elapsed = F.greatest(F.lit(0.0), 60 - clock) / 60, clock / 60
    both = stats["home_xg"].isNotNull() & stats["away_xg"].isNotNull()
    own = F.greatest(F.lit(0.1), -F.log(1 - F.least(p, F.lit(0.99))) * 2.5)

    def rate(n: str, prior: Column) -> Column:
        seen = F.greatest(stats[n], F.lit(0.0))
        late = F.least(seen / F.nullif(elapsed, F.lit(0.0)), F.lit(8.0))
        return F.when(both, F.when(elapsed > 0.05, late).otherwise(seen)).otherwise(prior) * share

    goals = lambda r: _goals(r, HOCKEY_GOALS)
    ahead = _live_goals(home - away, goals(rate("home_xg", own)), goals(rate("away_xg", F.greatest(F.lit(0.1), 0.85 * own))), OVERTIME_HOME)
    final = F.when(home > away, 1.0).when(home < away, 0.0).otherwise(OVERTIME_HOME)
    return F.when(share <= 0, final).otherwise(ahead)


def basketball_update(p: Column, home: Column, away: Column, clock: Column, stats: Column) -> Column:
    return live_normal(p, (home - away).cast("double"), F.greatest(F.lit(0.0), 48 - clock), 48.0, 12.0)


def american_football_update(p: Column, home: Column, away: Column, clock: Column, stats: Column) -> Column:
    return live_normal(p, (home - away).cast("double"), F.greatest(F.lit(0.0), 60 - clock), 60.0, 13.5)


def hockey_over(home: Column, away: Column, line: float = 5.5) -> Column:
    """Probability of more goals than the line."""
    return poisson_over(home, away, line)
