"""Odds, value and stake columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KELLY_SHARE = 0.25
KELLY_CAP = 0.05
LEAST_STAKE = 0.10


def american_to_decimal(a: Column) -> Column:
    """Decimal odds of American ones; null between -100 and 100."""
    return F.round(F.when(a >= 100, 1 + a / 100).when(a <= -100, 1 + 100 / F.abs(a)), 4)


def normalized(o: Column) -> Column:
    """Decimal odds of either format; null where the number is neither."""
    american = (o <= -100) | (o >= 99)
    return F.when(american, american_to_decimal(o)).when(o > 1, o)


def implied(o: Column) -> Column:
    return 1 / o


def edge(p: Column, o: Column) -> Column:
    return p - 1 / o


def expected_value(p: Column, o: Column) -> Column:
    return p * (o - 1) - (1 - p)


def clipped(p: Column) -> Column:
    """A probability kept off 0 and 1."""
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def kelly(p: Column, o: Column, bankroll: Column) -> Column:
    """Struct of full fraction, stake and reason (null if a stake is due): quarter Kelly, capped."""
    p = F.when((p <= 0) | (p >= 1), clipped(p)).otherwise(p)
    surplus = p * o - 1
    full = surplus / (o - 1)
    stake = F.least(bankroll * full * KELLY_SHARE, bankroll * KELLY_CAP)
    reason = (
        F.when(surplus <= 0, F.lit("negative_ev"))
        .when(bankroll <= 0, F.lit("zero_bankroll"))
        .when(stake < LEAST_STAKE, F.lit("below_minimum_stake"))
    )
    return F.struct(
        F.when(surplus > 0, full).otherwise(F.lit(0.0)).alias("full"),
        F.when(reason.isNull(), F.round(stake, 2)).otherwise(F.lit(0.0)).alias("stake"),
        reason.alias("reason"),
    )


def parlay_stake(stake: Column, cap: float = 1.0) -> Column:
    """Struct of the stake allowed and what was wrong with the one asked for."""
    return F.struct(
        F.when(stake <= 0, F.lit(0.0)).otherwise(F.least(stake, F.lit(cap))).alias("stake"),
        F.when(stake <= 0, F.lit("not_positive")).when(stake > cap, F.lit("capped")).alias("problem"),
    )


def settled_match_winner(selection: Column, home: Column, away: Column) -> Column:
    won = (
        F.when(selection == "home", home > away)
        .when(selection == "away", away > home)
        .when(selection == "draw", home == away)
    )
    return F.when(won, F.lit("WON")).when(~won, F.lit("LOST")).otherwise(F.lit("PUSHED_TO_HUMAN"))


def settled_over_under(direction: Column, line: Column, home: Column, away: Column) -> Column:
    total = home + away
    won = F.when(direction == "over", total > line).when(direction == "under", total < line)
    return (
        F.when(line.isNull() | won.isNull(), F.lit("PUSHED_TO_HUMAN"))
        .when(total == line, F.lit("VOID"))
        .when(won, F.lit("WON"))
        .otherwise(F.lit("LOST"))
    )


def settled_spread(side: Column, line: Column, home: Column, away: Column) -> Column:
    margin = F.when(side == "home", home + line - away).when(side == "away", away + line - home)
    return (
        F.when(margin.isNull(), F.lit("PUSHED_TO_HUMAN"))
        .when(margin == 0, F.lit("VOID"))
        .when(margin > 0, F.lit("WON"))
        .otherwise(F.lit("LOST"))
    )


def settled_both_score(selection: Column, home: Column, away: Column) -> Column:
    both = (home > 0) & (away > 0)
    won = F.when(selection == "yes", both).when(selection == "no", ~both)
    return F.when(won, F.lit("WON")).when(~won, F.lit("LOST")).otherwise(F.lit("PUSHED_TO_HUMAN"))


def net_pnl(outcome: Column, stake: Column, odds: Column) -> Column:
    """Profit of a settled stake (decimals), rounded half to even."""
    return (
        F.when(outcome == "WON", F.bround(stake * (odds - 1), 2))
        .when(outcome == "LOST", -stake)
        .otherwise(F.lit(0).cast("decimal(10,2)"))
    )


def ledger_delta(outcome: Column, stake: Column, odds: Column) -> Column:
    """What comes back to the ledger that the stake had left."""
    return (
        F.when(outcome == "WON", F.bround(stake * odds, 2))
        .when(outcome == "VOID", stake)
        .otherwise(F.lit(0).cast("decimal(10,2)"))
    )
