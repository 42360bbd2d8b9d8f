"""What is chosen by a name: live models by sport, sources in order, parsers by sport, ingesters.

A registry maps a name to a function of columns or DataFrames, so a user adds a sport by registering
a function. Everything stays one plan: a column over many sports is a chain of conditions, sources in
order are joins and one coalesce.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import kernels as K
from pitchside.functions import odds as O
from pitchside.functions import probability as P

#: A live model: prior of the home side, home and away score, clock, map of live numbers.
LiveModel = Callable[[Column, Column, Column, Column, Column], Column]


@dataclass
class Registry:
    """Functions by name; an unknown name is an error that lists the known ones."""

    what: str
    entries: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, f: Callable) -> Callable:
        self.entries[name] = f
        return f

    def get(self, name: str) -> Callable:
        if name not in self.entries:
            raise KeyError(f"no {self.what} for {name!r}; there are {', '.join(sorted(self.entries))}")
        return self.entries[name]

    def names(self) -> list[str]:
        return sorted(self.entries)


MODELS = Registry("live model")
for _name, _model in (
    ("football", P.football_update), ("ice_hockey", P.hockey_update), ("basketball", P.basketball_update),
    ("american_football", P.american_football_update), ("tennis", K.tennis_update), ("darts", K.darts_update),
):
    MODELS.register(_name, _model)


def updated(sport: Column, p: Column, home: Column, away: Column, clock: Column, stats: Column, models: Registry = MODELS) -> Column:
    """The live probability of the home side, within 0 and 1; the prior where a model gives no number, null for an unknown sport.

    A model sees the scores of its own sport only: Python runs for all rows, and rows without a score cost nothing there.
    """
    out = F.lit(None).cast("double")
    for name in models.names():
        own = lambda c: F.when(sport == name, c)  # noqa: B023, E731
        x = models.get(name)(p, own(home), own(away), clock, stats)
        out = F.when(sport == name, F.coalesce(F.nanvl(x, F.lit(None).cast("double")), p)).otherwise(out)
    return P.once(out, lambda v: F.when(v > 1, 1.0).when(v < 0, 0.0).otherwise(v))


def value(p: Column, odds: Column) -> Column:
    """Struct of prob, implied, edge, ev (six places) and positive; null without valid odds and a probability in 0 to 1."""
    r = lambda c: F.round(c, 6)

    def one(x: Column) -> Column:
        p, o = x["p"], x["o"]
        ev = O.expected_value(p, o)
        some = F.struct(r(p).alias("prob"), r(1 / o).alias("implied"), r(p - 1 / o).alias("edge"), r(ev).alias("ev"), (ev > 0).alias("positive"))
        return F.when(o.isNotNull() & p.between(0, 1), some)

    # a fold over one row computes a long p once
    return F.transform(F.array(F.struct(p.alias("p"), O.normalized(odds).alias("o"))), one)[0]


def live_value(sport: Column, p: Column, home: Column, away: Column, clock: Column, odds: Column, stats: Column) -> Column:
    """value() of the updated probability; null for a prior out of range or a clock before 0."""
    return F.when(p.between(0, 1) & (clock >= 0), value(updated(sport, p, home, away, clock, stats), odds))


def first_answer(rows: DataFrame, key: str, sources: list[DataFrame], columns: list[str]) -> DataFrame:
    """rows with columns from the first source that has its key, and the number of that source."""
    out = rows
    for i, s in enumerate(sources):
        out = out.join(s.select(F.col(key), F.struct(*columns).alias(f"s{i}_")), key, "left")
    got = F.coalesce(*[F.when(F.col(f"s{i}_").isNotNull(), F.struct(F.lit(i).alias("source"), f"s{i}_.*")) for i in range(len(sources))])
    return out.withColumn("got_", got).select(*rows.columns, *[F.col(f"got_.{c}").alias(c) for c in columns], F.col("got_.source").alias("source"))


@dataclass
class Ingester:
    """Files of one sport: how they are read, what a row needs, how it becomes a match.

    run gives the matches and the rows left out; names go through resolve before a match is given.
    """

    read: Callable[[SparkSession, str], DataFrame]
    needs: tuple[str, ...]
    model: Callable[[DataFrame], DataFrame]
    resolve: Callable[[Column], Column] = F.trim

    def run(self, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        rows = self.read(spark, path)
        missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"`{n}`"), F.lit("")) == "", F.lit(n)) for n in self.needs]))
        matches = self.model(rows.where(F.size(missing) == 0))
        for side in ("home_team", "away_team"):
            matches = matches.withColumn(side, self.resolve(F.col(side)))
        return matches.where("match_date is not null"), rows.where(F.size(missing) > 0).withColumn("missing", missing)
