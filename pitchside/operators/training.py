"""Training sets and vectors: what was known of both sides before each match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows of rolling means, meetings of a pair that count, and days of rest where no match came before.
SIZES = (5, 10)
MEETINGS = 5
REST = 7
VALUES = ("scored", "conceded", "points")
#: Numbers of one side.
SIDE = ("games", "rest", *[f"{v}_{n}" for n in SIZES for v in VALUES])
#: All columns of a vector.
COLUMNS = [*[f"{s}_{c}" for s in "had" for c in SIDE], "meetings", "meeting_win_share"]


def _numbered(rows: DataFrame, keys: list[Column], there: Column) -> DataFrame:
    """rows with nth_: how many earlier rows of the key have a score."""
    earlier = Window.partitionBy(*keys).orderBy("scheduled_at", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("nth_", F.coalesce(F.sum(there.cast("long")).over(earlier), F.lit(0)))


def _last(keys: list[Column], n: int) -> Window:
    """The last n rows with a score before the present one, by nth_ (rows without one hold nulls)."""
    return Window.partitionBy(*keys).orderBy("nth_").rangeBetween(-n, -1)


def vectors(matches: DataFrame) -> DataFrame:
    """match_id and COLUMNS of matches (match_id, home, away, scheduled_at, home_score, away_score).

    h_ and a_ are the sides' matches so far, days of rest and rolling means of goals and points, d_ the
    differences; meetings are the last of the unordered pair, and the share of them that the present
    home side won. Matches are in order of time, then id; only earlier ones with a score count, so a
    match without one gets its vector too and nothing of a match itself is seen. The sides of a match
    are two teams. Missing means are 0.
    """
    x, y = F.col("home_score"), F.col("away_score")
    done = x.isNotNull() & y.isNotNull()
    points = lambda a, b: F.when(a > b, 3).when(a == b, 1).when(a < b, 0)
    side = lambda name, team, a, b: F.struct(F.lit(name).alias("side"), F.col(team).alias("team"), F.when(done, a).alias("scored"), F.when(done, b).alias("conceded"), F.when(done, points(a, b)).alias("points"))
    sides = matches.select("match_id", "scheduled_at", F.explode(F.array(side("h", "home", x, y), side("a", "away", y, x))).alias("s")).select("match_id", "scheduled_at", "s.*")
    team = [F.col("team")]
    day = F.unix_date(F.to_date("scheduled_at"))
    earlier = Window.partitionBy("team").orderBy("scheduled_at", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    sides = _numbered(sides.withColumn("last_", F.max(F.when(F.col("scored").isNotNull(), day)).over(earlier)), team, F.col("scored").isNotNull())
    known = sides.select(
        "match_id", "side", F.col("nth_").cast("double").alias("games"), F.coalesce(day - F.col("last_"), F.lit(REST)).cast("double").alias("rest"),
        *[F.coalesce(F.round(F.avg(v).over(_last(team, n)), 4), F.lit(0.0)).alias(f"{v}_{n}") for n in SIZES for v in VALUES],
    )
    one = lambda s: F.max(F.when(F.col("side") == s, F.struct(*SIDE))).alias(s)
    both = known.groupBy("match_id").agg(one("h"), one("a"))
    pair = [F.least("home", "away"), F.greatest("home", "away")]
    winner = F.when(x > y, F.col("home")).when(x < y, F.col("away")).otherwise(F.lit(-1))
    met = _numbered(matches.withColumn("winner_", F.when(done, winner)), pair, done)
    met = met.select("match_id", "home", F.collect_list("winner_").over(_last(pair, MEETINGS)).alias("w"))
    share = F.size(F.filter("w", lambda v: v == F.col("home"))) / F.size("w")
    met = met.select("match_id", F.size("w").cast("double").alias("meetings"), F.coalesce(F.round(F.when(F.size("w") > 0, share), 4), F.lit(0.0)).alias("meeting_win_share"))
    flat = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ha" for c in SIDE]
    return both.join(met, "match_id").select("match_id", *flat, *[F.round(F.col(f"h.{c}") - F.col(f"a.{c}"), 4).alias(f"d_{c}") for c in SIDE], "meetings", "meeting_win_share")


def training_set(matches: DataFrame, least_games: int = 3) -> DataFrame:
    """The vectors of matches with a score whose sides both have so many matches before, with label (0 home, 1 draw, 2 away), goals and scheduled_at."""
    x, y = F.col("home_score"), F.col("away_score")
    label = F.when(x > y, 0.0).when(x == y, 1.0).otherwise(2.0)
    own = matches.where(x.isNotNull() & y.isNotNull()).select("match_id", "scheduled_at", label.alias("label"), (x + y).cast("double").alias("goals"))
    return vectors(matches).join(own, "match_id").where((F.col("h_games") >= least_games) & (F.col("a_games") >= least_games))


def gate(rows: DataFrame, columns: list[str], least_rows: int = 20, coverage: float = 0.5) -> str:
    """'ok', or why no model is fitted: too few rows, or too few numbers that are there and not 0."""
    there = sum((F.col(c).isNotNull() & (F.col(c) != 0)).cast("int") for c in columns) / F.lit(len(columns))
    n, share = rows.agg(F.count(F.lit(1)), F.avg(there)).first()
    return "too few rows" if n < least_rows else "low coverage" if (share or 0) < coverage else "ok"
