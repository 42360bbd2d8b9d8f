"""Features of any statistics: whatever keys two profiles have, as h_, a_ and diff_ numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions.cleaning import hand

#: Keys of profiles that are no features, and those besides roll_ that have differences.
NO_FEATURES = ("elo_rating",)
DIFFERENCES = ("win_pct", "season_win_pct")


def dynamic_features(home: Column, away: Column, tennis: bool = False, skip: tuple[str, ...] = NO_FEATURES) -> Column:
    """A map of numbers from two maps of texts (profiles): h_key and a_key for every key that is a number on either
    side (0 where it is missing on one), and diff_key for rolling means and shares of wins.

    With tennis also the differences of age, height and rating, and the hands and their product, where
    both sides have them. Keys need not be known: a new statistic of a file is a new feature.
    """
    numbers = lambda m: F.map_filter(F.transform_values(_text_map(m), lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull() & ~k.isin(*skip))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = F.map_entries(F.map_zip_with(numbers(home), numbers(away), lambda k, x, y: F.struct(zero(x).alias("x"), zero(y).alias("y"))))
    pair = lambda name, value: F.struct(name.alias("k"), value.alias("v"))
    named = lambda prefix, of: F.transform(both, lambda e: pair(F.concat(F.lit(prefix), e["key"]), of(e["value"])))
    apart = F.filter(both, lambda e: F.startswith(e["key"], F.lit("roll_")) | e["key"].isin(*DIFFERENCES))
    parts = [named("h_", lambda v: v["x"]), named("a_", lambda v: v["y"]), F.transform(apart, lambda e: pair(F.concat(F.lit("diff_"), e["key"]), e["value"]["x"] - e["value"]["y"]))]
    if tennis:
        parts.append(_tennis(home, away))
    return F.map_from_entries(F.concat(*parts))


def _text_map(m: Column) -> Column:
    return F.coalesce(F.transform_values(m, lambda k, v: v.cast("string")), F.create_map().cast("map<string,string>"))


def _tennis(home: Column, away: Column) -> Column:
    h, a = _text_map(home), _text_map(away)
    number = lambda m, *keys: F.coalesce(*[F.try_element_at(m, F.lit(k)).try_cast("double") for k in keys], F.lit(None).cast("double"))
    of = lambda m: hand(F.try_element_at(m, F.lit("hand"))).cast("double")
    rate = [number(m, "elo_rating") for m in (h, a)]
    cells = {
        "age_diff": number(h, "age", "age_years") - number(a, "age", "age_years"), "height_diff": number(h, "height_cm") - number(a, "height_cm"),
        "h_hand": of(h), "a_hand": of(a), "hand_matchup": of(h) * of(a), "h_elo_rating": rate[0], "a_elo_rating": rate[1], "elo_diff": rate[0] - rate[1],
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in cells.items()])
    return F.filter(pairs, lambda e: e["v"].isNotNull())


def feature_names(rows: DataFrame, features: str) -> list[str]:
    """Every key of a column of maps, in order: as many as statistics have names, whatever the rows."""
    return [r[0] for r in rows.select(F.explode(F.map_keys(features)).alias("k")).distinct().orderBy("k").collect()]


def wide(rows: DataFrame, features: str, names: list[str]) -> DataFrame:
    """rows with a column for each name in place of the map; missing numbers are 0."""
    rest = [c for c in rows.columns if c != features]
    return rows.select(*rest, *[F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0)).alias(n) for n in names])
