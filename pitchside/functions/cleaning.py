"""Cleaning and parsing columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A decimal number; single underscores may part its digits.
_DECIMAL = r"^[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?$"


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def safe_float(c: Column, default: float | None = None) -> Column:
    """A finite decimal number or the default: no hexadecimal, no type suffix, no NaN or infinity."""
    t = stripped(c)
    x = F.when(t.rlike(_DECIMAL), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
    return F.coalesce(F.when(F.abs(x) != float("inf"), x), F.lit(default))


def safe_int(c: Column, default: int | None = 0) -> Column:
    """A number cut towards zero, or the default (also beyond 64 bits)."""
    return F.coalesce(safe_float(c).try_cast("long"), F.lit(default))


def scraped_number(c: Column) -> Column:
    """The number among other characters."""
    return F.regexp_replace(c, r"[^0-9.+\-]", "").try_cast("double")


#: Formats and their shapes, in the order in which a reader of mixed files tries them.
DATE_FORMATS = {
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}
#: The order of files that write the month first.
MONTH_FIRST = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy")


def parsed_date(c: Column, formats: tuple[str, ...] = tuple(DATE_FORMATS)) -> Column:
    """The first format that fits."""
    c = stripped(c)
    return F.coalesce(*[F.when(c.rlike(DATE_FORMATS[f]), F.try_to_date(c, f)) for f in formats])


def _season(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def season_of(day: Column, first_month: int) -> Column:
    """Season of a date, such as 2023-24, for seasons that begin in a month."""
    return _season(F.year(day) - (F.month(day) < first_month).cast("int"))


def season_in_name(name: Column, day: Column, first_month: int = 7) -> Column:
    """Season from a file name (2023-24, 2023_24, or the first lone 2324), else from the date."""
    long, lone = r"(20\d{2})[-_](\d{2})", r"(?<!\d)(\d{2})(\d{2})(?!\d)"
    y1 = F.regexp_extract(name, lone, 1).try_cast("int")
    y2 = F.regexp_extract(name, lone, 2).try_cast("int")
    return (
        F.when(name.rlike(long), F.concat_ws("-", F.regexp_extract(name, long, 1), F.regexp_extract(name, long, 2)))
        .when(y2 == (y1 + 1) % 100, _season(2000 + y1))
        .otherwise(season_of(day, first_month))
    )


def season_in_year(name: Column, day: Column, first_month: int = 7) -> Column:
    """Season from a file name (2023-24, 2023_24, or the single year of nfl_2024), else from the date; the name's year wins."""
    long, year = r"(20\d{2})[-_](\d{2})", r"(20\d{2})"
    start = F.regexp_extract(name, year, 1).try_cast("int")
    return (
        F.when(name.rlike(long), F.concat_ws("-", F.regexp_extract(name, long, 1), F.regexp_extract(name, long, 2)))
        .when(start.isNotNull(), _season(start))
        .otherwise(season_of(day, first_month))
    )


def set_score(score: Column) -> Column:
    """Struct of sets won and lost in a score such as '6-4 3-6 7-6(5)'."""
    sets = F.transform(F.split(F.trim(score), r"\s+"), lambda s: F.split(F.regexp_replace(s, r"\(.*$", ""), "-"))
    pairs = F.transform(sets, lambda s: F.struct(F.try_element_at(s, F.lit(1)).try_cast("int").alias("a"), F.try_element_at(s, F.lit(2)).try_cast("int").alias("b")))
    return F.struct(
        F.size(F.filter(pairs, lambda p: p["a"] > p["b"])).alias("won"),
        F.size(F.filter(pairs, lambda p: p["b"] > p["a"])).alias("lost"),
    )


#: Other spellings of a selection.
SELECTIONS = {
    "1": "home", "h": "home", "home_win": "home",
    "x": "draw", "d": "draw",
    "2": "away", "a": "away", "away_win": "away",
}


def canonical_selection(c: Column) -> Column:
    """Lower case with underscores, one spelling for each outcome, no trailing zeros of a decimal."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s–]+", "_")
    s = F.regexp_replace(s, r"([a-z])-([0-9])", "$1_$2")
    known = F.create_map(*[F.lit(x) for pair in SELECTIONS.items() for x in pair])
    s = F.coalesce(known[s], s)
    s = F.regexp_replace(s, r"([0-9]+\.[0-9]*?)0+(?![0-9])", "$1")
    return F.regexp_replace(s, r"([0-9]+)\.(?![0-9])", "$1")


def direction_and_line(c: Column) -> Column:
    """Struct of what stands before the first underscore and the number behind it."""
    parts = F.split(c, "_", 2)
    return F.struct(parts[0].alias("direction"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("line"))


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct words of some length."""
    return F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda t: F.length(t) >= least))


def last_name(c: Column) -> Column:
    """What stands before a comma, else the first of the longest words, lower case."""
    c = F.lower(F.regexp_replace(stripped(c), r"\s+", " "))
    longest = F.aggregate(F.split(c, " "), F.lit(""), lambda b, w: F.when(F.length(w) > F.length(b), w).otherwise(b))
    return F.when(F.contains(c, F.lit(",")), F.trim(F.substring_index(c, ",", 1))).otherwise(longest)


def is_abbreviation(c: Column) -> Column:
    t = F.trim(c)
    return (F.length(t) < 4) | ((F.length(t) <= 4) & (F.upper(t) == t) & t.rlike("[A-Z]"))


def hand(c: Column) -> Column:
    return F.when(c == "R", 1).when(c == "L", -1).otherwise(0)


def truncated(c: Column, n: int = 500) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def version_hash(*parts: Column) -> Column:
    """The first twelve hexadecimal digits of the parts' SHA-256."""
    return F.left(F.sha2(F.concat_ws("_", *parts), 256), F.lit(12))


def title_of_key(c: Column, prefix: str) -> Column:
    """A display name of a key such as soccer_first_league."""
    return F.initcap(F.replace(F.regexp_replace(c, f"^{prefix}_", ""), F.lit("_"), F.lit(" ")))


def first_failure(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that does not hold, null if all hold (unknown counts as not)."""
    return F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks])


def failures(*checks: tuple[Column, str]) -> Column:
    """The names of all checks that do not hold, in order, joined."""
    return F.concat_ws(",", *[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks])
