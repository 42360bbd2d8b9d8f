"""Match statistics out of JSON responses and HTML tables, as flat maps of numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions import cleaning as C
from pitchside.functions.matching import html_tables
from pitchside.functions.probability import once
from pitchside.functions.registry import Registry
from pitchside.functions.rowmodels import present

#: Kinds of statistics and their keys.
FOOTBALL = {
    "shots on goal": "sot", "shots off goal": "shots_off", "total shots": "shots", "blocked shots": "blocked_shots",
    "shots insidebox": "shots_inside", "shots outsidebox": "shots_outside", "fouls": "fouls", "corner kicks": "corners",
    "offsides": "offsides", "ball possession": "possession", "yellow cards": "yellow_cards", "red cards": "red_cards",
    "goalkeeper saves": "gk_saves", "total passes": "passes", "passes accurate": "passes_accurate", "passes %": "pass_pct",
    "expected_goals": "xg",
}
QUARTERS = {"quarter_1": "q1", "quarter_2": "q2", "quarter_3": "q3", "quarter_4": "q4"}


@dataclass(frozen=True)
class TableForm:
    """Headers of a sport's HTML tables: those of the names, rows that are no team, keys with their headers, and what may end a name."""

    names: tuple[str, ...]
    keys: dict[str, tuple[str, ...]]
    skip: tuple[str, ...] = ()
    mark: str = ""


_LEAGUE = ("league average",)
#: Headers of HTML tables by the key they give.
FORMS = {
    "football": TableForm(("squad", "team"), {"xg": ("xg",), "xga": ("xga", "xg against"), "possession_pct": ("poss", "possession")} | {k: (k,) for k in ("sh", "sot", "gf", "ga", "gd", "pts")}),
    "basketball": TableForm(("team", "squad"), {
        "pace": ("pace",), "off_rtg": ("ortg", "offrtg", "off rtg"), "def_rtg": ("drtg", "defrtg", "def rtg"), "net_rtg": ("nrtg", "netrtg", "net rtg", "mov"),
        "fg_pct": ("fg%", "fg pct"), "three_pct": ("3p%", "3p pct", "3pt%"), "ft_pct": ("ft%", "ft pct"), "trb": ("trb", "reb"), "ast": ("ast",), "tov": ("tov",),
    }, _LEAGUE, r"\*$"),
    "ice_hockey": TableForm(("team", "squad"), {
        "corsi_for_pct": ("cf%", "corsi%", "corsi for%"), "fenwick_for_pct": ("ff%", "fenwick%"), "pp_pct": ("pp%",), "pk_pct": ("pk%",), "sv_pct": ("sv%", "save%"),
        "sh_pct": ("sh%", "shooting%"), "gf": ("gf",), "ga": ("ga",), "pts": ("pts",), "so_pct": ("so%",),
    }, _LEAGUE, r"\*$"),
    "american_football": TableForm(("tm", "team"), {
        "pts_for": ("pf", "pts"), "pts_against": ("pa",), "yards_per_play": ("y/p",), "pass_yds": ("pyds", "pass yds"), "rush_yds": ("ryds", "rush yds"), "turnovers": ("to", "turnovers"), "takeaways": ("takeaways",),
    }, ("avg total", "league total"), r"\*|\+$"),
    "tennis": TableForm(("player", "name"), {
        "ace_pct": ("ace%", "aces%"), "first_serve_pct": ("1st%", "1stin%", "1st serve%"), "first_serve_won_pct": ("1stw%", "1st won%"), "second_serve_won_pct": ("2ndw%", "2nd won%"),
        "bp_saved_pct": ("bps%", "bp saved%"), "return_pts_won_pct": ("rpw%", "ret pts won%"), "service_games_won_pct": ("sg%", "svc games%"),
    }),
}


def football_json(response: Column) -> Column:
    """Map of home_ and away_ statistics from a list of two teams' {type, value} lists; '55%' is 55."""
    response = F.from_json(response, "array<struct<statistics:array<struct<type:string,value:string>>>>")
    names = F.create_map(*[F.lit(x) for pair in FOOTBALL.items() for x in pair])

    def of(teams: Column, i: int, prefix: str) -> Column:
        stats = F.coalesce(F.try_element_at(teams, F.lit(i))["statistics"], F.array().cast("array<struct<type:string,value:string>>"))
        pairs = F.transform(stats, lambda s: F.struct(F.concat(F.lit(prefix), names[F.lower(s["type"])]).alias("k"), C.safe_float(F.rtrim(s["value"], F.lit("%"))).alias("v")))
        return F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())

    every = once(response, lambda teams: F.concat(of(teams, 1, "home_"), of(teams, 2, "away_")))
    # a kind named twice counts as the last says
    last = lambda every: F.filter(every, lambda p, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(once(every, last))


def points_json(response: Column, overtime: str = "over_time") -> Column:
    """Map of quarters, overtime and points of both sides (basketball, or with 'overtime' American football)."""
    fields = [*QUARTERS, overtime, "total"]
    side = ",".join(f"{f}:double" for f in fields)
    one = F.from_json(response, f"array<struct<scores:struct<home:struct<{side}>,away:struct<{side}>>>>")[0]["scores"]
    short = QUARTERS | {overtime: "ot", "total": "pts"}
    return once(one, lambda x: present({f"{short[f]}_{s}": x[s][f] for s in ("home", "away") for f in fields}))


def hockey_json(response: Column) -> Column:
    """Map of goals and of the periods' goals of both sides; periods by their first letter."""
    pair = "struct<home:double,away:double>"
    periods = ("first", "second", "third", "overtime")
    one = F.from_json(response, f"array<struct<scores:{pair},periods:struct<{','.join(f'{p}:{pair}' for p in periods)}>>>")[0]
    goals = lambda x: {f"goals_{s}": x["scores"][s] for s in ("home", "away")}
    return once(one, lambda x: present(goals(x) | {f"p{p[0]}_{s}": x["periods"][p][s] for p in periods for s in ("home", "away")}))


def table_stats(pages: DataFrame, html: str, form: TableForm = FORMS["football"]) -> DataFrame:
    """The columns of pages but html, team and stats: a row for each named row of tables that have a column of names.

    Headers count without case; the first header of a table that is one of a key's gives its number. Marks
    after a name, repeated header rows, average and total rows and rows without any number are left out.
    """
    rest = [c for c in pages.columns if c != html]
    cells = pages.select(*rest, F.explode(html_tables(F.col(html))).alias("t")).select(
        *rest, F.transform(F.col("t")[0], lambda h: F.lower(F.trim(h))).alias("header"), F.explode(F.slice("t", 2, F.size("t"))).alias("cells")
    )

    def at(names: tuple[str, ...]) -> Column:
        place = F.array_position(F.transform("header", lambda h: h.isin(*names)), F.lit(True))
        return once(place, lambda p: F.when(p > 0, F.try_element_at("cells", p.cast("int"))))

    team = F.trim(at(form.names))
    if form.mark:
        team = F.trim(F.regexp_replace(team, form.mark, ""))
    number = lambda names: once(at(names), C.scraped_number)
    row = F.struct(team.alias("team"), present({k: number(n) for k, n in form.keys.items()}).alias("stats"))
    return (
        cells.select(*rest, F.inline(F.array(row)))  # once, not for the filter too
        .where((F.col("team") != "") & ~F.lower("team").isin(*form.names, *form.skip) & (F.size("stats") > 0))
    )


def _parser(form: TableForm) -> Callable[[DataFrame, str], DataFrame]:
    return lambda pages, html: table_stats(pages, html, form)


#: Parsers of HTML pages by sport: DataFrame and the name of its column of pages.
PARSERS = Registry("parser", {sport: _parser(form) for sport, form in FORMS.items()})


def page_stats(pages: DataFrame, sport: str, html: str) -> DataFrame:
    """Every page through the parser of its sport (a column); pages of sports without a parser give nothing."""
    parts = [PARSERS.get(name)(pages.where(F.col(sport) == name), html) for name in PARSERS.names()]
    return reduce(DataFrame.unionByName, parts)
