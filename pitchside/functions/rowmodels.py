"""Rows of sports files, all strings, as typed matches with maps of what each file offers.

Every model gives season, division, match_date, home_team, away_team, home_score, away_score, result
(H, A or D) and the maps match_stats, odds, betting_lines and advanced_stats (numbers) and labels
(texts). Columns that a file lacks are null; cells that hold no number leave no entry. Rows without
both sides and a date are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions import cleaning as C

#: Columns of the files.
QUARTERS = ("q1", "q2", "q3", "q4", "ot")
VARIANTS = ("Open", "Min", "Max", "Close")
NHL_GAME = ("shots", "power_play_goals", "power_play_opportunities", "faceoff_win_pct", "hits", "blocked_shots", "pim", "giveaways", "takeaways")
NHL_SEASON = ("season_games_played", "season_wins", "season_goals_for", "season_goals_against", "season_win_pct", "season_goal_diff")
NHL_RIVAL = ("opp_season_wins", "opp_season_goals_for", "opp_season_goals_against", "opp_season_win_pct", "opp_season_goal_diff", "opp_rest_days", "opp_pre_game_point_pct")
NHL_DIFFERENCE = ("rest_diff", "win_pct_diff", "goal_diff_diff", "record_wins_diff", "record_losses_diff")
NHL_ROLLS = ("roll_3", "roll_10", "roll_30")
SERVE = ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced")
BOOKS = {"b365": ("B365W", "B365L"), "ex": ("EXW", "EXL"), "lb": ("LBW", "LBL"), "ps": ("PSW", "PSL"), "sj": ("SJW", "SJL"), "max": ("MaxW", "MaxL"), "avg": ("AvgW", "AvgL")}
#: Columns of a game's outcome, which no profile may hold, and the columns that a profile takes.
OUTCOMES = ("game_id", "date", "team_name", "is_home", "goals_for", "venue", "attendance", "season")
PROFILE = ("roll_", "opp_roll_", "opp_season_", "season_")


class Cells:
    """The columns of rows by name; a name the file lacks is a null text."""

    def __init__(self, rows: DataFrame, prefix: str = ""):
        self.names, self.prefix = set(rows.columns), prefix

    def __getitem__(self, name: str) -> Column:
        full = self.prefix + name
        return F.col(f"`{full}`") if full in self.names else F.lit(None).cast("string")

    def text(self, *names: str) -> Column:
        """The first of the cells that is not blank, stripped."""
        return F.coalesce(*[F.nullif(C.stripped(self[n]), F.lit("")) for n in names])

    def number(self, name: str) -> Column:
        return C.safe_float(self[name])

    def count(self, name: str, least: int = 0) -> Column:
        """A whole number of at least so much, as a double."""
        n = C.safe_int(self[name], -1)
        return F.when(n >= least, n).cast("double")


def present(entries: dict[str, Column], kind: str = "double") -> Column:
    """A map of the entries that are not null."""
    pairs = [F.struct(F.lit(k).alias("k"), v.cast(kind).alias("v")) for k, v in entries.items()]
    some = F.filter(F.array(*pairs), lambda e: e["v"].isNotNull()) if pairs else F.array().cast(f"array<struct<k:string,v:{kind}>>")
    return F.map_from_entries(some)


def result(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(away > home, "A").otherwise("D")


def required(rows: DataFrame, *names: str) -> DataFrame:
    """Rows where none of the cells is null or empty."""
    cells = Cells(rows)
    return rows.where(reduce(lambda a, b: a & b, [F.coalesce(cells[n], F.lit("")) != "" for n in names]))


def _match(rows: DataFrame, **columns: Column) -> DataFrame:
    none = present({})
    maps = {m: columns.pop(m, none) for m in ("match_stats", "odds", "betting_lines", "advanced_stats")}
    labels = columns.pop("labels", present({}, "string"))
    home, away = columns["home_score"], columns["away_score"]
    columns.setdefault("result", result(home, away))
    return rows.select(*[c.alias(n) for n, c in columns.items()], *[c.alias(n) for n, c in maps.items()], labels.alias("labels"))


def nba(rows: DataFrame) -> DataFrame:
    """Basketball games with quarters, overtime, spreads, totals and moneylines."""
    c = Cells(rows := required(rows, "home", "away", "date"))
    day = C.parsed_date(c["date"], C.MONTH_FIRST)
    stated, year = c.text("season"), C.safe_float(c["season"]).try_cast("int")
    season = F.when((F.length(stated) >= 7) & stated.contains("-"), stated).when(year.isNotNull(), F.concat_ws("-", year.cast("string"), F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0")))
    season = F.coalesce(season, F.when(~F.lower(stated).rlike("nan|inf"), stated))
    return _match(
        rows,
        season=F.coalesce(season, C.season_of(day, 7)), division=F.lit("NBA"), match_date=day, home_team=c.text("home"), away_team=c.text("away"),
        home_score=C.safe_int(c["score_home"]), away_score=C.safe_int(c["score_away"]),
        match_stats=present({f"{q}_{s}": c.count(f"{q}_{s}") for q in QUARTERS for s in ("away", "home")}),
        odds=present({k: c.number(k) for k in ("moneyline_away", "moneyline_home")}),
        betting_lines=present({k: c.number(k) for k in ("spread", "total", "h2_spread", "h2_total")}),
        labels=present({"regular": c.text("regular"), "playoffs": c.text("playoffs"), "favored": c.text("whos_favored"), "id_spread": c.text("id_spread"), "id_total": c.text("id_total")}, "string"),
    )


def nfl(rows: DataFrame) -> DataFrame:
    """American football games; closing lines stand in match_stats too. A season that source_file names wins over the date's."""
    file = F.col("source_file") if "source_file" in rows.columns else F.lit("")
    c = Cells(rows := required(rows, "Home Team", "Away Team", "Date"))
    day = C.parsed_date(F.substring_index(c["Date"], " ", 1), C.MONTH_FIRST)
    key = lambda name: name.lower().replace(" ", "_")
    flag = lambda name: F.when(F.lower(c[name]).isin("yes", "true", "1"), 1.0)
    closing = [f"{s} {what} Close" for s in ("Home", "Away") for what in ("Odds", "Line", "Line Odds")]
    totals = ["Total Score", "Total Score Over", "Total Score Under"]
    short = lambda name: key(name).replace("total_score", "total")
    return _match(
        rows,
        season=C.season_in_year(file, day), division=F.lit("NFL"), match_date=day, home_team=c.text("Home Team"), away_team=c.text("Away Team"),
        home_score=C.safe_int(c["Home Score"]), away_score=C.safe_int(c["Away Score"]),
        match_stats=present(
            {"overtime": flag("Overtime?"), "playoff": flag("Playoff Game?"), "neutral_venue": flag("Neutral Venue?")}
            | {key(n): c.number(n) for n in closing} | {f"{short(t)}_close": c.number(f"{t} Close") for t in totals}
        ),
        odds=present({key(f"{s} Odds {v}"): c.number(f"{s} Odds {v}") for s in ("Home", "Away") for v in VARIANTS}),
        betting_lines=present(
            {key(n): c.number(n) for s in ("Home", "Away") for v in VARIANTS for n in (f"{s} Line {v}", f"{s} Line Odds {v}")}
            | {f"{short(t)}_{v.lower()}": c.number(f"{t} {v}") for t in totals for v in VARIANTS}
        ),
        labels=present({"notes": c.text("Notes")}, "string"),
    )


def nhl_games(rows: DataFrame) -> DataFrame:
    """One row for each game of rows with one for each team: columns home_* and away_*.

    Games of one row are left out. Where the rows don't tell the home side, or name one side twice, the
    first two by team name are home and away; of repeated rows of a side the least by name stands.
    """
    names = [n for n in rows.columns if n not in ("game_id", "is_home")]
    flag = F.lower(C.stripped(F.col("is_home")))
    name = F.coalesce("team_name", F.lit(""))
    row = F.struct(*names)
    least = lambda on: F.min_by(row, F.when(on, name))
    games = rows.where(C.stripped(F.col("game_id")) != "").groupBy(C.stripped(F.col("game_id")).alias("game_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag.isin("1", "true")).alias("nh"), F.count_if(flag.isin("0", "false")).alias("na"),
        least(flag.isin("1", "true")).alias("h"), least(flag.isin("0", "false")).alias("a"), F.min_by(row, name).alias("first"), F.max_by(row, name).alias("last"),
    )
    told = (F.col("nh") > 0) & (F.col("na") > 0)
    sided = games.where("n > 1").select("game_id", F.when(told, F.col("h")).otherwise(F.col("first")).alias("h"), F.when(told, F.col("a")).otherwise(F.col("last")).alias("a"))
    return sided.select("game_id", *[F.col(f"h.{n}").alias(f"home_{n}") for n in names], *[F.col(f"a.{n}").alias(f"away_{n}") for n in names])


def nhl(games: DataFrame) -> DataFrame:
    """Ice hockey games of nhl_games, with the rolling and season columns that the file has."""
    h, a = Cells(games, "home_"), Cells(games, "away_")
    day = C.parsed_date(h["date"], C.MONTH_FIRST)
    sides = {"home": h, "away": a}
    stats = {f"{s}_{n}": c.number(n) for s, c in sides.items() for n in NHL_GAME}
    rolling = [f"{p}{r}_{n}" for p in ("", "opp_") for r in NHL_ROLLS for n in (*NHL_GAME, "goals_for", "goals_against")]
    advanced = {f"{s}_{n}": c.number(n) for s, c in sides.items() for n in (*NHL_SEASON, "pre_game_point_pct", *rolling, *NHL_RIVAL)}
    advanced |= {f"{s}_rest_days": c.count("rest_days") for s, c in sides.items()}
    differences = [*NHL_DIFFERENCE, *[f"{p}{r}_goal_diff" for r in NHL_ROLLS for p in ("", "opp_")]]
    return _match(
        games,
        game_id=F.col("game_id"), season=F.coalesce(h.text("season"), C.season_of(day, 7)), division=F.lit("NHL"), match_date=day,
        home_team=h.text("team_name"), away_team=a.text("team_name"), home_score=C.safe_int(h["goals_for"]), away_score=C.safe_int(a["goals_for"]),
        match_stats=present({"attendance": C.safe_int(h["attendance"])} | stats),
        betting_lines=present({k: h.number(k) for k in ("spread", "over_under", "favorite_moneyline")}),
        advanced_stats=present(advanced | {n: h.number(n) for n in differences}),
        labels=present({"venue": h.text("venue")}, "string"),
    )


def profile(rows: DataFrame, prefix: str = "") -> Column:
    """A map of every column known before the game: rolling, season and rival columns, rest days, points share."""
    c = Cells(rows, prefix)
    names = [n[len(prefix):] for n in rows.columns if n.startswith(prefix)]
    chosen = [n for n in names if n not in OUTCOMES and (n.startswith(PROFILE) or n == "pre_game_point_pct")]
    return present({n: c.number(n) for n in chosen} | ({"rest_days": c.count("rest_days")} if "rest_days" in names else {}))


def _sides(winner: Column, loser: Column, day: Column) -> Column:
    """Whether the winner is the home side: even by a hash of the match, so that reruns agree."""
    return F.pmod(F.xxhash64(winner, loser, day.cast("string")), F.lit(2)) == 0


def _tennis(rows: DataFrame, day: Column, winner: Column, loser: Column, won: Column, lost: Column, at_home: Column | None, **columns: Column) -> DataFrame:
    first = _sides(winner, loser, day) if at_home is None else at_home
    pick = lambda x, y: F.when(first, x).otherwise(y)
    prices = columns.pop("prices", {})
    odds = {f"{b}_{s}": pick(*(p if s == "home" else p[::-1])) for b, p in prices.items() for s in ("home", "away")}
    stats, labels = columns.pop("stats"), columns.pop("labels")
    return _match(
        rows,
        season=F.year(day).cast("string"), match_date=day, home_team=pick(winner, loser), away_team=pick(loser, winner),
        home_score=pick(won, lost), away_score=pick(lost, won), result=pick(F.lit("H"), F.lit("A")),
        match_stats=present({"winner_sets": won, "loser_sets": lost} | stats), odds=present(odds),
        labels=present(labels | {"actual_winner": winner, "actual_loser": loser}, "string"), **columns,
    )


def _division(tour: str, place: Column) -> Column:
    return F.concat_ws("_", F.lit(tour), place)


def tennis_sheet(rows: DataFrame, tour: str = "ATP", at_home: Column | None = None) -> DataFrame:
    """Tennis matches of a sheet of winners and losers; at_home: whether the winner is the home side."""
    c = Cells(rows := required(rows, "Winner", "Loser", "Date"))
    stats = {"best_of": C.safe_int(c["Best of"], 3)} | {f"set{i}_{s}": F.when(c.text(f"{x}{i}").isNotNull(), C.safe_int(c[f"{x}{i}"])) for i in range(1, 6) for s, x in (("winner", "W"), ("loser", "L"))}
    return _tennis(
        rows, C.parsed_date(F.substring_index(c["Date"], " ", 1), ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy")), c.text("Winner"), c.text("Loser"), C.safe_int(c["Wsets"]), C.safe_int(c["Lsets"]), at_home,
        stats=stats, division=_division(tour, c.text("Location", "Tournament")), prices={b: (c.number(w), c.number(x)) for b, (w, x) in BOOKS.items()},
        advanced_stats=present({f"{s}_{k}": c.count(f"{x}{n}") for s, x in (("winner", "W"), ("loser", "L")) for k, n in (("rank", "Rank"), ("pts", "Pts"))}),
        labels={"tournament": c.text("Tournament", "Location"), "series": c.text("Series", "Tier")} | {k.lower(): c.text(k) for k in ("Surface", "Court", "Round", "Comment")},
    )


def tennis_csv(rows: DataFrame, tour: str = "ATP", at_home: Column | None = None) -> DataFrame:
    """Tennis matches of a CSV of winners and losers with serve statistics."""
    c = Cells(rows := required(rows, "winner_name", "loser_name"))
    sets = C.set_score(c["score"])
    sides = (("winner", "w"), ("loser", "l"))
    minutes = C.safe_int(c["minutes"], -1)
    numbers = {f"{s}_{n.lower()}": c.count(f"{x}_{n}") for s, x in sides for n in SERVE}
    numbers |= {f"{s}_{n}": c.count(f"{s}_{n}") for s, _ in sides for n in ("rank", "rank_points")} | {f"{s}_age": c.number(f"{s}_age") for s, _ in sides}
    return _tennis(
        rows, C.parsed_date(c["tourney_date"], ("yyyyMMdd", "yyyy-M-d")), c.text("winner_name"), c.text("loser_name"), F.coalesce(sets["won"], F.lit(0)).cast("long"), F.coalesce(sets["lost"], F.lit(0)).cast("long"), at_home,
        stats={"best_of": C.safe_int(c["best_of"], 3), "minutes": F.when(minutes > 0, minutes), "draw_size": F.when(c.text("draw_size").isNotNull(), C.safe_int(c["draw_size"]))},
        division=_division(tour, c.text("tourney_name")), advanced_stats=present(numbers),
        labels={"tournament": c.text("tourney_name"), "score_raw": c.text("score")} | {k: c.text(k) for k in ("tourney_id", "surface", "round", "tourney_level")} | {f"{s}_{k}": c.text(f"{s}_{k}") for s, _ in sides for k in ("hand", "ht", "ioc")},
    )
