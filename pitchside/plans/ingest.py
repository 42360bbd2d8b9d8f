"""Queries over rows of sports files: orders written as the cells of such files, and what the row models make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import rowmodels as R
from pitchside.operators import upkeep as U
from pitchside.plans.adapters import table
from pitchside.sources import stats as S


def _orders(spark: SparkSession, sf_dir: str, **cells: Column) -> DataFrame:
    """Cells as texts, k the order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), *[c.cast("string").alias(n.replace("_0_", " ")) for n, c in cells.items()])


def _keys() -> tuple[Column, Column, Column]:
    """The order, its customer and its day."""
    return F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")


def _date() -> Column:
    """ISO, month first, or no date."""
    k, _, day = _keys()
    return F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "MM/dd/yyyy")).otherwise("")


def _at(m: str, key: str, name: str | None = None) -> Column:
    return F.try_element_at(m, F.lit(key)).alias(name or key)


def prj_12_nba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basketball rows: quarters, lines, moneylines and seasons stated in several ways (PRJ-12, SRC-06)."""
    k, c, _ = _keys()
    season = F.when(k % 4 == 0, "").when(k % 4 == 1, "2024-25").when(k % 4 == 2, "2023.0").otherwise("nan")
    rows = _orders(
        spark, sf_dir, home=F.concat(F.lit(" H"), k), away=F.concat(F.lit("A"), c), date=_date(), season=season, q1_home=k % 37, q1_away=F.when(k % 5 != 0, c % 31),
        ot_home=F.lit("-1"), score_home=k % 120, score_away=c % 120, spread=F.concat((k % 20 - 10).cast("string"), F.lit(".5")), moneyline_home=F.when(k % 2 == 0, "1.9").otherwise("x"), whos_favored=F.lit(" home "),
    )
    return R.nba(rows).select(
        "home_team", "season", F.col("match_date").cast("timestamp_ntz").alias("day"), "home_score", "away_score", "result", F.size("match_stats").alias("n_stats"),
        _at("match_stats", "q1_home"), F.coalesce(_at("match_stats", "q1_away"), F.lit(-1.0)).alias("q1_away"), _at("betting_lines", "spread"), F.coalesce(_at("odds", "moneyline_home"), F.lit(0.0)).alias("moneyline"), _at("labels", "favored"),
    )


def prj_13_nfl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """American football rows: flags and opening to closing lines (PRJ-13)."""
    k, c, day = _keys()
    n = lambda m: (k % m).cast("double") / 10 + 1
    rows = _orders(
        spark, sf_dir, Home_0_Team=F.concat(F.lit("H"), k), Away_0_Team=F.concat(F.lit("A"), c), Date=F.when(k % 3 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00:00"))).otherwise(_date()),
        Home_0_Score=k % 45, Away_0_Score=c % 45, Home_0_Odds_0_Open=n(7), Home_0_Odds_0_Close=n(9), Away_0_Line_0_Close=F.when(k % 2 == 0, n(11)), Total_0_Score_0_Close=n(400), Total_0_Score_0_Over_0_Close=n(13),
        source_file=F.when(k % 8 == 0, F.concat(F.lit("nfl_"), F.year(day).cast("string"), F.lit(".csv"))).otherwise("games.csv"),
    ).withColumn("Overtime?", F.when(F.col("k") % 5 == 0, "Yes").otherwise("no"))
    return R.nfl(rows).select(
        "home_team", "season", "home_score", "away_score", "result", _at("odds", "home_odds_open"), _at("match_stats", "home_odds_close"), F.coalesce(_at("match_stats", "away_line_close"), F.lit(0.0)).alias("away_line_close"),
        _at("betting_lines", "total_close"), _at("match_stats", "total_over_close"), F.coalesce(_at("match_stats", "overtime"), F.lit(0.0)).alias("overtime"), F.size("match_stats").alias("n_stats"),
    )


def _hockey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each game; every seventh has one only, every eleventh doesn't tell the home side."""
    k, c, day = _keys()
    side = F.explode(F.when(k % 7 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
    o = table(spark, sf_dir, "orders").select("*", side.alias("side"))
    home = F.col("side") == 1
    return o.select(
        F.concat(F.lit("g"), k).alias("game_id"), F.when(k % 11 == 0, "").when(home, "True").otherwise("0").alias("is_home"), F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.when(home, F.concat(F.lit("H"), k)).otherwise(F.concat(F.lit("K"), c)).alias("team_name"), F.when(home, k % 6).otherwise(c % 6).cast("string").alias("goals_for"),
        (20 + F.col("side") + k % 15).cast("string").alias("shots"), F.when(k % 2 == 0, (k % 9).cast("string")).alias("roll_3_shots"), (k % 9 - 1).cast("string").alias("rest_days"),
        (k % 8).cast("string").alias("over_under"), F.lit("Hall").alias("venue"), (c % 50).cast("string").alias("season_wins"),
    )


def prj_14_nhl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ice hockey games out of two rows each (PRJ-14, JOIN-20)."""
    return R.nhl(R.nhl_games(_hockey(spark, sf_dir))).select(
        "game_id", "season", "home_team", "away_team", "home_score", "away_score", "result", _at("match_stats", "home_shots"), F.coalesce(_at("advanced_stats", "away_roll_3_shots"), F.lit(-1.0)).alias("roll"),
        F.coalesce(_at("advanced_stats", "home_rest_days"), F.lit(-1.0)).alias("rest"), _at("betting_lines", "over_under"), F.size("advanced_stats").alias("n_advanced"),
    )


def prj_17_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of a team's row that was known before the game (PRJ-17)."""
    rows = _hockey(spark, sf_dir)
    return rows.select("game_id", "team_name", R.profile(rows).alias("p")).select("game_id", "team_name", F.array_join(F.array_sort(F.map_keys("p")), ",").alias("keys"), F.aggregate(F.map_values("p"), F.lit(0.0), lambda a, x: a + x).alias("total"))


def prj_15_tennis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tennis rows of sheets and of CSV files, sides dealt evenly (PRJ-15, SRC-03, SRC-04)."""
    k, c, day = _keys()
    sheet = _orders(
        spark, sf_dir, Winner=F.concat(F.lit("W"), k), Loser=F.concat(F.lit("L"), c), Date=F.date_format(day, "dd/MM/yyyy"), Wsets=F.lit("2"), Lsets=k % 2, W1=F.lit("6"), L1=k % 5,
        Location=F.when(k % 3 == 0, "Rome"), Surface=F.lit("Clay "), WRank=F.when(k % 4 != 0, k % 100), B365W=F.lit("1.5"), B365L=F.lit("2.6"),
    )
    csv = _orders(
        spark, sf_dir, winner_name=F.concat(F.lit("W"), k), loser_name=F.concat(F.lit("L"), c), tourney_date=F.date_format(day, "yyyyMMdd"), score=F.when(k % 2 == 0, "6-4 7-6(3)").otherwise("4-6 6-3 6-0"),
        tourney_name=F.lit("Paris"), w_ace=k % 20, l_ace=F.when(k % 3 == 0, c % 20), minutes=k % 200, winner_hand=F.lit("R"), best_of=F.lit("x"),
    )
    home = F.col("k") % 2 == 0
    pick = ["home_team", "division", "season", "home_score", "away_score", "result"]
    a = R.tennis_sheet(sheet, "ATP", home).select(*pick, F.lit("sheet").alias("form"), F.size("match_stats").alias("n_stats"), F.coalesce(_at("odds", "b365_home"), F.lit(0.0)).alias("odds_home"), F.coalesce(_at("advanced_stats", "winner_rank"), F.lit(-1.0)).alias("number"), _at("labels", "actual_winner"))
    b = R.tennis_csv(csv, "ATP", home).select(*pick, F.lit("csv").alias("form"), F.size("match_stats").alias("n_stats"), F.lit(0.0).alias("odds_home"), F.coalesce(_at("advanced_stats", "loser_ace"), F.lit(-1.0)).alias("number"), _at("labels", "actual_winner"))
    return a.unionByName(b)


def prj_34_json_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of JSON responses of four sports (PRJ-34)."""
    k, _, _ = _keys()
    n = lambda m: (k % m).cast("string")
    team = lambda a, b: F.concat(F.lit('{"statistics":[{"type":"Shots on Goal","value":'), a, F.lit('},{"type":"Ball Possession","value":"'), b, F.lit('%"},{"type":"Odd","value":1},{"type":"Fouls","value":null}]}'))
    football = F.concat(F.lit("["), team(n(9), n(60)), F.lit(","), team(n(7), n(40)), F.lit("]"))
    points = F.concat(F.lit('[{"scores":{"home":{"quarter_1":'), n(30), F.lit(',"over_time":null,"total":'), n(120), F.lit('},"away":{"quarter_4":'), n(25), F.lit(',"total":'), n(110), F.lit("}}}]"))
    hockey = F.concat(F.lit('[{"scores":{"home":'), n(6), F.lit(',"away":'), n(5), F.lit('},"periods":{"first":{"home":1,"away":'), n(3), F.lit('},"overtime":null}}]'))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), S.football_json(football).alias("f"), S.points_json(points).alias("b"), S.points_json(points, "overtime").alias("u"), S.hockey_json(hockey).alias("h"))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("long").cast("string"))), ",")
    return rows.select("k", flat("f").alias("football"), flat("b").alias("basketball"), flat("u").alias("american_football"), flat("h").alias("hockey"))


def prj_36_html_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of teams out of HTML tables with repeated headers and odd cells (PRJ-36, UDF-03)."""
    k, _, _ = _keys()
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    page = F.concat(
        F.lit("<html><table></table><table><tr><th>Squad</th><th>xG</th><th>Poss</th><th>Pts</th></tr><tr>"), cell(F.concat(F.lit("Team "), k)), cell((k % 30) / 10), cell(F.concat((k % 100).cast("string"), F.lit("%"))), cell(F.lit("n/a")),
        F.lit("</tr><tr><th>Squad</th><th>xG</th></tr><tr><td>Other</td></tr></table></html>"),
    )
    pages = table(spark, sf_dir, "orders").select(k.alias("k"), page.alias("page"))
    return S.PARSERS.get("football")(pages, "page").select("k", "team", F.size("stats").alias("n_stats"), _at("stats", "xg"), _at("stats", "possession_pct"))


#: Headers of a table of each sport: the name and two numbers.
_TABLES = {
    "football": ("Squad", "xG against", "Poss"), "basketball": ("Team", "ORtg", "3P%"), "ice_hockey": ("Team", "Corsi%", "SV%"), "american_football": ("Tm", "PTS", "Y/P"), "tennis": ("Player", "Ace%", "1stIn%"),
}


def prj_36_sports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of five sports by the parser of each: marks, average rows and repeated headers out (PRJ-36, UDF-03)."""
    k, _, _ = _keys()
    sport = F.element_at(F.array(*[F.lit(x) for x in _TABLES]), (k % len(_TABLES) + 1).cast("int"))
    row = lambda *cells: F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c.cast("string"), F.lit("</td>"))], F.lit("</tr>"))
    head = F.element_at(F.create_map(*[F.lit(x) for s, h in _TABLES.items() for x in (s, "<tr>" + "".join(f"<th>{c}</th>" for c in h) + "</tr>")]), sport)
    name = F.concat(F.lit("Team "), k, F.when(k % 2 == 0, "*").otherwise(""))
    page = F.concat(F.lit("<table>"), head, row(name, (k % 30) / 10, F.concat((k % 90).cast("string"), F.lit("%"))), head, row(F.lit("League Average"), F.lit(1), F.lit(2)), F.lit("</table>"))
    pages = table(spark, sf_dir, "orders").select(k.alias("k"), sport.alias("sport"), page.alias("page"))
    return S.page_stats(pages, "sport", "page").where("team <> 'League Average'").select("k", "sport", "team", F.explode("stats").alias("name", "value"))


def flt_13_any_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with a half-time value, by sport; a sport without such keys always has one (FLT-13)."""
    k, _, _ = _keys()
    stats = R.present({"ht_home": F.when(k % 3 == 0, k % 4), "ht_away": F.when(k % 5 == 0, k % 3), "shots": k % 20})
    has = lambda keys: U.any_split(F.col("stats"), keys)
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), stats.alias("stats"))
    return rows.select("k", has(("ht_home", "ht_away")).alias("football"), has(()).alias("darts"))


QUERIES = {f.__name__: f for f in (prj_12_nba, prj_13_nfl, prj_14_nhl, prj_15_tennis, prj_17_profile, prj_34_json_stats, prj_36_html_stats, prj_36_sports, flt_13_any_split)}

_O = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS day FROM orders)"
_SEASON = "(CASE WHEN month(day) >= 7 THEN year(day) || '-' || lpad(((year(day) + 1) % 100)::VARCHAR, 2, '0') ELSE (year(day) - 1) || '-' || lpad((year(day) % 100)::VARCHAR, 2, '0') END)"
_RESULT = "CASE WHEN hs > aw THEN 'H' WHEN aw > hs THEN 'A' ELSE 'D' END"
SQL = {
    "prj_12_nba": f"""WITH {_O}, r AS (SELECT *, k % 120 AS hs, c % 120 AS aw FROM o WHERE k % 3 <> 2)
SELECT 'H' || k AS home_team, CASE k % 4 WHEN 1 THEN '2024-25' WHEN 2 THEN '2023-24' ELSE {_SEASON} END AS season, day::TIMESTAMP AS day, hs AS home_score, aw AS away_score, {_RESULT} AS result,
  CASE WHEN k % 5 <> 0 THEN 2 ELSE 1 END::INT AS n_stats, (k % 37)::DOUBLE AS q1_home, CASE WHEN k % 5 <> 0 THEN c % 31 ELSE -1 END::DOUBLE AS q1_away,
  ((k % 20 - 10) || '.5')::DOUBLE AS spread, CASE WHEN k % 2 = 0 THEN 1.9 ELSE 0 END::DOUBLE AS moneyline, 'home' AS favored FROM r""",
    "prj_13_nfl": f"""WITH {_O}, r AS (SELECT *, k % 45 AS hs, c % 45 AS aw FROM o WHERE k % 3 <> 2)
SELECT 'H' || k AS home_team, CASE WHEN k % 8 = 0 AND year(day) >= 2000 THEN year(day) || '-' || lpad(((year(day) + 1) % 100)::VARCHAR, 2, '0') ELSE {_SEASON} END AS season, hs AS home_score, aw AS away_score, {_RESULT} AS result, (k % 7)::DOUBLE / 10 + 1 AS home_odds_open, (k % 9)::DOUBLE / 10 + 1 AS home_odds_close,
  CASE WHEN k % 2 = 0 THEN (k % 11)::DOUBLE / 10 + 1 ELSE 0 END AS away_line_close, (k % 400)::DOUBLE / 10 + 1 AS total_close, (k % 13)::DOUBLE / 10 + 1 AS total_over_close,
  CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END::DOUBLE AS overtime, (3 + (k % 2 = 0)::INT + (k % 5 = 0)::INT)::INT AS n_stats FROM r""",
    "prj_14_nhl": f"""WITH {_O}, r AS (SELECT *, k % 6 AS hs, c % 6 AS aw FROM o WHERE k % 7 <> 0)
SELECT 'g' || k AS game_id, {_SEASON} AS season, 'H' || k AS home_team, 'K' || c AS away_team, hs AS home_score, aw AS away_score, {_RESULT} AS result, (21 + k % 15)::DOUBLE AS home_shots,
  CASE WHEN k % 2 = 0 THEN k % 9 ELSE -1 END::DOUBLE AS roll, CASE WHEN k % 9 >= 1 THEN k % 9 - 1 ELSE -1 END::DOUBLE AS rest, (k % 8)::DOUBLE AS over_under,
  (2 + 2 * (k % 2 = 0)::INT + 2 * (k % 9 >= 1)::INT)::INT AS n_advanced FROM r""",
    "prj_15_tennis": f"""WITH {_O}
SELECT CASE WHEN k % 2 = 0 THEN 'W' || k ELSE 'L' || c END AS home_team, CASE WHEN k % 3 = 0 THEN 'ATP_Rome' ELSE 'ATP' END AS division, year(day)::VARCHAR AS season,
  CASE WHEN k % 2 = 0 THEN 2 ELSE k % 2 END AS home_score, CASE WHEN k % 2 = 0 THEN k % 2 ELSE 2 END AS away_score, CASE WHEN k % 2 = 0 THEN 'H' ELSE 'A' END AS result, 'sheet' AS form, 5::INT AS n_stats,
  CASE WHEN k % 2 = 0 THEN 1.5 ELSE 2.6 END::DOUBLE AS odds_home, CASE WHEN k % 4 <> 0 THEN k % 100 ELSE -1 END::DOUBLE AS number, 'W' || k AS actual_winner FROM o
UNION ALL
SELECT CASE WHEN k % 2 = 0 THEN 'W' || k ELSE 'L' || c END, 'ATP_Paris', year(day)::VARCHAR, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END, CASE WHEN k % 2 = 0 THEN 0 ELSE 2 END, CASE WHEN k % 2 = 0 THEN 'H' ELSE 'A' END, 'csv',
  (3 + (k % 200 > 0)::INT)::INT, 0::DOUBLE, CASE WHEN k % 3 = 0 THEN c % 20 ELSE -1 END::DOUBLE, 'W' || k FROM o""",
    "prj_17_profile": f"""WITH {_O}, s AS (SELECT *, unnest(CASE WHEN k % 7 = 0 THEN [1] ELSE [0, 1] END) AS side FROM o)
SELECT 'g' || k AS game_id, CASE WHEN side = 1 THEN 'H' || k ELSE 'K' || c END AS team_name,
  array_to_string(list_filter([CASE WHEN k % 9 >= 1 THEN 'rest_days' END, CASE WHEN k % 2 = 0 THEN 'roll_3_shots' END, 'season_wins'], lambda x: x IS NOT NULL), ',') AS keys,
  (CASE WHEN k % 9 >= 1 THEN k % 9 - 1 ELSE 0 END + CASE WHEN k % 2 = 0 THEN k % 9 ELSE 0 END + c % 50)::DOUBLE AS total FROM s""",
    "prj_34_json_stats": f"""WITH {_O} SELECT k, 'away_possession=' || k % 40 || ',away_sot=' || k % 7 || ',home_possession=' || k % 60 || ',home_sot=' || k % 9 AS football,
  'pts_away=' || k % 110 || ',pts_home=' || k % 120 || ',q1_home=' || k % 30 || ',q4_away=' || k % 25 AS basketball, 'pts_away=' || k % 110 || ',pts_home=' || k % 120 || ',q1_home=' || k % 30 || ',q4_away=' || k % 25 AS american_football,
  'goals_away=' || k % 5 || ',goals_home=' || k % 6 || ',pf_away=' || k % 3 || ',pf_home=1' AS hockey FROM o""",
    "prj_36_html_stats": f"WITH {_O} SELECT k, 'Team ' || k AS team, 2::INT AS n_stats, (k % 30)::DOUBLE / 10 AS xg, (k % 100)::DOUBLE AS possession_pct FROM o",
    "prj_36_sports": f"""WITH {_O}, s AS (SELECT k, ['football', 'basketball', 'ice_hockey', 'american_football', 'tennis'][k % 5 + 1] AS sport, k % 5 AS n FROM o)
SELECT k, sport, 'Team ' || k || CASE WHEN k % 2 = 0 AND n IN (0, 4) THEN '*' ELSE '' END AS team, unnest([['xga', 'off_rtg', 'corsi_for_pct', 'pts_for', 'ace_pct'][n + 1], ['possession_pct', 'three_pct', 'sv_pct', 'yards_per_play', 'first_serve_pct'][n + 1]]) AS name,
  unnest([(k % 30)::DOUBLE / 10, (k % 90)::DOUBLE]) AS value FROM s""",
    "flt_13_any_split": f"WITH {_O} SELECT k, k % 3 = 0 OR k % 5 = 0 AS football, true AS darts FROM o",
}
