"""Queries over live models, values, prediction rows and training vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import odds as O
from pitchside.functions import probability as P
from pitchside.functions import registry as G
from pitchside.functions.dynamic import dynamic_features
from pitchside.functions.rowmodels import present
from pitchside.operators import learning as L
from pitchside.operators import training as T
from pitchside.plans.adapters import MATCHES, matches, table
from pitchside.plans.models import _CELLS, PAIRS, _pairs, _phi, _pmf

_SPORTS = ("football", "ice_hockey", "basketball", "american_football", "chess")


def mth_02_live_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live value by each sport's model; nothing for unknown sports, odds or priors out of range (MTH-02, MTH-09, MTH-10, MTH-11, MTH-12, MTH-15, UDF-01)."""
    k = F.col("p_partkey")
    sport = F.element_at(F.array(*map(F.lit, _SPORTS)), (k % 5 + 1).cast("int"))
    stats = present({"home_xg": F.when(k % 3 != 0, (k % 31) / 10), "away_xg": F.when(k % 4 != 1, (k % 23) / 10)})
    odds = F.when(k % 13 == 0, 1.0).when(k % 7 == 0, 150.0).otherwise(1.1 + (k % 40) / 10)
    v = G.live_value(sport, F.when(k % 29 == 0, 1.5).otherwise((k % 99 + 1) / 100), k % 4, k % 3, (k % 95).cast("double"), odds, F.col("stats"))
    rows = table(spark, sf_dir, "part").select("p_partkey", stats.alias("stats"))
    # a generator computes a value once; a filter would compute it again for the columns
    return rows.select("p_partkey", sport.alias("sport"), F.inline(F.array_compact(F.array(v)))).select("p_partkey", "sport", "prob", "implied", "edge", "ev")


def mth_03_ml_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of each selection by a model's probabilities; where there is no model the odds' own (MTH-03)."""
    model = P.dixon_coles(F.col("rh"), F.col("ra"))
    rows = _pairs(spark, sf_dir).withColumn("s", F.when(F.col("a") % 3 != 0, model))
    odds = {"home": 1.5 + F.col("a") * 0.1, "draw": F.when(F.col("b") % 2 == 0, F.lit(3.2)), "away": 1.8 + F.col("b") * 0.1}
    one = [F.when(o.isNotNull(), F.struct(F.lit(n).alias("selection"), o.alias("odds"), F.coalesce(F.col(f"s.{n}"), 1 / o).alias("p"), F.when(F.col("s").isNull(), "analytical").otherwise("model").alias("source"))) for n, o in odds.items()]
    each = rows.select("a", "b", F.explode(F.array_compact(F.array(*one))).alias("x"))
    return each.withColumn("v", G.value(F.col("x.p"), F.col("x.odds"))).select("a", "b", "x.selection", "x.source", "v.prob", "v.ev")


def mth_18_prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each market, selection and line with valid odds: probability, implied, edge, value (MTH-18)."""
    a, b = F.col("a"), F.col("b")
    rows = _pairs(spark, sf_dir).withColumn("s", P.dixon_coles(F.col("rh"), F.col("ra")))
    winner = {"home": 1.5 + a * 0.1, "draw": F.when(b % 2 == 0, 3.2).otherwise(1.0), "away": F.when(a % 4 != 0, 1.8 + b * 0.1)}
    offers = [("match_winner", n, F.col(f"s.{n}"), o) for n, o in winner.items()]
    for line in (1.5, 2.5):
        over = P.poisson_over(F.col("rh"), F.col("ra"), line)
        offers += [("over_under", f"over_{line}", over, 1.7 + b * 0.01), ("over_under", f"under_{line}", 1 - over, F.when(b % 3 == 0, 2.1))]
    one = [F.when((o > 1) & (p > 0), F.struct(F.lit(m).alias("market"), F.lit(n).alias("selection"), O.clipped(p).alias("prob"), (1 / o).alias("implied"), (p - 1 / o).alias("edge"), O.expected_value(p, o).alias("ev"))) for m, n, p, o in offers]
    each = rows.select("a", "b", F.explode(F.array_compact(F.array(*one))).alias("x"))
    return each.select("a", "b", "x.market", "x.selection", *[F.round(f"x.{c}", 5).alias(c) for c in ("prob", "implied", "edge", "ev")])


def mth_10_hockey_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round(P.hockey_over(F.col("rh") + 1, F.col("ra") + 1), 6).alias("over"))


def _played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches between two teams (the tables pair some with themselves)."""
    return matches(spark, sf_dir).where("home <> away")


def ml_01_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set: as-of rolling means of both sides, rest, differences, last meetings, label (ML-01, MTH-20, FLT-11)."""
    return T.training_set(_played(spark, sf_dir)).select("match_id", *T.COLUMNS, "label", "goals")


def ml_02_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the matches without a score (ML-02)."""
    open_ = _played(spark, sf_dir).where("home_score is null").select("match_id")
    return T.vectors(_played(spark, sf_dir)).join(open_, "match_id", "left_semi").select("match_id", *T.COLUMNS)


def mth_20_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of whatever statistics two profiles have, one row for each (MTH-20)."""
    m = matches(spark, sf_dir)

    def profile(t) -> object:
        return present(
            {"roll_3_goals": F.when(t % 3 != 0, t % 5), "roll_5_shots": F.when(t % 4 == 1, t % 7), "win_pct": (t % 10) / 10, "games": F.when(t % 2 == 0, t % 9), "elo_rating": 1500 + t % 50, "age": F.when(t % 5 != 0, 20 + t % 15)}
        )

    f = dynamic_features(profile(F.col("home")), profile(F.col("away")), tennis=True)
    return m.select("match_id", F.explode(f).alias("name", "value")).select("match_id", "name", F.round("value", 6).alias("value"))


def agg_27_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and root mean squared error of a naive forecast, by league (AGG-27)."""
    m = matches(spark, sf_dir).where("home_score is not null")
    accuracy, rmse = L.scores(F.col("match_id") % 4, F.col("home_score"))
    return m.groupBy("league").agg(F.round(accuracy, 6).alias("accuracy"), F.round(rmse, 6).alias("rmse"))


def join_24_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small dimension beside a large table, and prices within bounds of a theta join that stays by key (JOIN-24)."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_acctbal")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return c.join(o, (c["c_custkey"] == o["c_custkey"]) & (o["o_totalprice"] > 20 * c["c_acctbal"])).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (mth_02_live_value, mth_03_ml_value, mth_18_prediction_rows, mth_10_hockey_over, ml_01_training_set, ml_02_vectors, mth_20_dynamic, agg_27_scores, join_24_dimension)}

_SIDES = ", ".join(f"coalesce(round(avg({v}) OVER (PARTITION BY team ORDER BY nth RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING), 4), 0)::DOUBLE AS {v}_{n}" for n in T.SIZES for v in T.VALUES)
_VECTORS = f"""{MATCHES.replace("FROM orders", "FROM orders WHERE o_custkey <> (o_custkey * 7 + o_orderkey) % 40")},
long AS (
  SELECT match_id, scheduled_at, 'h' AS side, home AS team, home_score AS scored, away_score AS conceded, CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 WHEN home_score < away_score THEN 0 END AS points FROM matches
  UNION ALL
  SELECT match_id, scheduled_at, 'a', away, away_score, home_score, CASE WHEN away_score > home_score THEN 3 WHEN home_score = away_score THEN 1 WHEN away_score < home_score THEN 0 END FROM matches),
nthed AS (SELECT *, count(scored) OVER w AS nth, max(CASE WHEN scored IS NOT NULL THEN scheduled_at::DATE END) OVER w AS last_day FROM long
  WINDOW w AS (PARTITION BY team ORDER BY scheduled_at, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
known AS (SELECT match_id, side, nth::DOUBLE AS games, coalesce(scheduled_at::DATE - last_day, 7)::DOUBLE AS rest, {_SIDES} FROM nthed),
met0 AS (SELECT *, least(home, away) AS p, greatest(home, away) AS q, CASE WHEN home_score > away_score THEN home WHEN home_score < away_score THEN away WHEN home_score IS NOT NULL THEN -1 END AS winner FROM matches),
met1 AS (SELECT *, count(winner) OVER (PARTITION BY p, q ORDER BY scheduled_at, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nth FROM met0),
met2 AS (SELECT match_id, home, list_filter(coalesce(list(winner) OVER (PARTITION BY p, q ORDER BY nth RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), []), lambda x: x IS NOT NULL) AS w FROM met1),
vectors AS (SELECT h.match_id, {", ".join(f"h.{c} AS h_{c}, a.{c} AS a_{c}, round(h.{c} - a.{c}, 4) AS d_{c}" for c in T.SIDE)},
  len(w)::DOUBLE AS meetings, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: x = m.home)) / len(w), 4) ELSE 0 END::DOUBLE AS meeting_win_share
  FROM known h JOIN known a ON h.match_id = a.match_id AND h.side = 'h' AND a.side = 'a' JOIN met2 m ON m.match_id = h.match_id)"""
_EACH = ", ".join(T.COLUMNS)
_LIVE = f"""t AS (SELECT p_partkey AS k, p_partkey % 5 AS s, CASE WHEN p_partkey % 29 = 0 THEN 1.5 ELSE (p_partkey % 99 + 1)::DOUBLE / 100 END::DOUBLE AS p, p_partkey % 4 AS h, p_partkey % 3 AS w, (p_partkey % 95)::DOUBLE AS clock,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 2.5 ELSE 1.1::DOUBLE + (p_partkey % 40)::DOUBLE / 10 END::DOUBLE AS odds,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 1 THEN (p_partkey % 31)::DOUBLE / 10 END AS hx, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 1 THEN (p_partkey % 23)::DOUBLE / 10 END AS ax FROM part),
u AS (SELECT *, greatest(0.0::DOUBLE, 90 - clock) / 90 AS fs, clock / 90 AS fe, greatest(0.0::DOUBLE, 60 - clock) / 60 AS hs, clock / 60 AS he, greatest(0.1::DOUBLE, -ln(1 - least(p, 0.99)) * 2.5) AS own FROM t),
r AS (SELECT *,
  greatest(fs * CASE WHEN hx IS NOT NULL AND fe > 0.05 THEN fe * least(hx / fe, 5) + (1 - fe) * 1.45 ELSE 1.45 END, 0.01)::DOUBLE AS fh, greatest(fs * CASE WHEN hx IS NOT NULL AND fe > 0.05 THEN fe * least(ax / fe, 5) + (1 - fe) * 1.15 ELSE 1.15 END, 0.01)::DOUBLE AS fa,
  (hs * CASE WHEN hx IS NOT NULL THEN CASE WHEN he > 0.05 THEN least(hx / he, 8) ELSE hx END ELSE own END)::DOUBLE AS hh, (hs * CASE WHEN hx IS NOT NULL THEN CASE WHEN he > 0.05 THEN least(ax / he, 8) ELSE ax END ELSE greatest(0.1, 0.85 * own) END)::DOUBLE AS ha FROM u),
f AS (SELECT k, sum({_pmf("i", "fh")} * {_pmf("j", "fa")}) FILTER (h + i > w + j) AS ahead FROM r, range(0, 11) x(i), range(0, 11) y(j) WHERE s = 0 GROUP BY k),
g AS (SELECT k, sum({_pmf("i", "hh")} * {_pmf("j", "ha")} * CASE WHEN h + i > w + j THEN 1.0::DOUBLE WHEN h + i = w + j THEN 0.52::DOUBLE ELSE 0 END) AS ahead FROM r, range(0, 13) x(i), range(0, 13) y(j) WHERE s = 1 GROUP BY k)"""


def _normal(total: str, sd: str) -> str:
    share = f"(greatest({total}::DOUBLE - clock, 0.000001) / {total})"
    z = f"((h - w + (p - 0.5) * 2 * {sd}::DOUBLE * {share}) / ({sd}::DOUBLE * sqrt({share})))"
    return f"CASE WHEN clock >= {total} THEN CASE WHEN h > w THEN 1.0::DOUBLE WHEN h < w THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END ELSE {_phi(z)} END"


def _stat(key: str, t: str) -> str:
    return {
        "roll_3_goals": f"CASE WHEN {t} % 3 <> 0 THEN {t} % 5 END", "roll_5_shots": f"CASE WHEN {t} % 4 = 1 THEN {t} % 7 END", "win_pct": f"({t} % 10)::DOUBLE / 10",
        "games": f"CASE WHEN {t} % 2 = 0 THEN {t} % 9 END", "elo_rating": f"1500 + {t} % 50", "age": f"CASE WHEN {t} % 5 <> 0 THEN 20 + {t} % 15 END",
    }[key]


_STATS = ("roll_3_goals", "roll_5_shots", "win_pct", "games", "age")
_BOTH = [f"SELECT match_id, '{k}' AS k, ({_stat(k, 'home')})::DOUBLE AS x, ({_stat(k, 'away')})::DOUBLE AS y FROM matches" for k in _STATS]
_DYNAMIC = f"""WITH {MATCHES}, b AS (SELECT match_id, k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM ({" UNION ALL ".join(_BOTH)}) WHERE x IS NOT NULL OR y IS NOT NULL)
SELECT match_id, 'h_' || k AS name, round(x, 6) AS value FROM b UNION ALL SELECT match_id, 'a_' || k, round(y, 6) FROM b
UNION ALL SELECT match_id, 'diff_' || k, round(x - y, 6) FROM b WHERE k LIKE 'roll_%' OR k = 'win_pct'
UNION ALL SELECT match_id, 'age_diff', (({_stat("age", "home")}) - ({_stat("age", "away")}))::DOUBLE FROM matches WHERE home % 5 <> 0 AND away % 5 <> 0
UNION ALL SELECT match_id, 'h_elo_rating', (1500 + home % 50)::DOUBLE FROM matches UNION ALL SELECT match_id, 'a_elo_rating', (1500 + away % 50)::DOUBLE FROM matches
UNION ALL SELECT match_id, 'elo_diff', (home % 50 - away % 50)::DOUBLE FROM matches
UNION ALL SELECT match_id, unnest(['h_hand', 'a_hand', 'hand_matchup']), 0.0::DOUBLE FROM matches"""
SQL = {
    "mth_02_live_value": f"""WITH {_LIVE}, q AS (SELECT r.*, CASE s WHEN 0 THEN CASE WHEN fs <= 0 THEN (h > w)::INT::DOUBLE ELSE coalesce(f.ahead, 0) END
  WHEN 1 THEN CASE WHEN hs <= 0 THEN CASE WHEN h > w THEN 1.0::DOUBLE WHEN h < w THEN 0.0::DOUBLE ELSE 0.52::DOUBLE END ELSE g.ahead END WHEN 2 THEN {_normal("48", "12")} WHEN 3 THEN {_normal("60", "13.5")} END AS live
  FROM r LEFT JOIN f ON r.k = f.k LEFT JOIN g ON r.k = g.k),
c AS (SELECT *, least(greatest(live, 0), 1)::DOUBLE AS x FROM q WHERE s < 4 AND p <= 1 AND odds IS NOT NULL)
SELECT k AS p_partkey, CASE s WHEN 0 THEN 'football' WHEN 1 THEN 'ice_hockey' WHEN 2 THEN 'basketball' ELSE 'american_football' END AS sport,
  round(x, 6) AS prob, round(1 / odds, 6) AS implied, round(x - 1 / odds, 6) AS edge, round(x * (odds - 1) - (1 - x), 6) AS ev FROM c""",
    "mth_03_ml_value": f"""WITH {_CELLS}, d AS (SELECT a, b, sum(m) FILTER (i > j) / sum(m) AS h, sum(m) FILTER (i = j) / sum(m) AS x, sum(m) FILTER (i < j) / sum(m) AS w FROM cells GROUP BY a, b),
o AS (SELECT a, b, 'home' AS selection, 1.5::DOUBLE + a * 0.1::DOUBLE AS odds, h AS p FROM d UNION ALL SELECT a, b, 'draw', 3.2::DOUBLE, x FROM d WHERE b % 2 = 0 UNION ALL SELECT a, b, 'away', 1.8::DOUBLE + b * 0.1::DOUBLE, w FROM d),
q AS (SELECT a, b, selection, odds, a % 3 <> 0 AS has, CASE WHEN a % 3 <> 0 THEN p ELSE 1 / odds END AS p FROM o)
SELECT a, b, selection, CASE WHEN has THEN 'model' ELSE 'analytical' END AS source, round(p, 6) AS prob, round(p * (odds - 1) - (1 - p), 6) AS ev FROM q""",
    "mth_18_prediction_rows": f"""WITH {_CELLS}, d AS (SELECT a, b, sum(m) FILTER (i > j) / sum(m) AS h, sum(m) FILTER (i = j) / sum(m) AS x, sum(m) FILTER (i < j) / sum(m) AS w FROM cells GROUP BY a, b),
g AS (SELECT a, b, 1 - ({' + '.join(_pmf(str(k), 'rh + ra') for k in range(2))}) AS o1, 1 - ({' + '.join(_pmf(str(k), 'rh + ra') for k in range(3))}) AS o2 FROM pairs),
o AS (SELECT a, b, 'match_winner' AS market, 'home' AS selection, 1.5::DOUBLE + a * 0.1::DOUBLE AS odds, h AS p FROM d UNION ALL SELECT a, b, 'match_winner', 'draw', 3.2::DOUBLE, x FROM d WHERE b % 2 = 0
  UNION ALL SELECT a, b, 'match_winner', 'away', 1.8::DOUBLE + b * 0.1::DOUBLE, w FROM d WHERE a % 4 <> 0
  UNION ALL SELECT a, b, 'over_under', 'over_1.5', 1.7::DOUBLE + b * 0.01::DOUBLE, o1 FROM g UNION ALL SELECT a, b, 'over_under', 'under_1.5', 2.1::DOUBLE, 1 - o1 FROM g WHERE b % 3 = 0
  UNION ALL SELECT a, b, 'over_under', 'over_2.5', 1.7::DOUBLE + b * 0.01::DOUBLE, o2 FROM g UNION ALL SELECT a, b, 'over_under', 'under_2.5', 2.1::DOUBLE, 1 - o2 FROM g WHERE b % 3 = 0)
SELECT a, b, market, selection, round(least(greatest(p, 1e-6), 1 - 1e-6), 5) AS prob, round(1 / odds, 5) AS implied, round(p - 1 / odds, 5) AS edge, round(p * (odds - 1) - (1 - p), 5) AS ev FROM o WHERE p > 0""",
    "mth_10_hockey_over": f"WITH {PAIRS} SELECT a, b, round(1 - ({' + '.join(_pmf(str(k), '(rh + ra + 2)') for k in range(6))}), 6) AS over FROM pairs",
    "ml_01_training_set": f"""WITH {_VECTORS} SELECT v.match_id, {_EACH}, CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END::DOUBLE AS label, (home_score + away_score)::DOUBLE AS goals
FROM vectors v JOIN matches m ON v.match_id = m.match_id WHERE home_score IS NOT NULL AND h_games >= 3 AND a_games >= 3""",
    "ml_02_vectors": f"WITH {_VECTORS} SELECT v.match_id, {_EACH} FROM vectors v JOIN matches m ON v.match_id = m.match_id WHERE home_score IS NULL",
    "mth_20_dynamic": _DYNAMIC,
    "agg_27_scores": f"WITH {MATCHES} SELECT league, round(avg((match_id % 4 = home_score)::INT), 6) AS accuracy, round(sqrt(avg(pow(match_id % 4 - home_score, 2))), 6) AS rmse FROM matches WHERE home_score IS NOT NULL GROUP BY league",
    "join_24_dimension": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey AND o_totalprice > 20 * c_acctbal GROUP BY n_name",
}
