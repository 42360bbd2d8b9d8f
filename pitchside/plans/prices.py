"""Queries over prices: latest, best, value, stakes, odds formats, combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import odds as O
from pitchside.operators import keyed
from pitchside.plans.adapters import MATCHES, PRICES, matches, prices, table

_TIES = ["scraped_at", "part", "book", "odds", "price"]


def win_06_latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest price before the start of each match and selection (WIN-06, FLT-19)."""
    offers = prices(spark, sf_dir).where(~F.col("is_live") & (F.col("odds") > 1))
    return keyed.latest_per_key(offers, ["match_id", "selection"], [F.col(c) for c in _TIES], ["odds", "book", "scraped_at"])


LATEST = f"""{PRICES},
latest AS (
  SELECT match_id, selection, odds, book, scraped_at FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id, selection ORDER BY scraped_at DESC, part DESC, book DESC, odds DESC, price DESC) AS rn
    FROM prices WHERE NOT is_live AND odds > 1) WHERE rn = 1)"""


def _probability():
    return (20 + (F.col("match_id") * 7 + F.col("selection")) % 60) / 100


P = "((20 + (match_id * 7 + selection) % 60) / 100.0::DOUBLE)"


def top_02_best_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.best_price(prices(spark, sf_dir), ["match_id", "selection"], "odds", "book")


def mth_01_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = _probability(), F.col("odds")
    return win_06_latest_price(spark, sf_dir).select(
        "match_id", "selection", "odds",
        F.round(O.implied(o), 6).alias("implied"),
        F.round(O.edge(p, o), 6).alias("edge"),
        F.round(O.expected_value(p, o), 6).alias("ev"),
        (O.expected_value(p, o) > 0).alias("is_positive"),
    )


def flt_05_positive_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mth_01_ev(spark, sf_dir).where("ev > 0.02").select("match_id", "selection", "odds", "ev")


def top_01_by_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of positive value, best first (TOP-01)."""
    return flt_05_positive_ev(spark, sf_dir).orderBy(F.desc("ev"), F.asc("match_id"), F.asc("selection"))


def top_03_apply_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = _probability(), F.col("best_odds")
    return top_02_best_price(spark, sf_dir).select(
        "match_id", "selection", "best_odds", "best_book",
        F.round(O.implied(o), 6).alias("implied"), F.round(O.edge(p, o), 6).alias("edge"), F.round(O.expected_value(p, o), 6).alias("ev"),
    )


def mth_04_kelly(spark: SparkSession, sf_dir: str) -> DataFrame:
    bankroll = (F.col("match_id") % 5) * 250.0
    k = O.kelly(_probability(), F.col("odds"), bankroll)
    return win_06_latest_price(spark, sf_dir).withColumn("k", k).select(
        "match_id", "selection", F.round("k.full", 6).alias("full_kelly"), F.col("k.stake").alias("stake"), F.coalesce("k.reason", F.lit("ok")).alias("reason")
    )


def mth_06_parlay_stake(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = O.parlay_stake(F.col("l_quantity") / 20 - 0.5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(s["stake"], 6).alias("stake"), F.coalesce(s["problem"], F.lit("")).alias("problem"))


def prj_18_odds_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_quantity") * 20 - 500
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", a.alias("american"), O.american_to_decimal(a).alias("decimal_odds"), O.normalized(a).alias("detected_odds")
    )


def flt_01_first_per_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best leg of each match, then the 20 likeliest (WIN-10, TOP-05)."""
    legs = win_06_latest_price(spark, sf_dir).withColumn("p", _probability()).where("p >= 0.3")
    one = keyed.latest_per_key(legs, ["match_id"], [F.col("p"), -F.col("selection")], ["selection", "p", "odds"])
    return keyed.top_k(one, [F.desc("p"), F.asc("match_id")], 20)


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve legs of different matches with their places."""
    pool = keyed.top_k(flt_01_first_per_match(spark, sf_dir), [F.desc("p"), F.asc("match_id")], 12)
    array = pool.agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("o"), "match_id", "selection", "p", "odds"))).alias("x"))
    leg = array.select(F.posexplode("x").alias("pos", "l")).select("pos", "l.match_id", "l.selection", "l.p", "l.odds")
    return leg.join(matches(spark, sf_dir).select("match_id", "league"), "match_id")


def join_21_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of legs with their correlation and value (JOIN-21, AGG-18)."""
    legs = _legs(spark, sf_dir)
    a, b = legs.alias("a"), legs.alias("b")
    corr = F.when(F.col("a.league") == F.col("b.league"), 0.03).otherwise(0.0)
    odds, p = F.col("a.odds") * F.col("b.odds"), F.col("a.p") * F.col("b.p") * (1 - corr)
    return a.join(b, F.col("a.pos") < F.col("b.pos")).select(
        F.col("a.match_id").alias("match_a"), F.col("b.match_id").alias("match_b"), corr.alias("correlation"),
        F.round(odds, 6).alias("parlay_odds"), F.round(p * odds - 1, 6).alias("parlay_ev"),
    )


def join_22_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of three of the pool, the ten likeliest with odds of 3 at least (JOIN-22, TOP-06)."""
    legs = _legs(spark, sf_dir)
    a, b, c = legs.alias("a"), legs.alias("b"), legs.alias("c")
    odds = F.round(F.col("a.odds") * F.col("b.odds") * F.col("c.odds"), 2)
    p = F.round(F.col("a.p") * F.col("b.p") * F.col("c.p"), 6)
    every = a.join(b, F.col("a.pos") < F.col("b.pos")).join(c, F.col("b.pos") < F.col("c.pos")).select(
        F.col("a.match_id").alias("match_a"), F.col("b.match_id").alias("match_b"), F.col("c.match_id").alias("match_c"), odds.alias("parlay_odds"), p.alias("p")
    )
    return keyed.top_k(every.where("parlay_odds >= 3.0"), [F.desc("p"), F.asc("match_a"), F.asc("match_b"), F.asc("match_c")], 10)


def set_01_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of prices, the first one wins a key (SET-01, WIN-11)."""
    rows = prices(spark, sf_dir).select("match_id", "selection", "book", "odds", "part", "price")
    sources = [rows.where(F.col("book") % 2 == i) for i in (0, 1)]
    got = keyed.union_first(sources, ["match_id", "selection"], [F.col(c) for c in ("part", "book", "odds", "price")])
    return got.select("match_id", "selection", "priority", "book", "odds")


def top_08_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest prices of the first 20 matches as one text each (TOP-08)."""
    first = keyed.top_k(matches(spark, sf_dir).where("state = 'not_started'").select("match_id", "scheduled_at"), [F.asc("scheduled_at"), F.asc("match_id")], 20)
    rows = win_06_latest_price(spark, sf_dir).join(F.broadcast(first), "match_id", "right")
    entry = F.when(F.col("selection").isNotNull(), F.struct("selection", F.format_string("%d:%.2f", "selection", "odds").alias("t")))
    return rows.groupBy("match_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), " ").alias("context"))


_EV = f"round(1 / odds, 6) AS implied, round({P} - 1 / odds, 6) AS edge, round({P} * (odds - 1) - (1 - {P}), 6) AS ev"
_POOL = f"""{LATEST}, {MATCHES},
first_legs AS (
  SELECT match_id, selection, p, odds FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, selection) AS rn
    FROM (SELECT *, {P} AS p FROM latest) WHERE p >= 0.3) WHERE rn = 1 ORDER BY p DESC, match_id LIMIT 20),
legs AS (
  SELECT row_number() OVER (ORDER BY p DESC, f.match_id) - 1 AS pos, f.*, league
  FROM (SELECT * FROM first_legs ORDER BY p DESC, match_id LIMIT 12) f JOIN matches m ON f.match_id = m.match_id)"""

QUERIES = {
    "win_06_latest_price": win_06_latest_price,
    "top_02_best_price": top_02_best_price,
    "mth_01_ev": mth_01_ev,
    "flt_05_positive_ev": flt_05_positive_ev,
    "top_01_by_ev": top_01_by_ev,
    "top_03_apply_best": top_03_apply_best,
    "mth_04_kelly": mth_04_kelly,
    "mth_06_parlay_stake": mth_06_parlay_stake,
    "prj_18_odds_decimal": prj_18_odds_decimal,
    "win_10_first_per_match": flt_01_first_per_match,
    "join_21_pairs": join_21_pairs,
    "join_22_combos": join_22_combos,
    "set_01_union_dedup": set_01_union_dedup,
    "top_08_context": top_08_context,
}
SQL = {
    "win_06_latest_price": f"WITH {LATEST} SELECT * FROM latest",
    "top_02_best_price": f"""WITH {PRICES}
SELECT match_id, selection, odds AS best_odds, book AS best_book, n AS n_offers FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id, selection ORDER BY odds DESC, book) AS rn,
         count(*) OVER (PARTITION BY match_id, selection) AS n FROM prices) WHERE rn = 1""",
    "mth_01_ev": f"WITH {LATEST} SELECT match_id, selection, odds, {_EV}, {P} * (odds - 1) - (1 - {P}) > 0 AS is_positive FROM latest",
    "flt_05_positive_ev": f"WITH {LATEST} SELECT match_id, selection, odds, ev FROM (SELECT *, {_EV} FROM latest) WHERE ev > 0.02",
    "top_01_by_ev": f"WITH {LATEST} SELECT match_id, selection, odds, ev FROM (SELECT *, {_EV} FROM latest) WHERE ev > 0.02 ORDER BY ev DESC, match_id, selection",
    "top_03_apply_best": f"""WITH {PRICES}, best AS (
  SELECT match_id, selection, max(odds) AS odds, arg_min(book, (-odds, book)) AS best_book FROM prices GROUP BY ALL)
SELECT match_id, selection, odds AS best_odds, best_book, {_EV} FROM best""",
    "mth_04_kelly": f"""WITH {LATEST}, s AS (
  SELECT match_id, selection, odds, {P} AS p, (match_id % 5) * 250.0::DOUBLE AS bankroll FROM latest),
t AS (SELECT *, p * odds - 1 AS ep, (p * odds - 1) / (odds - 1) AS f FROM s),
u AS (SELECT *, least(bankroll * f * 0.25::DOUBLE, bankroll * 0.05::DOUBLE) AS stake0 FROM t),
v AS (SELECT *, CASE WHEN ep <= 0 THEN 'negative_ev' WHEN bankroll <= 0 THEN 'zero_bankroll' WHEN stake0 < 0.10 THEN 'below_minimum_stake' ELSE 'ok' END AS reason FROM u)
SELECT match_id, selection, round(CASE WHEN ep > 0 THEN f ELSE 0 END, 6) AS full_kelly,
       CASE WHEN reason = 'ok' THEN round(stake0, 2) ELSE 0 END AS stake, reason FROM v""",
    "mth_06_parlay_stake": """SELECT l_orderkey, l_linenumber, round(CASE WHEN s <= 0 THEN 0 ELSE least(s, 1.0::DOUBLE) END, 6) AS stake,
  CASE WHEN s <= 0 THEN 'not_positive' WHEN s > 1 THEN 'capped' ELSE '' END AS problem
FROM (SELECT *, l_quantity / 20 - 0.5 AS s FROM lineitem)""",
    "prj_18_odds_decimal": """SELECT l_orderkey, l_partkey, a AS american,
  round(CASE WHEN a >= 100 THEN 1 + a / 100 WHEN a <= -100 THEN 1 + 100 / abs(a) END, 4) AS decimal_odds,
  CASE WHEN a <= -100 OR a >= 99 THEN round(CASE WHEN a >= 100 THEN 1 + a / 100 WHEN a <= -100 THEN 1 + 100 / abs(a) END, 4) WHEN a > 1 THEN a END AS detected_odds
FROM (SELECT *, l_quantity * 20 - 500 AS a FROM lineitem)""",
    "win_10_first_per_match": f"WITH {_POOL} SELECT match_id, selection, p, odds FROM first_legs",
    "join_21_pairs": f"""WITH {_POOL}, pairs AS (
  SELECT a.match_id AS match_a, b.match_id AS match_b, CASE WHEN a.league = b.league THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END AS correlation,
         a.odds * b.odds AS o, a.p * b.p AS p FROM legs a JOIN legs b ON a.pos < b.pos)
SELECT match_a, match_b, correlation, round(o, 6) AS parlay_odds, round(p * (1 - correlation) * o - 1, 6) AS parlay_ev FROM pairs""",
    "join_22_combos": f"""WITH {_POOL}
SELECT a.match_id AS match_a, b.match_id AS match_b, c.match_id AS match_c, round(a.odds * b.odds * c.odds, 2) AS parlay_odds, round(a.p * b.p * c.p, 6) AS p
FROM legs a JOIN legs b ON a.pos < b.pos JOIN legs c ON b.pos < c.pos
WHERE round(a.odds * b.odds * c.odds, 2) >= 3.0 ORDER BY p DESC, match_a, match_b, match_c LIMIT 10""",
    "set_01_union_dedup": f"""WITH {PRICES}, tagged AS (SELECT *, (book % 2)::INT AS priority FROM prices)
SELECT match_id, selection, priority, book, odds FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id, selection ORDER BY priority, part, book, odds, price) AS rn FROM tagged) WHERE rn = 1""",
    "top_08_context": f"""WITH {LATEST}, {MATCHES}, firsts AS (
  SELECT match_id FROM matches WHERE state = 'not_started' ORDER BY scheduled_at, match_id LIMIT 20)
SELECT f.match_id, coalesce(string_agg(format('{{:d}}:{{:.2f}}', selection, odds), ' ' ORDER BY selection), '') AS context
FROM firsts f LEFT JOIN latest l ON f.match_id = l.match_id GROUP BY f.match_id""",
}
