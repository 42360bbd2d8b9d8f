"""Queries over decisions: sizing, tickets, voids, bridges, metrics, context lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import cleaning as C
from pitchside.functions import odds as O
from pitchside.functions import probability as PR
from pitchside.operators import keyed
from pitchside.plans.adapters import BET_KEY, BETS, MATCHES, PNL_CENTS, bets, matches, pnl_cents, table

_NOW = "1996-06-01"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


def join_01_bet_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open bets on finished matches (JOIN-01, JOIN-04)."""
    m = matches(spark, sf_dir).where("state = 'finished'").select("match_id", "league", "home_score", "away_score")
    return bets(spark, sf_dir).where("status = 'PENDING'").join(m, "match_id").select(*BET_KEY, "league", "home_score", "away_score")


def join_10_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of bets by ledger on matches of two leagues (JOIN-10)."""
    m = matches(spark, sf_dir).where("league in (3, 4)").select("match_id")
    return bets(spark, sf_dir).join(m, "match_id", "left_semi").groupBy("ledger").agg(F.count(F.lit(1)).alias("n"))


def join_23_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability vectors of a match and model, a third where one is missing, and their Brier (JOIN-23, AGG-08)."""
    b = bets(spark, sf_dir)
    p = lambda n: F.coalesce(F.max(F.when(F.col("line") == n, F.col("p"))), F.lit(0.33))
    v = b.groupBy("match_id", "model").agg(p(1).alias("h"), p(2).alias("d"), p(3).alias("a"))
    m = matches(spark, sf_dir).where("home_score is not null").select("match_id", F.when(F.col("home_score") > F.col("away_score"), 0).when(F.col("home_score") == F.col("away_score"), 1).otherwise(2).alias("o"))
    score = sum(F.pow(F.col(c) - (F.col("o") == i).cast("double"), 2) for i, c in enumerate("hda"))
    return v.join(m, "match_id").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("brier"))


def agg_09_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier of two kinds of market, weighted by their counts (AGG-07, AGG-09)."""
    done = bets(spark, sf_dir).where("status in ('WON', 'LOST')").withColumn("b", PR.brier(F.col("p"), F.col("status") == "WON"))
    main = F.col("line") <= 2
    g = done.groupBy("model").agg(F.count_if(main).alias("n1"), F.count_if(~main).alias("n2"), F.round(F.avg(F.when(main, F.col("b"))), 6).alias("b1"), F.round(F.avg(F.when(~main, F.col("b"))), 6).alias("b2"))
    blend = (F.coalesce("b1", F.lit(0.0)) * F.col("n1") + F.coalesce("b2", F.lit(0.0)) * F.col("n2")) / (F.col("n1") + F.col("n2"))
    return g.select("model", "b1", "b2", F.round(blend, 6).alias("blend"))


def agg_13_single_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly evaluation of each model, degraded below its own threshold (AGG-13, WIN-14, UPS-05)."""
    done = bets(spark, sf_dir).where("status in ('WON', 'LOST')").withColumn("pnl", pnl_cents())
    g = done.groupBy("model", F.date_format("placed_at", "yyyy-MM").alias("month")).agg(
        F.round(F.avg(PR.brier(F.col("p"), F.col("status") == "WON")), 6).alias("brier"), F.round(F.sum("pnl") * 100 / F.sum("stake_c"), 2).alias("roi"), F.count(F.lit(1)).alias("n")
    )
    return g.withColumn("ok", F.col("brier") < 0.21)


def agg_31_daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = F.col("ledger") == "REAL"
    return bets(spark, sf_dir).groupBy(F.date_trunc("day", "placed_at").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(real).alias("n_real"), F.count_if(~real).alias("n_paper"), (F.sum("stake_c") / 100).alias("stake")
    )


def flt_07_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending bets of finished matches become void (FLT-07)."""
    m = matches(spark, sf_dir).where("state = 'finished'").select("match_id")
    return bets(spark, sf_dir).where("status = 'PENDING'").join(m, "match_id", "left_semi").select(*BET_KEY, F.lit("VOID").alias("new_status"))


def flt_08_stale_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper bets whose match is over four days late give their stake back (FLT-08)."""
    late = F.col("scheduled_at") < _now() - F.expr("interval 4 days")
    m = matches(spark, sf_dir).where((F.col("state") != "finished") & late).select("match_id")
    return bets(spark, sf_dir).where("ledger = 'PAPER' and status = 'PENDING'").join(m, "match_id", "left_semi").select(*BET_KEY, (F.col("stake_c") / 100).alias("pnl"))


def flt_09_stale_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).where((F.col("state") == "not_started") & (F.col("scheduled_at") < _now() - F.expr("interval 4 days"))).select("match_id", "scheduled_at")


def flt_10_valid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that a two-way or a three-way model can learn from (FLT-10, FLT-11)."""
    r = F.when(F.col("home_score") > F.col("away_score"), "H").when(F.col("home_score") == F.col("away_score"), "D").when(F.col("home_score") < F.col("away_score"), "A")
    m = matches(spark, sf_dir).withColumn("result", r)
    return m.where(F.when(F.col("league") % 2 == 0, F.col("result").isin("H", "D", "A")).otherwise(F.col("result").isin("H", "A"))).select("match_id", "league", "result")


def flt_16_merge_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of a second source are left out where one contains the other (FLT-16)."""
    n = F.col("doc_id")
    first = F.array(F.when(n % 2 == 0, F.lit("injury")).otherwise(F.lit("suspended")))
    second = F.array(F.when(n % 3 == 0, F.lit("knee injury")).otherwise(F.lit("suspend")), F.lit("illness"))
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("f"), second.alias("s")).select("doc_id", F.array_join(F.concat("f", F.filter("s", lambda s: ~F.exists(F.col("f"), lambda x: F.contains(x, s) | F.contains(s, x)))), ",").alias("risks"))


def flt_18_min_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions below the least value are kept but vetoed (FLT-18, UPS-15)."""
    ev = O.expected_value(F.col("p"), F.col("odds_h") / 100)
    low = ev < 0.02
    return bets(spark, sf_dir).select(*BET_KEY, F.when(low, "VETOED").otherwise("PENDING").alias("new_status"), F.when(low, F.concat(F.lit("ev "), F.format_string("%.3f", F.round(ev, 3)))).otherwise("").alias("reason"))


def mth_05_size_bet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stakes with the ledger of their model and the limits in order (MTH-05, UPS-16)."""
    real = F.col("model").isin("model_1", "model_2")
    bankroll = F.when(real, 1000.0).otherwise(10000.0)
    o = F.col("odds_h") / 100
    k = O.kelly(F.col("p"), o, bankroll)
    limit = F.when(F.col("match_id") % 17 == 0, "daily_limit").when(F.col("match_id") % 19 == 0, "weekly_limit")
    stake = F.when(limit.isNotNull(), 0.0).otherwise(F.when(F.col("line") == 7, F.least(k["stake"], F.lit(1.0))).otherwise(k["stake"]))
    return bets(spark, sf_dir).select(*BET_KEY, F.when(real, "REAL").otherwise("PAPER").alias("booked"), stake.alias("stake"), F.coalesce(limit, k["reason"], F.lit("ok")).alias("reason"))


def mth_19_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with edge in percent; on paper where a check fails (MTH-19, UPS-06)."""
    o, p = F.col("odds_h") / 100, F.col("p")
    edge = F.round((p - 1 / o) * 100, 1)
    ready = (O.expected_value(p, o) > 0) & (F.abs(p - 1 / o) <= 0.15)
    return bets(spark, sf_dir).where("status = 'PENDING'").select(*BET_KEY, edge.alias("edge_pct"), F.when((F.col("ledger") == "REAL") & ready, "REAL").otherwise("PAPER").alias("booked"))


def top_07_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten bets settled last (TOP-07)."""
    done = bets(spark, sf_dir).where("status in ('WON', 'LOST')")
    return keyed.top_k(done, [F.desc(c) for c in ("placed_at", "match_id", "part", "book", "line", "stake_c", "odds_h")], 10).select(*BET_KEY, "status")


def top_09_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 problem matches of each state (TOP-09)."""
    bad = matches(spark, sf_dir).where("home_score is null")
    return keyed.last_n(bad, ["state"], [F.asc("match_id")], 20).select("state", "match_id")


def prj_10_leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of division codes, the code itself where there is none (PRJ-10, PRJ-33, PRJ-32)."""
    names = F.create_map(*[F.lit(x) for x in ("1", "First", "2", "Second", "3", "Third")])
    code = (F.col("s_suppkey") % 5).cast("string")
    side = F.element_at(F.array(F.lit("R"), F.lit("L"), F.lit("U")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(names[code], code, F.lit("unknown")).alias("league"), C.hand(side).alias("hand"), O.clipped(F.col("s_acctbal") / 5000).alias("p"))


def prj_11_odds_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide odds columns as a map without the missing ones (PRJ-11)."""
    wide = bets(spark, sf_dir).groupBy("match_id").agg(*[F.max(F.when(F.col("line") == i, F.col("odds_h"))).alias(n) for i, n in ((1, "h"), (2, "d"), (3, "a"))])
    m = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in "hda"]), lambda e: e["v"].isNotNull()))
    return wide.select("match_id", m.alias("m")).where(F.size("m") > 0).select("match_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("odds"))


def prj_27_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections that are a team's name become home or away (PRJ-27, PRJ-28)."""
    m = matches(spark, sf_dir).select("match_id", F.concat(F.lit("Team "), F.col("home")).alias("h"), F.concat(F.lit("Team "), F.col("away")).alias("a"))
    raw = F.when(F.col("match_id") % 4 == 0, F.col("h")).when(F.col("match_id") % 4 == 1, F.col("a")).when(F.col("match_id") % 4 == 2, F.lit("Draw")).otherwise(F.lit("Other"))
    return m.select("match_id", F.when(raw == F.col("h"), "home").when(raw == F.col("a"), "away").otherwise(F.lower(raw)).alias("selection"))


QUERIES = {
    f.__name__: f
    for f in (
        join_01_bet_match, join_10_in_subquery, join_23_vectors, agg_09_blend, agg_13_single_model, agg_31_daily_summary, flt_07_unplaced, flt_08_stale_paper,
        flt_09_stale_match, flt_10_valid_results, flt_16_merge_risks, flt_18_min_ev, mth_05_size_bet, mth_19_tickets, top_07_recent, top_09_capped, prj_10_leagues, prj_11_odds_map, prj_27_coerce,
    )
}
_K = ", ".join(BET_KEY)
_BK = ", ".join(f"b.{c}" for c in BET_KEY)
_DONE = f"done AS (SELECT *, {PNL_CENTS} AS pnl, pow(p - CASE WHEN status = 'WON' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 2) AS bs FROM bets WHERE status IN ('WON', 'LOST'))"
_O = "(odds_h::DOUBLE / 100)"
_EV = f"(p * ({_O} - 1) - (1 - p))"
SQL = {
    "join_01_bet_match": f"WITH {BETS}, {MATCHES} SELECT {_BK}, league, home_score, away_score FROM bets b JOIN matches m ON b.match_id = m.match_id WHERE m.state = 'finished' AND b.status = 'PENDING'",
    "join_10_in_subquery": f"WITH {BETS}, {MATCHES} SELECT ledger, count(*) AS n FROM bets WHERE match_id IN (SELECT match_id FROM matches WHERE league IN (3, 4)) GROUP BY ledger",
    "join_23_vectors": f"""WITH {BETS}, {MATCHES}, v AS (SELECT match_id, model, coalesce(max(p) FILTER (line = 1), 0.33::DOUBLE) AS h, coalesce(max(p) FILTER (line = 2), 0.33::DOUBLE) AS d, coalesce(max(p) FILTER (line = 3), 0.33::DOUBLE) AS a FROM bets GROUP BY ALL)
SELECT model, count(*) AS n, round(avg(pow(h - (home_score > away_score)::INT, 2) + pow(d - (home_score = away_score)::INT, 2) + pow(a - (home_score < away_score)::INT, 2)), 6) AS brier
FROM v JOIN matches m ON v.match_id = m.match_id WHERE home_score IS NOT NULL GROUP BY model""",
    "agg_09_blend": f"""WITH {BETS}, {_DONE}, g AS (SELECT model, count(*) FILTER (line <= 2) AS n1, count(*) FILTER (line > 2) AS n2, round(avg(bs) FILTER (line <= 2), 6) AS b1, round(avg(bs) FILTER (line > 2), 6) AS b2 FROM done GROUP BY model)
SELECT model, b1, b2, round((coalesce(b1, 0) * n1 + coalesce(b2, 0) * n2) / (n1 + n2), 6) AS blend FROM g""",
    "agg_13_single_model": f"""WITH {BETS}, {_DONE}, g AS (SELECT model, strftime(placed_at, '%Y-%m') AS month, round(avg(bs), 6) AS brier, round(sum(pnl)::DOUBLE * 100 / sum(stake_c)::DOUBLE, 2) AS roi, count(*) AS n FROM done GROUP BY ALL)
SELECT *, brier < 0.21 AS ok FROM g""",
    "agg_31_daily_summary": f"WITH {BETS} SELECT date_trunc('day', placed_at)::TIMESTAMP AS day, count(*) AS n, count(*) FILTER (ledger = 'REAL') AS n_real, count(*) FILTER (ledger <> 'REAL') AS n_paper, sum(stake_c)::BIGINT / 100 AS stake FROM bets GROUP BY 1",
    "flt_07_unplaced": f"WITH {BETS}, {MATCHES} SELECT {_K}, 'VOID' AS new_status FROM bets WHERE status = 'PENDING' AND match_id IN (SELECT match_id FROM matches WHERE state = 'finished')",
    "flt_08_stale_paper": f"WITH {BETS}, {MATCHES} SELECT {_K}, stake_c / 100 AS pnl FROM bets WHERE ledger = 'PAPER' AND status = 'PENDING' AND match_id IN (SELECT match_id FROM matches WHERE state <> 'finished' AND scheduled_at < TIMESTAMP '{_NOW}' - INTERVAL 4 DAY)",
    "flt_09_stale_match": f"WITH {MATCHES} SELECT match_id, scheduled_at FROM matches WHERE state = 'not_started' AND scheduled_at < TIMESTAMP '{_NOW}' - INTERVAL 4 DAY",
    "flt_10_valid_results": f"""WITH {MATCHES}, r AS (SELECT match_id, league, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' WHEN home_score < away_score THEN 'A' END AS result FROM matches)
SELECT * FROM r WHERE result IN ('H', 'A') OR (result = 'D' AND league % 2 = 0)""",
    "flt_16_merge_risks": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'injury' ELSE 'suspended' END || CASE WHEN doc_id % 3 = 0 AND doc_id % 2 <> 0 THEN ',knee injury' WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN ',suspend' ELSE '' END || ',illness' AS risks FROM documents""",
    "flt_18_min_ev": f"WITH {BETS} SELECT {_K}, CASE WHEN {_EV} < 0.02 THEN 'VETOED' ELSE 'PENDING' END AS new_status, CASE WHEN {_EV} < 0.02 THEN 'ev ' || format('{{:.3f}}', round({_EV}, 3)) ELSE '' END AS reason FROM bets",
    "mth_05_size_bet": f"""WITH {BETS}, s AS (SELECT *, {_O} AS o, CASE WHEN model IN ('model_1', 'model_2') THEN 1000.0::DOUBLE ELSE 10000.0::DOUBLE END AS bankroll,
  CASE WHEN p <= 0 OR p >= 1 THEN least(greatest(p, 1e-6), 1 - 1e-6) ELSE p END AS q FROM bets),
t AS (SELECT *, q * o - 1 AS ep, least(bankroll * ((q * o - 1) / (o - 1)) * 0.25::DOUBLE, bankroll * 0.05::DOUBLE) AS s0 FROM s),
u AS (SELECT *, CASE WHEN ep <= 0 THEN 'negative_ev' WHEN s0 < 0.10 THEN 'below_minimum_stake' ELSE 'ok' END AS why FROM t)
SELECT {_K}, CASE WHEN bankroll = 1000 THEN 'REAL' ELSE 'PAPER' END AS booked,
  CASE WHEN match_id % 17 = 0 OR match_id % 19 = 0 OR why <> 'ok' THEN 0 WHEN line = 7 THEN least(round(s0, 2), 1.0) ELSE round(s0, 2) END AS stake,
  CASE WHEN match_id % 17 = 0 THEN 'daily_limit' WHEN match_id % 19 = 0 THEN 'weekly_limit' ELSE why END AS reason FROM u""",
    "mth_19_tickets": f"WITH {BETS} SELECT {_K}, round((p - 1 / {_O}) * 100, 1) AS edge_pct, CASE WHEN ledger = 'REAL' AND {_EV} > 0 AND abs(p - 1 / {_O}) <= 0.15 THEN 'REAL' ELSE 'PAPER' END AS booked FROM bets WHERE status = 'PENDING'",
    "top_07_recent": f"WITH {BETS} SELECT {_K}, status FROM bets WHERE status IN ('WON', 'LOST') ORDER BY placed_at DESC, match_id DESC, part DESC, book DESC, line DESC, stake_c DESC, odds_h DESC LIMIT 10",
    "top_09_capped": f"WITH {MATCHES}, r AS (SELECT state, match_id, row_number() OVER (PARTITION BY state ORDER BY match_id) AS rn FROM matches WHERE home_score IS NULL) SELECT state, match_id FROM r WHERE rn <= 20",
    "prj_10_leagues": "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 1 THEN 'First' WHEN 2 THEN 'Second' WHEN 3 THEN 'Third' ELSE (s_suppkey % 5)::VARCHAR END AS league, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS hand, least(greatest(s_acctbal / 5000, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM supplier",
    "prj_11_odds_map": f"WITH {BETS}, w AS (SELECT match_id, max(odds_h) FILTER (line = 1) AS h, max(odds_h) FILTER (line = 2) AS d, max(odds_h) FILTER (line = 3) AS a FROM bets GROUP BY 1) SELECT match_id, concat_ws(',', 'h=' || h, 'd=' || d, 'a=' || a) AS odds FROM w WHERE h IS NOT NULL OR d IS NOT NULL OR a IS NOT NULL",
    "prj_27_coerce": f"WITH {MATCHES} SELECT match_id, CASE WHEN match_id % 4 = 0 OR (match_id % 4 = 1 AND home = away) THEN 'home' WHEN match_id % 4 = 1 THEN 'away' WHEN match_id % 4 = 2 THEN 'draw' ELSE 'other' END AS selection FROM matches",
}
