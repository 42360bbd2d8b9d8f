"""Queries over bets: settlement, ledgers, risk, time series, model health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchside.functions import cleaning as C
from pitchside.functions import odds as O
from pitchside.functions import probability as PR
from pitchside.operators import keyed
from pitchside.plans.adapters import (
    BET_KEY,
    BETS,
    MATCHES,
    PNL_CENTS,
    bets,
    matches,
    pnl_cents,
)


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets on scores: markets by line number, outcomes by the rules of their market."""
    b = bets(spark, sf_dir).join(matches(spark, sf_dir).select("match_id", "state", "home_score", "away_score"), "match_id")
    h, a, line = F.col("home_score"), F.col("away_score"), F.col("line")
    outcome = (
        F.when(h.isNull() | a.isNull(), "VOID")
        .when(line == 1, O.settled_match_winner(F.lit("home"), h, a))
        .when(line == 2, O.settled_match_winner(F.lit("draw"), h, a))
        .when(line == 3, O.settled_over_under(F.lit("over"), F.lit(3.0), h, a))
        .when(line == 4, O.settled_over_under(F.lit("under"), F.lit(2.5), h, a))
        .when(line == 5, O.settled_both_score(F.lit("yes"), h, a))
        .when(line == 6, O.settled_spread(F.lit("away"), F.lit(1.0), h, a))
        .otherwise(O.settled_match_winner(F.lit("other"), h, a))
    )
    stake = (F.col("stake_c") / 100).cast("decimal(10,2)")
    odds = (F.col("odds_h") / 100).cast("decimal(8,2)")
    return b.where("state = 'finished'").withColumn("outcome", outcome).withColumns(
        {"net": O.net_pnl(F.col("outcome"), stake, odds), "delta": O.ledger_delta(F.col("outcome"), stake, odds)}
    )


def ups_08_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir).select(*BET_KEY, "outcome", F.col("net").cast("double").alias("net_pnl"))


def agg_17_settlement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by outcome and money by ledger (AGG-17, AGG-20)."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return _settled(spark, sf_dir).groupBy("ledger").agg(
        count("WON").alias("won"), count("LOST").alias("lost"), count("VOID").alias("void"), count("PUSHED_TO_HUMAN").alias("pushed"),
        F.sum("net").cast("double").alias("net_pnl"), F.sum("delta").cast("double").alias("ledger_delta"),
    )


_OUTCOME = """settled AS (
  SELECT *, stake_c * odds_h AS back, stake_c * (odds_h - 100) AS gain FROM (
    SELECT b.*, CASE WHEN home_score IS NULL OR away_score IS NULL THEN 'VOID'
      WHEN line = 1 THEN CASE WHEN home_score > away_score THEN 'WON' ELSE 'LOST' END
      WHEN line = 2 THEN CASE WHEN home_score = away_score THEN 'WON' ELSE 'LOST' END
      WHEN line = 3 THEN CASE WHEN home_score + away_score = 3 THEN 'VOID' WHEN home_score + away_score > 3 THEN 'WON' ELSE 'LOST' END
      WHEN line = 4 THEN CASE WHEN home_score + away_score < 2.5 THEN 'WON' ELSE 'LOST' END
      WHEN line = 5 THEN CASE WHEN home_score > 0 AND away_score > 0 THEN 'WON' ELSE 'LOST' END
      WHEN line = 6 THEN CASE WHEN away_score + 1 = home_score THEN 'VOID' WHEN away_score + 1 > home_score THEN 'WON' ELSE 'LOST' END
      ELSE 'PUSHED_TO_HUMAN' END AS outcome
    FROM bets b JOIN matches m ON b.match_id = m.match_id WHERE m.state = 'finished'))"""


def _even(v: str) -> str:
    return f"({v} // 100 + CASE WHEN {v} % 100 > 50 OR ({v} % 100 = 50 AND ({v} // 100) % 2 = 1) THEN 1 ELSE 0 END)"


_NET = f"CASE outcome WHEN 'WON' THEN {_even('gain')} WHEN 'LOST' THEN -stake_c ELSE 0 END"
_DELTA = f"CASE outcome WHEN 'WON' THEN {_even('back')} WHEN 'VOID' THEN stake_c ELSE 0 END"


def agg_22_pnl_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily profit with the baseline from before the cut-off (AGG-22, WIN-08)."""
    done = bets(spark, sf_dir).where("status in ('WON', 'LOST')").withColumn("pnl", pnl_cents()).withColumn("day", F.to_date("placed_at"))
    cutoff = F.to_date(F.lit("1996-01-01"))
    daily = done.groupBy("ledger", F.greatest("day", F.date_sub(cutoff, 1)).alias("day")).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ledger").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    # the day before the cut-off holds all that came earlier
    return daily.withColumn("running", F.sum("pnl").over(w)).where(F.col("day") >= cutoff).select(
        "ledger", F.col("day").cast("timestamp_ntz").alias("day"), (F.col("pnl") / 100).alias("pnl"), F.col("n").alias("n_bets"), (F.col("running") / 100).alias("cumulative")
    )


def agg_23_pnl_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = agg_22_pnl_timeseries(spark, sf_dir)
    return d.groupBy("ledger").agg(
        F.round(F.sum("pnl"), 2).alias("total"), F.max("pnl").alias("best_day"), F.min("pnl").alias("worst_day"),
        F.count_if(F.col("pnl") > 0).alias("winning_days"), F.count_if(F.col("pnl") != 0).alias("active_days"),
    )


def agg_03_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending stake by league."""
    b = bets(spark, sf_dir).where("status = 'PENDING'").join(matches(spark, sf_dir).select("match_id", "league"), "match_id")
    return b.groupBy("league").agg(
        F.count(F.lit(1)).alias("n_bets"), (F.sum("stake_c") / 100).alias("stake"), F.round(F.sum("odds_h") / 100 / F.count(F.lit(1)), 3).alias("avg_odds")
    )


def agg_02_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of balances, exposure and win rate."""
    won, lost, open_ = (F.col("status") == s for s in ("WON", "LOST", "PENDING"))
    real = F.col("ledger") == "REAL"
    b = bets(spark, sf_dir).withColumn("pnl", pnl_cents())
    return b.agg(
        (100_000 / 100 + F.sum(F.when(real, F.col("pnl")).otherwise(0)) / 100).alias("balance_real"),
        (1_000_000 / 100 + F.sum(F.when(~real, F.col("pnl")).otherwise(0)) / 100).alias("balance_paper"),
        F.count_if(open_).alias("n_pending"),
        (F.sum(F.when(open_, F.col("stake_c")).otherwise(0)) / 100).alias("exposure"),
        F.round(F.count_if(won) / F.count_if(won | lost), 4).alias("win_rate"),
    )


def agg_04_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit of a day and of its week so far, with the loss limits (AGG-04, AGG-05)."""
    done = bets(spark, sf_dir).where("status in ('WON', 'LOST')").withColumn("pnl", pnl_cents()).withColumn("day", F.date_trunc("day", "placed_at"))
    daily = done.groupBy("ledger", "day").agg(F.sum("pnl").alias("pnl"))
    week = Window.partitionBy("ledger", F.date_trunc("week", "day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("week", F.sum("pnl").over(week)).select(
        "ledger", F.col("day").cast("timestamp_ntz").alias("day"), (F.col("pnl") / 100).alias("day_pnl"), (F.col("week") / 100).alias("week_pnl"),
        (F.col("pnl") < -100_000).alias("day_limit_hit"), (F.col("week") < -200_000).alias("week_limit_hit"),
    )


def agg_06_model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier, return and degradation by model and ledger (AGG-06 to AGG-11)."""
    done = bets(spark, sf_dir).where("status in ('WON', 'LOST')").withColumn("pnl", pnl_cents())
    hit = F.col("status") == "WON"
    got = done.groupBy("model", "ledger").agg(
        F.round(F.avg(PR.brier(F.col("p"), hit)), 6).alias("brier"),
        F.round(F.sum("pnl") * 100 / F.sum("stake_c"), 2).alias("roi"),
        F.count(F.lit(1)).alias("n_bets"), F.count_if(hit).alias("wins"), F.count_if(~hit).alias("losses"),
    )
    return got.withColumn("degraded", (F.col("n_bets") >= 50) & ((F.col("brier") > 0.22) | (F.col("roi") < -5)))


_RECENT = ["placed_at", "match_id", "part", "book", "line", "stake_c", "odds_h"]


def agg_12_last50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier and return of the last 50 settled bets of each model."""
    done = bets(spark, sf_dir).where("status in ('WON', 'LOST')").withColumn("pnl", pnl_cents())
    last = keyed.last_n(done, ["model"], [F.desc(c) for c in _RECENT], 50)
    return last.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(PR.brier(F.col("p"), F.col("status") == "WON")), 6).alias("brier"), F.round(F.sum("pnl") * 100 / F.sum("stake_c"), 2).alias("roi")
    ).where("n = 50")


def win_09_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's latest monthly Brier against the mean of the three before."""
    done = bets(spark, sf_dir).where("status in ('WON', 'LOST')")
    monthly = done.groupBy("model", F.date_format("placed_at", "yyyy-MM").alias("month")).agg(F.avg(PR.brier(F.col("p"), F.col("status") == "WON")).alias("brier"))
    ranked = keyed.last_n(monthly, ["model"], [F.desc("month")], 4)
    got = ranked.groupBy("model").agg(
        F.max(F.when(F.col("rn") == 1, F.col("brier"))).alias("latest"), F.avg(F.when(F.col("rn") > 1, F.col("brier"))).alias("older"), F.count(F.lit(1)).alias("n")
    )
    gap = F.round(F.col("latest") - F.col("older"), 6)
    trend = F.when((F.col("n") < 3) | gap.isNull(), "unknown").when(gap > 0.02, "worse").when(gap < -0.02, "better").otherwise("stable")
    return got.select("model", F.round("latest", 6).alias("latest"), F.round("older", 6).alias("older"), trend.alias("trend"))


def agg_01_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bets(spark, sf_dir).withColumn("pnl", pnl_cents())
    return b.groupBy(F.date_format("placed_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") != "PENDING").alias("settled"), (F.sum("pnl") / 100).alias("pnl")
    )


def join_02_bet_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets with the one prediction of their match, book and line (JOIN-02, JOIN-03)."""
    b = bets(spark, sf_dir)
    predicted = b.where("odds_h % 3 <> 0").groupBy("match_id", "book", "line").agg(F.min("model").alias("model_name"), F.max("p").alias("model_p"))
    return b.join(predicted, ["match_id", "book", "line"], "left").select(*BET_KEY, F.coalesce("model_name", F.lit("unknown")).alias("model_name"), "model_p")


def join_09_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).where("state <> 'finished' and scheduled_at < timestamp_ntz'1997-01-01'")
    return m.join(bets(spark, sf_dir).where("status = 'PENDING'"), "match_id", "left_semi").select("match_id", "home", "scheduled_at")


def join_11_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).join(bets(spark, sf_dir), "match_id", "left_anti").select("match_id", "state")


def flt_04_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which checks a bet fails, in order (FLT-04)."""
    o, p = F.col("odds_h") / 100, F.col("p")
    return bets(spark, sf_dir).select(
        *BET_KEY,
        C.failures(
            (o.isNotNull(), "odds"), ((o > 1) & (o < 5.5), "odds_range"), (F.length(F.col("part").cast("string")) >= 2, "name"),
            (F.col("stake_c") > 100_000, "stake"), (O.expected_value(p, o) > 0, "ev"), (F.round(F.abs(p - 1 / o) * 100, 6) <= 50, "gap"),
        ).alias("failed"),
    )


def flt_06_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending bets an hour old or more become void (FLT-06)."""
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    age = F.timestamp_diff("MINUTE", F.col("placed_at"), now)
    return bets(spark, sf_dir).where((F.col("status") == "PENDING") & (age >= 60)).select(*BET_KEY, F.lit("VOID").alias("new_status"), age.alias("age_minutes"))


def ups_04_status_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two runs; a status never moves down (UPS-04)."""
    status = lambda n: F.element_at(F.array(F.lit("VETOED"), F.lit("PENDING"), F.lit("APPROVED"), F.lit("PLACED")), (n % 4 + 1).cast("int"))
    b = bets(spark, sf_dir)
    run = lambda rows, n: rows.groupBy("match_id", "line").agg(F.max("p").alias("p"), F.max("odds_h").alias("o")).select("match_id", "line", "p", status(F.col("o") + n).alias("status"))
    return keyed.ranked_upsert(run(b.where("book % 2 = 0"), 0), run(b.where("book % 3 = 0"), 1), ["match_id", "line"], ["p"], "status", {"VETOED": 0, "PENDING": 1, "APPROVED": 2, "PLACED": 3})


_DONE = f"done AS (SELECT *, {PNL_CENTS} AS pnl, CASE WHEN status = 'WON' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM bets WHERE status IN ('WON', 'LOST'))"
_KEY = ", ".join(BET_KEY)
_SERIES = f"""{BETS}, {_DONE},
daily AS (
  SELECT ledger, greatest(placed_at::DATE, DATE '1995-12-31') AS day, sum(pnl)::BIGINT AS pnl, count(*) AS n FROM done GROUP BY ALL),
series AS (
  SELECT ledger, day::TIMESTAMP AS day, pnl / 100 AS pnl, n AS n_bets, cumulative / 100 AS cumulative FROM (
    SELECT *, sum(pnl) OVER (PARTITION BY ledger ORDER BY day)::BIGINT AS cumulative FROM daily) WHERE day >= DATE '1996-01-01')"""
_STATUS = "(['VETOED', 'PENDING', 'APPROVED', 'PLACED'])"

QUERIES = {
    "ups_08_settle": ups_08_settle,
    "agg_17_settlement_summary": agg_17_settlement_summary,
    "agg_22_pnl_timeseries": agg_22_pnl_timeseries,
    "agg_23_pnl_kpis": agg_23_pnl_kpis,
    "agg_03_exposure": agg_03_exposure,
    "agg_02_portfolio": agg_02_portfolio,
    "agg_04_risk": agg_04_risk,
    "agg_06_model_health": agg_06_model_health,
    "agg_12_last50": agg_12_last50,
    "win_09_trend": win_09_trend,
    "agg_01_activity": agg_01_activity,
    "join_02_bet_prediction": join_02_bet_prediction,
    "join_09_semi": join_09_semi,
    "join_11_anti": join_11_anti,
    "flt_04_readiness": flt_04_readiness,
    "flt_06_stale": flt_06_stale,
    "ups_04_status_rank": ups_04_status_rank,
}
SQL = {
    "ups_08_settle": f"WITH {BETS}, {MATCHES}, {_OUTCOME} SELECT {_KEY}, outcome, ({_NET})::DOUBLE / 100 AS net_pnl FROM settled",
    "agg_17_settlement_summary": f"""WITH {BETS}, {MATCHES}, {_OUTCOME}
SELECT ledger, count(*) FILTER (outcome = 'WON') AS won, count(*) FILTER (outcome = 'LOST') AS lost, count(*) FILTER (outcome = 'VOID') AS void,
       count(*) FILTER (outcome = 'PUSHED_TO_HUMAN') AS pushed, sum({_NET})::DOUBLE / 100 AS net_pnl, sum({_DELTA})::DOUBLE / 100 AS ledger_delta
FROM settled GROUP BY ledger""",
    "agg_22_pnl_timeseries": f"WITH {_SERIES} SELECT * FROM series",
    "agg_23_pnl_kpis": f"""WITH {_SERIES} SELECT ledger, round(sum(pnl), 2) AS total, max(pnl) AS best_day, min(pnl) AS worst_day,
  count(*) FILTER (pnl > 0) AS winning_days, count(*) FILTER (pnl <> 0) AS active_days FROM series GROUP BY ledger""",
    "agg_03_exposure": f"""WITH {BETS}, {MATCHES} SELECT league, count(*) AS n_bets, sum(stake_c)::BIGINT / 100 AS stake, round(sum(odds_h)::DOUBLE / 100 / count(*), 3) AS avg_odds
FROM bets b JOIN matches m ON b.match_id = m.match_id WHERE status = 'PENDING' GROUP BY league""",
    "agg_02_portfolio": f"""WITH {BETS}, b AS (SELECT *, {PNL_CENTS} AS pnl FROM bets)
SELECT 1000.0::DOUBLE + sum(CASE WHEN ledger = 'REAL' THEN pnl ELSE 0 END)::BIGINT / 100 AS balance_real,
       10000.0::DOUBLE + sum(CASE WHEN ledger <> 'REAL' THEN pnl ELSE 0 END)::BIGINT / 100 AS balance_paper,
       count(*) FILTER (status = 'PENDING') AS n_pending, sum(CASE WHEN status = 'PENDING' THEN stake_c ELSE 0 END)::BIGINT / 100 AS exposure,
       round(count(*) FILTER (status = 'WON') / count(*) FILTER (status IN ('WON', 'LOST')), 4) AS win_rate FROM b""",
    "agg_04_risk": f"""WITH {BETS}, {_DONE}, daily AS (SELECT ledger, date_trunc('day', placed_at) AS day, sum(pnl)::BIGINT AS pnl FROM done GROUP BY ALL),
w AS (SELECT *, sum(pnl) OVER (PARTITION BY ledger, date_trunc('week', day) ORDER BY day)::BIGINT AS week FROM daily)
SELECT ledger, day::TIMESTAMP AS day, pnl / 100 AS day_pnl, week / 100 AS week_pnl, pnl < -100000 AS day_limit_hit, week < -200000 AS week_limit_hit FROM w""",
    "agg_06_model_health": f"""WITH {BETS}, {_DONE}, g AS (
  SELECT model, ledger, round(avg(pow(p - hit, 2)), 6) AS brier, round(sum(pnl)::DOUBLE * 100 / sum(stake_c)::DOUBLE, 2) AS roi, count(*) AS n_bets,
         count(*) FILTER (status = 'WON') AS wins, count(*) FILTER (status = 'LOST') AS losses FROM done GROUP BY ALL)
SELECT *, n_bets >= 50 AND (brier > 0.22 OR roi < -5) AS degraded FROM g""",
    "agg_12_last50": f"""WITH {BETS}, {_DONE}, r AS (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY placed_at DESC, match_id DESC, part DESC, book DESC, line DESC, stake_c DESC, odds_h DESC) AS rn FROM done)
SELECT model, count(*) AS n, round(avg(pow(p - hit, 2)), 6) AS brier, round(sum(pnl)::DOUBLE * 100 / sum(stake_c)::DOUBLE, 2) AS roi
FROM r WHERE rn <= 50 GROUP BY model HAVING count(*) = 50""",
    "win_09_trend": f"""WITH {BETS}, {_DONE}, monthly AS (
  SELECT model, strftime(placed_at, '%Y-%m') AS month, avg(pow(p - hit, 2)) AS brier FROM done GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY month DESC) AS rn FROM monthly),
g AS (SELECT model, max(brier) FILTER (rn = 1) AS latest, avg(brier) FILTER (rn BETWEEN 2 AND 4) AS older, count(*) FILTER (rn <= 4) AS n FROM r GROUP BY model)
SELECT model, round(latest, 6) AS latest, round(older, 6) AS older,
  CASE WHEN n < 3 OR older IS NULL THEN 'unknown' WHEN round(latest - older, 6) > 0.02 THEN 'worse' WHEN round(latest - older, 6) < -0.02 THEN 'better' ELSE 'stable' END AS trend FROM g""",
    "agg_01_activity": f"""WITH {BETS}, b AS (SELECT *, {PNL_CENTS} AS pnl FROM bets)
SELECT strftime(placed_at, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status <> 'PENDING') AS settled, sum(pnl)::BIGINT / 100 AS pnl FROM b GROUP BY ALL""",
    "join_02_bet_prediction": f"""WITH {BETS}, predicted AS (
  SELECT match_id, book, line, min(model) AS model_name, max(p) AS model_p FROM bets WHERE odds_h % 3 <> 0 GROUP BY ALL)
SELECT {", ".join("b." + c for c in BET_KEY)}, coalesce(model_name, 'unknown') AS model_name, model_p
FROM bets b LEFT JOIN predicted p ON b.match_id = p.match_id AND b.book = p.book AND b.line = p.line""",
    "join_09_semi": f"""WITH {BETS}, {MATCHES} SELECT match_id, home, scheduled_at FROM matches m
WHERE state <> 'finished' AND scheduled_at < TIMESTAMP '1997-01-01' AND EXISTS (SELECT 1 FROM bets b WHERE b.match_id = m.match_id AND status = 'PENDING')""",
    "join_11_anti": f"WITH {MATCHES} SELECT match_id, state FROM matches m WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = m.match_id)",
    "flt_04_readiness": f"""WITH {BETS}, b AS (SELECT *, odds_h::DOUBLE / 100 AS o FROM bets)
SELECT {_KEY}, concat_ws(',', CASE WHEN o IS NULL THEN 'odds' END, CASE WHEN NOT (o > 1 AND o < 5.5) THEN 'odds_range' END,
  CASE WHEN length(part::VARCHAR) < 2 THEN 'name' END, CASE WHEN NOT stake_c > 100000 THEN 'stake' END,
  CASE WHEN NOT (p * (o - 1) - (1 - p) > 0) THEN 'ev' END, CASE WHEN NOT round(abs(p - 1 / o) * 100, 6) <= 50 THEN 'gap' END) AS failed FROM b""",
    "flt_06_stale": f"""WITH {BETS} SELECT {_KEY}, 'VOID' AS new_status, date_sub('minute', placed_at, TIMESTAMP '1998-01-01') AS age_minutes
FROM bets WHERE status = 'PENDING' AND date_sub('minute', placed_at, TIMESTAMP '1998-01-01') >= 60""",
    "ups_04_status_rank": f"""WITH {BETS},
a AS (SELECT match_id, line, max(p) AS p, {_STATUS}[max(odds_h) % 4 + 1] AS status FROM bets WHERE book % 2 = 0 GROUP BY ALL),
n AS (SELECT match_id, line, max(p) AS p, {_STATUS}[(max(odds_h) + 1) % 4 + 1] AS status FROM bets WHERE book % 3 = 0 GROUP BY ALL)
SELECT coalesce(a.match_id, n.match_id) AS match_id, coalesce(a.line, n.line) AS line, coalesce(n.p, a.p) AS p,
  CASE WHEN n.status IS NULL THEN a.status WHEN a.status IS NULL OR list_position({_STATUS}, n.status) >= list_position({_STATUS}, a.status) THEN n.status ELSE a.status END AS status
FROM a FULL JOIN n ON a.match_id = n.match_id AND a.line = n.line""",
}
