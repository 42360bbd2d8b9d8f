"""Queries that keep tables: seeding, scores, reconciliation, placement, alias learning, accumulators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions.rowmodels import present
from pitchside.operators import upkeep as U
from pitchside.plans.adapters import BETS, MATCHES, bets, matches, table
from pitchside.sources.scratch import cut, scratch
from pitchside.sources.stores import replace_keys

_NOW = "timestamp_ntz'1998-01-01 00:00:00'"


def _raw_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures as JSON of two layouts: of every third match five minutes late, of others a day late; some broken."""
    m = matches(spark, sf_dir)
    k = F.col("match_id")
    at = F.date_format(F.col("scheduled_at") + F.when(k % 3 == 0, F.expr("interval 5 minutes")).otherwise(F.expr("interval 1 day")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    team = lambda c: F.struct(F.struct(F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("t"), c)).alias("name")).alias("home"), F.struct(F.concat(F.lit("t"), F.col("away")).alias("name")).alias("away"))
    league = F.struct(F.lit("Cup").alias("name"), F.when(k % 2 == 0, "Italy").alias("country"))
    one = F.to_json(F.struct(F.struct(k.alias("id"), at.alias("date"), F.struct(F.when(k % 4 == 0, "FT").otherwise("NS").alias("short")).alias("status")).alias("fixture"), team(F.col("home")).alias("teams"), league.alias("league"), F.struct(F.when(k % 4 == 0, k % 5).alias("home"), F.when(k % 4 == 0, k % 3).alias("away")).alias("goals")))
    two = F.to_json(F.struct(k.alias("id"), F.when(k % 17 == 0, "soon").otherwise(at).alias("date"), team(F.col("home")).alias("teams"), league.alias("league"), F.struct(F.struct((k % 90).alias("total")).alias("home"), F.struct((k % 80).alias("total")).alias("away")).alias("scores")))
    return m.select(k.alias("match_id"), F.when(k % 2 == 0, one).otherwise(two).alias("fixture"))


def _fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.parsed_fixtures(_raw_fixtures(spark, sf_dir)).withColumn("scheduled_at", F.col("scheduled_at").cast("timestamp_ntz"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).withColumns({"home_team": F.concat(F.lit("t"), "home"), "away_team": F.concat(F.lit("t"), "away")})


def ups_17_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures of both JSON layouts as matches (UPS-17, SRC-11)."""
    return _fixtures(spark, sf_dir).select("fixture_id", "home_team", "away_team", "league", "scheduled_at", F.coalesce("home_score", F.lit(-1)).alias("home_score"), F.coalesce("away_score", F.lit(-1)).alias("away_score"), "finished")


def ups_17_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures of a year that no match is near (UPS-17)."""
    year = [F.expr(f"timestamp_ntz'{y}-01-01 00:00:00'") for y in (1995, 1996)]
    return U.seeded(_named(spark, sf_dir), _fixtures(spark, sf_dir), *year).select("fixture_id", "home_team", "scheduled_at")


def ups_11_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, states and statistics of fixtures applied to matches; a score that is there stays (UPS-11, UPS-14)."""
    k = F.col("match_id")
    m = matches(spark, sf_dir).select("match_id", "home_score", "away_score", "state", F.lit(None).cast("string").alias("source"), present({"shots": k % 9, "old": F.lit(1)}).alias("stats"))
    got = U.parsed_fixtures(_raw_fixtures(spark, sf_dir)).select(F.col("fixture_id").alias("match_id"), "home_score", "away_score", "finished", F.lit("fixtures").alias("source"), present({"fixture_id": F.col("fixture_id"), "shots": F.lit(50)}).alias("stats"))
    out = U.with_scores(m, got)
    return out.select("match_id", F.coalesce("home_score", F.lit(-1)).alias("home_score"), F.coalesce("away_score", F.lit(-1)).alias("away_score"), "state", F.coalesce("source", F.lit("")).alias("source"), F.col("stats")["shots"].alias("shots"), F.size("stats").alias("n_stats"))


def ups_13_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open matches long past, with the result of the first source that has one (UPS-13, SRC-13)."""
    k = F.col("match_id")
    m = matches(spark, sf_dir)
    source = lambda n, r, s: m.where(k % n == r).select("match_id", (k % s).cast("int").alias("home_score"), F.lit(1).alias("away_score"), (k % 2 == 0).alias("finished"))
    out = U.reconciled(m, [("odds", source(3, 0, 7)), ("fixtures", source(5, 0, 4)), ("scores", source(7, 0, 9))], F.expr(_NOW))
    return out.select("match_id", F.coalesce("home_score", F.lit(-1)).alias("home_score"), F.coalesce("source", F.lit("")).alias("source"))


def ups_07_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets that people place by hand: odds and stakes as got, value, warnings, errors (UPS-07)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "WON").when(k % 5 == 1, "PUSHED_TO_HUMAN").otherwise("PENDING")
    bets = o.where(k % 11 != 0).select(k.alias("bet_id"), status.alias("status"), (1.5 + (k % 20) / 10).alias("odds"), (1.0 + k % 9).alias("stake"), (0.3 + (k % 6) / 10).alias("p"))
    who = F.explode(F.when(k % 10 == 3, F.array(F.lit("ann"), F.lit("bob"))).otherwise(F.array(F.lit("ann"))))
    asks = o.select(k.alias("bet_id"), who.alias("placed_by"), F.when(k % 3 == 0, 1.2 + (k % 10) / 10).alias("actual_odds"), F.when(k % 4 == 0, F.lit(2.5)).alias("actual_stake"))
    out = U.placed_bets(bets, asks)
    return out.select("bet_id", "placed_by", *[F.coalesce(c, F.lit("")).alias(c) for c in ("status", "warnings", "error")], *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("odds", "stake", "ev", "ledger_delta")])


def ups_12_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names of suppliers' nations and of part names, learnt in order (UPS-12)."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.upper("n_name")).when(k % 3 == 1, F.concat(F.lit(" "), F.col("n_name"))).otherwise(F.concat(F.col("n_name"), F.lit(" FC")))
    return U.learned_aliases(s.select((k % 2).alias("sport"), "s_suppkey", name.alias("name")), "sport", "name", ["s_suppkey"])


def agg_28_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of days summed over a window of days; seeded matches are not carried on (AGG-28)."""
    m = matches(spark, sf_dir).withColumn("day", F.to_date("scheduled_at")).where("day >= date'1995-03-01' and day < date'1995-03-08'")
    days = m.groupBy("day").agg(F.count(F.lit(1)).alias("matches_seeded"), F.count("home_score").alias("scores_filled"), F.count_if(F.col("league") < 5).alias("stats_filled"), F.count_if(F.col("state") == "finished").alias("features_filled"))
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scores_filled", "stats_filled", "features_filled")]
    return days.agg(F.lit(0).cast("long").alias("matches_seeded"), *total).withColumn("total_filled", F.expr("scores_filled + stats_filled + features_filled"))


def agg_29_merge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each league the matches checked, resolved and still open (AGG-29)."""
    got = ups_13_reconciled(spark, sf_dir).join(matches(spark, sf_dir).select("match_id", "league"), "match_id")
    return got.groupBy("league").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("source") != "").alias("resolved"), F.count_if(F.col("source") == "").alias("still_open"), F.array_join(F.array_sort(F.collect_set(F.nullif("source", F.lit("")))), ",").alias("sources"))


def prj_37_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio's text for each customer: fixed lines of counts and money (PRJ-37)."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    money = F.concat(F.floor(F.col("cents") / 100).cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    lines = F.concat_ws("\n", F.concat(F.lit("Portfolio "), F.col("o_custkey")), F.concat(F.lit("Bets: "), F.col("n"), F.lit(" (open "), F.col("open"), F.lit(")")), F.concat(F.lit("Staked: "), money, F.lit(" EUR")))
    return o.select("o_custkey", lines.alias("text"))


def _bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bets(spark, sf_dir)
    keys = ["match_id", "line"]
    predictions = rows.select(
        *keys, F.col("part").alias("prediction_id"), F.when(F.col("part") % 13 != 0, F.col("odds_h") / 100).alias("best_odds"), F.when(F.col("part") % 17 != 0, F.col("stake_c")).otherwise(0).alias("stake"), (F.col("p") > 0.3).alias("ready")
    )
    there = rows.where("book % 2 = 0").select(*keys, "status", "ledger")
    return U.bridged(predictions, there, keys, "prediction_id")


def ups_06_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved predictions and the bets that they become (UPS-06)."""
    return _bridge(spark, sf_dir)


def ups_06_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by disposition (UPS-06)."""
    return U.disposition_counts(_bridge(spark, sf_dir))


def ups_05_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each model, ledger and day, stored wrong, corrected and run again: each takes the place of the one before (UPS-05, SNK-01)."""
    path = scratch(spark)
    done = bets(spark, sf_dir).where("status in ('WON', 'LOST')").withColumn("day", F.date_format("placed_at", "yyyy-MM-dd"))
    metrics = done.groupBy("model", "ledger", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(F.col("p") - (F.col("status") == "WON").cast("double"), 2)), 6).alias("brier")).withColumn("month", F.substring("day", 1, 7))
    metrics = cut(metrics)
    for m in (metrics.withColumn("brier", F.lit(9.0)), metrics.where("ledger = 'REAL'"), metrics.where("ledger = 'PAPER'"), metrics.where("ledger = 'PAPER'")):
        replace_keys(m, path, ["model", "ledger", "day", "month"], "month")
    return spark.read.schema(metrics.schema).parquet(path).select("model", "ledger", "day", "n", "brier")


def win_14_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier of the last 30 days with results, a column for each model, newest first (WIN-14)."""
    done = bets(spark, sf_dir).where("status in ('WON', 'LOST')").withColumn("day", F.to_date("placed_at"))
    last = done.agg(F.max("day").alias("last"))  # one row
    recent = done.crossJoin(F.broadcast(last)).where("day > last - interval 30 days")
    models = [f"model_{i}" for i in range(6)]
    score = F.pow(F.col("p") - (F.col("status") == "WON").cast("double"), 2)
    return recent.withColumn("score", score).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).pivot("model", models).agg(F.round(F.avg("score"), 6)).orderBy(F.desc("day"))


QUERIES = {f.__name__: f for f in (ups_06_bridge, ups_06_counts, ups_05_metrics, win_14_series, ups_17_parsed, ups_17_seeded, ups_11_scores, ups_13_reconciled, ups_07_placed, ups_12_aliases, agg_28_accumulators, agg_29_merge_statistics, prj_37_texts)}

_FIX = f"""{MATCHES}, raw AS (SELECT *, match_id AS k, scheduled_at + CASE WHEN match_id % 3 = 0 THEN INTERVAL 5 MINUTE ELSE INTERVAL 1 DAY END AS starts FROM matches),
fix AS (SELECT k AS fixture_id, 't' || home AS home_team, 't' || away AS away_team, CASE WHEN k % 2 = 0 THEN 'Italy Cup' ELSE 'Cup' END AS league, starts AS scheduled_at,
  CASE WHEN k % 2 = 1 THEN k % 90 WHEN k % 4 = 0 THEN k % 5 ELSE -1 END::INT AS home_score, CASE WHEN k % 2 = 1 THEN k % 80 WHEN k % 4 = 0 THEN k % 3 ELSE -1 END::INT AS away_score, k % 4 = 0 AS finished
  FROM raw WHERE k % 13 <> 0 AND NOT (k % 2 = 1 AND k % 17 = 0))"""
_OPEN = f"""{MATCHES}, due AS (SELECT *, match_id AS k FROM matches WHERE state <> 'finished' AND scheduled_at < TIMESTAMP '1998-01-01' - INTERVAL 6 HOUR),
got AS (SELECT k AS match_id, league, CASE WHEN home_score IS NULL AND k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 'odds' WHEN k % 5 = 0 THEN 'fixtures' WHEN k % 7 = 0 THEN 'scores' ELSE '' END ELSE '' END AS source, home_score, k FROM due)"""
_BRIDGE = f"""WITH {BETS}, x AS (SELECT match_id, line, part AS prediction_id, part % 13 <> 0 AND odds_h > 0 AND part % 17 <> 0 AND stake_c > 0 AS usable, CASE WHEN p > 0.3::DOUBLE THEN 'REAL' ELSE 'PAPER' END AS dest, stake_c FROM bets),
y AS (SELECT *, row_number() OVER (PARTITION BY match_id, line, usable ORDER BY prediction_id) AS nth FROM x),
b AS (SELECT match_id, line, arg_min(ledger, (status <> 'PENDING', ledger, status)) AS ledger, arg_min(status, (status <> 'PENDING', ledger, status)) AS status FROM bets WHERE book % 2 = 0 GROUP BY match_id, line),
z AS (SELECT y.*, b.ledger AS old_ledger, b.status AS old_status, CASE WHEN NOT usable THEN 'skipped_no_odds' WHEN b.ledger IS NULL AND nth = 1 THEN 'created'
  WHEN b.status = 'PENDING' AND b.ledger <> dest AND nth = 1 THEN 'updated_existing' ELSE 'skipped_existing' END AS disposition FROM y LEFT JOIN b USING (match_id, line)),
fates AS (SELECT match_id, line, prediction_id, disposition, CASE WHEN disposition IN ('created', 'updated_existing') THEN dest ELSE old_ledger END AS ledger,
  CASE WHEN disposition = 'created' THEN CASE dest WHEN 'PAPER' THEN 'PLACED' ELSE 'PENDING' END ELSE old_status END AS status, CASE WHEN disposition = 'created' AND dest = 'PAPER' THEN -stake_c ELSE 0 END AS ledger_delta FROM z)"""
_BS = "pow(p - (status = 'WON')::INT::DOUBLE, 2)"
SQL = {
    "ups_06_bridge": f"{_BRIDGE} SELECT * FROM fates",
    "ups_06_counts": f"{_BRIDGE} SELECT disposition, count(*) AS n, sum(ledger_delta)::BIGINT AS paid FROM fates GROUP BY disposition",
    "ups_05_metrics": f"WITH {BETS} SELECT model, ledger, strftime(placed_at, '%Y-%m-%d') AS day, count(*) AS n, round(avg({_BS}), 6) AS brier FROM bets WHERE status IN ('WON', 'LOST') GROUP BY ALL",
    "win_14_series": f"""WITH {BETS}, d AS (SELECT *, placed_at::DATE AS day, {_BS} AS score FROM bets WHERE status IN ('WON', 'LOST'))
SELECT strftime(day, '%Y-%m-%d') AS day, {", ".join(f"round(avg(score) FILTER (model = 'model_{i}'), 6) AS model_{i}" for i in range(6))} FROM d WHERE day > (SELECT max(day) FROM d) - INTERVAL 30 DAY GROUP BY day""",
    "ups_17_parsed": f"WITH {_FIX} SELECT * FROM fix",
    "ups_17_seeded": f"""WITH {_FIX}, f AS (SELECT *, row_number() OVER (PARTITION BY home_team, away_team, scheduled_at::DATE ORDER BY scheduled_at, fixture_id) AS n FROM fix WHERE scheduled_at >= TIMESTAMP '1995-01-01' AND scheduled_at < TIMESTAMP '1996-01-01')
SELECT fixture_id, home_team, scheduled_at FROM f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM matches m WHERE 't' || m.home = f.home_team AND 't' || m.away = f.away_team AND abs(epoch(m.scheduled_at) - epoch(f.scheduled_at)) <= 900)""",
    "ups_11_scores": f"""WITH {_FIX}, j AS (SELECT m.match_id, m.home_score AS hs, m.away_score AS aw, m.state, f.home_score AS fh, f.away_score AS fa, f.finished, f.fixture_id IS NOT NULL AS there,
  f.fixture_id IS NOT NULL AND m.home_score IS NULL AND f.home_score >= 0 AS got FROM matches m LEFT JOIN fix f ON m.match_id = f.fixture_id)
SELECT match_id, CASE WHEN got THEN fh ELSE coalesce(hs, -1) END AS home_score, CASE WHEN got THEN fa ELSE coalesce(aw, -1) END AS away_score, CASE WHEN got AND finished THEN 'finished' ELSE state END AS state,
  CASE WHEN got THEN 'fixtures' ELSE '' END AS source, CASE WHEN there THEN 50 ELSE match_id % 9 END::DOUBLE AS shots, CASE WHEN there THEN 3 ELSE 2 END::INT AS n_stats FROM j""",
    "ups_13_reconciled": f"""WITH {_OPEN} SELECT match_id, CASE source WHEN 'odds' THEN k % 7 WHEN 'fixtures' THEN k % 4 WHEN 'scores' THEN k % 9 ELSE coalesce(home_score, -1) END::INT AS home_score, source FROM got""",
    "ups_07_placed": """WITH o AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT k, CASE k % 5 WHEN 0 THEN 'WON' WHEN 1 THEN 'PUSHED_TO_HUMAN' ELSE 'PENDING' END AS status, 1.5::DOUBLE + (k % 20)::DOUBLE / 10 AS odds, 1.0::DOUBLE + k % 9 AS stake, 0.3::DOUBLE + (k % 6)::DOUBLE / 10 AS p FROM o WHERE k % 11 <> 0),
a AS (SELECT k, unnest(CASE WHEN k % 10 = 3 THEN ['ann', 'bob'] ELSE ['ann'] END) AS placed_by, CASE WHEN k % 3 = 0 THEN 1.2::DOUBLE + (k % 10)::DOUBLE / 10 END AS ao, CASE WHEN k % 4 = 0 THEN 2.5::DOUBLE END AS ast FROM o),
j AS (SELECT a.*, b.status, b.odds, b.stake, b.p, CASE WHEN b.k IS NULL THEN 'not found' WHEN b.status = 'WON' THEN 'already WON' WHEN placed_by = 'bob' THEN 'already PLACED' END AS error FROM a LEFT JOIN b ON a.k = b.k),
e AS (SELECT *, coalesce(ao, odds) AS o2, coalesce(ast, stake) AS s2, p * (coalesce(ao, odds) - 1) - (1 - p) AS v FROM j)
SELECT k AS bet_id, placed_by, CASE WHEN error IS NULL THEN 'PLACED' ELSE coalesce(status, '') END AS status,
  CASE WHEN error IS NULL THEN array_to_string(list_filter([CASE WHEN v < 0 THEN 'negative_ev' END, CASE WHEN ao < odds * 0.95::DOUBLE THEN 'slippage' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS warnings, coalesce(error, '') AS error,
  round(CASE WHEN error IS NULL THEN o2 ELSE 0 END, 4) AS odds, round(CASE WHEN error IS NULL THEN s2 ELSE 0 END, 4) AS stake, round(CASE WHEN error IS NULL THEN round(v, 6) ELSE 0 END, 4) AS ev, round(CASE WHEN error IS NULL THEN -s2 ELSE 0 END, 4) AS ledger_delta FROM e""",
    "agg_28_accumulators": f"""WITH {MATCHES}, d AS (SELECT count(home_score) AS a, count(*) FILTER (league < 5) AS b, count(*) FILTER (state = 'finished') AS c FROM matches WHERE scheduled_at >= TIMESTAMP '1995-03-01' AND scheduled_at < TIMESTAMP '1995-03-08')
SELECT 0::BIGINT AS matches_seeded, a AS scores_filled, b AS stats_filled, c AS features_filled, a + b + c AS total_filled FROM d""",
    "agg_29_merge_statistics": f"""WITH {_OPEN} SELECT league, count(*) AS checked, count(*) FILTER (source <> '') AS resolved, count(*) FILTER (source = '') AS still_open,
  coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (source <> '')), ','), '') AS sources FROM got GROUP BY league""",
    "prj_37_texts": """SELECT o_custkey, 'Portfolio ' || o_custkey || chr(10) || 'Bets: ' || count(*) || ' (open ' || count(*) FILTER (o_orderstatus = 'O') || ')' || chr(10) || 'Staked: ' ||
  (sum(round(o_totalprice * 100)::BIGINT) // 100)::BIGINT || '.' || lpad((sum(round(o_totalprice * 100)::BIGINT) % 100)::VARCHAR, 2, '0') || ' EUR' AS text FROM orders GROUP BY o_custkey""",
}
