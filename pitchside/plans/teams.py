"""Queries over histories: as-of joins, meetings, rolling statistics, runs, clusters, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchside.operators import histories as H
from pitchside.operators import keyed
from pitchside.plans.adapters import MATCHES, events, matches, table


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each user and day."""
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("team"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("stat_day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.max("value"), 4).alias("top_value")
    )


DAILY = """daily AS (
  SELECT user_id AS team, date_trunc('day', ts)::TIMESTAMP AS stat_day, count(*) AS n_events, round(max(value), 4) AS top_value FROM events GROUP BY ALL)"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    shift = F.make_interval(days=(F.col("match_id") % 31).cast("int"))
    return m.select("match_id", (F.col("home") % 200).alias("team"), (F.col("away") * 3 % 200).alias("rival"), (F.lit("2024-01-01").cast("timestamp_ntz") + shift).alias("probe_at"))


PROBES = f"""{MATCHES}, probes AS (
  SELECT match_id, home % 200 AS team, away * 3 % 200 AS rival, TIMESTAMP '2024-01-01' + to_days((match_id % 31)::INT) AS probe_at FROM matches)"""


def join_05_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest statistics strictly before each match (JOIN-05, TOP-04)."""
    return H.asof_before(_probes(spark, sf_dir).drop("rival"), _daily(spark, sf_dir), "team", "probe_at", "stat_day", ["n_events", "top_value"])


def join_06_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both teams' statistics of each match, by one as-of join of all sides, and their features (JOIN-06, MTH-20)."""
    p = _probes(spark, sf_dir)
    sides = p.select("match_id", F.explode(F.array(F.struct(F.lit("h").alias("side"), F.col("team")), F.struct(F.lit("a").alias("side"), F.col("rival").alias("team")))).alias("s"), "probe_at")
    got = H.asof_before(sides.select("match_id", "s.side", "s.team", "probe_at"), _daily(spark, sf_dir), "team", "probe_at", "stat_day", ["n_events", "top_value"])
    pick = lambda side, c: F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    both = got.groupBy("match_id").agg(
        pick("h", "n_events").alias("h_n_events"), pick("a", "n_events").alias("a_n_events"),
        pick("h", "top_value").alias("h_top_value"), pick("a", "top_value").alias("a_top_value"),
    )
    return both.withColumns({"diff_n_events": F.col("h_n_events") - F.col("a_n_events"), "diff_top_value": F.round(F.col("h_top_value") - F.col("a_top_value"), 4)})


def join_07_h2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins in the last five earlier meetings of a pair, from the present home side's view."""
    m = matches(spark, sf_dir).where("home_score is not null").withColumn("home", F.col("home") % 25).withColumn("away", F.col("away") % 25).where("home <> away")
    w = H.meetings(m, "home", "away", F.col("scheduled_at"), F.col("match_id")).rowsBetween(-5, -1)
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home")).when(F.col("home_score") < F.col("away_score"), F.col("away"))
    last = F.collect_list(F.coalesce("winner", F.lit(-1))).over(w)
    got = m.withColumn("winner", winner).withColumn("last", last)
    wins = lambda team: F.size(F.filter("last", lambda x: x == F.col(team)))
    return got.select("match_id", F.size("last").alias("n_meetings"), wins("home").alias("home_wins"), wins("away").alias("away_wins"), F.round(F.when(F.size("last") > 0, wins("home") / F.size("last")), 3).alias("home_win_pct"))


def join_08_rest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since a team's last earlier day of play, 7 where there is none."""
    m = matches(spark, sf_dir).withColumn("day", F.to_date("scheduled_at"))
    return m.select("match_id", "home", F.coalesce(H.rest_days(m, "home", "day"), F.lit(7)).cast("long").alias("rest_days"))


_EVENT_ORDER = ["ts", "event_id"]


def win_01_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a user's last 5, 10 and 20 values before each event (WIN-01, WIN-05)."""
    got = H.rolling_means(events(spark, sf_dir).withColumn("v", F.round("value", 2).cast("decimal(12,2)")), ["user_id"], _EVENT_ORDER, ["v"], [5, 10, 20], 6)
    return got.select("event_id", *[F.col(f"roll_{n}_v").cast("double").alias(f"roll_{n}") for n in (5, 10, 20)], "games_played")


def win_02_season_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling means that begin anew with every run of a week (WIN-02, WIN-03, WIN-07)."""
    e = events(spark, sf_dir).withColumn("season", F.weekofyear("ts")).withColumn("v", F.round("value", 2).cast("decimal(12,2)"))
    got = H.rolling_means(H.runs(e, ["user_id"], _EVENT_ORDER, "season"), ["user_id", "run"], _EVENT_ORDER, ["v"], [5, 10], 6)
    return got.select("event_id", "run", *[F.col(f"roll_{n}_v").cast("double").alias(f"roll_{n}") for n in (5, 10)], "games_played")


def win_04_ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of discounted value in a supplier's last ten items (WIN-04)."""
    l = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate", F.round("l_extendedprice").cast("long").alias("price"), F.round(F.col("l_discount") * 100).cast("long").alias("off")
    ).withColumn("cut", F.col("price") * F.col("off"))
    w = H.previous(10, ["l_suppkey"], [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "price", "off")])
    return l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", H.ratio_of_sums("cut", "price", w).alias("ratio"))


def win_12_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a user's events within two hours of their first (WIN-12)."""
    return H.anchored_clusters(events(spark, sf_dir).select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 120)


def join_13_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's events of one type within two hours (JOIN-13)."""
    return H.near_pairs(events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", 120)


def win_13_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and dates of five walk-forward folds over matches by day (WIN-13, AGG-26)."""
    rows = H.placed(matches(spark, sf_dir).select("match_id", "scheduled_at"), F.to_date("scheduled_at"), "match_id")
    fold = H.fold_of(F.col("n_"), 5, F.col("position_"))
    return rows.withColumn("fold", fold).where("fold is not null").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.min("day_").cast("timestamp_ntz").alias("first_day"), F.max("day_").cast("timestamp_ntz").alias("last_day")
    )


def flt_01_operational_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day that begins at seven (FLT-01, STR-04)."""
    day = F.window(F.col("ts").cast("timestamp"), "24 hours", "24 hours", "7 hours")
    return events(spark, sf_dir).groupBy(day.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("starts"), "n")


def flt_02_calendar_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def ups_02_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map of each user's properties, the last value of a key (UPS-02)."""
    e = events(spark, sf_dir).select("user_id", "ts", "event_id", F.map_concat(F.from_json("props", "map<string,int>"), F.create_map("event_type", F.lit(1).cast("int") * (F.col("event_id") % 100).cast("int"))).alias("m"))
    got = keyed.merged_maps(e, ["user_id"], "m", [F.col("ts"), F.col("event_id")])
    return got.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("merged"))


def agg_32_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of the JSON properties."""
    return events(spark, sf_dir).select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


def win_15_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("league").orderBy(F.desc("total"), F.asc("match_id"))
    m = matches(spark, sf_dir)
    return m.select(
        "match_id", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense_rank"), F.ntile(4).over(w).cast("long").alias("quartile"),
        F.lead("match_id").over(w).alias("following"), F.first("match_id").over(w).alias("leader"),
    )


def join_14_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of matches of the same two teams in either order within a league and month (JOIN-14)."""
    m = matches(spark, sf_dir).select("match_id", (F.col("home") % 40).alias("home"), "away", F.date_trunc("month", "scheduled_at").alias("month")).where("home <> away")
    pair = lambda t: (F.least(f"{t}.home", f"{t}.away"), F.greatest(f"{t}.home", f"{t}.away"))
    (xl, xg), (yl, yg) = pair("x"), pair("y")
    on = (xl == yl) & (xg == yg) & (F.col("x.month") == F.col("y.month")) & (F.col("x.match_id") < F.col("y.match_id"))
    return m.alias("x").join(m.alias("y"), on).select(F.col("x.match_id").alias("a"), F.col("y.match_id").alias("b"), (F.col("x.home") == F.col("y.home")).alias("same_sides"))


QUERIES = {
    "join_05_asof": join_05_asof,
    "join_06_both_sides": join_06_both_sides,
    "join_07_h2h": join_07_h2h,
    "join_08_rest_days": join_08_rest_days,
    "win_01_rolling": win_01_rolling,
    "win_02_season_reset": win_02_season_reset,
    "win_04_ratio_of_sums": win_04_ratio_of_sums,
    "win_12_cluster": win_12_cluster,
    "join_13_near_dup": join_13_near_dup,
    "win_13_folds": win_13_folds,
    "flt_01_operational_day": flt_01_operational_day,
    "flt_02_calendar_day": flt_02_calendar_day,
    "ups_02_map_merge": ups_02_map_merge,
    "agg_32_key_union": agg_32_key_union,
    "win_15_ranks": win_15_ranks,
    "join_14_symmetric": join_14_symmetric,
}
_V = "CAST(round(value, 2) AS DECIMAL(12,2))"
SQL = {
    "join_05_asof": f"""WITH {DAILY}, {PROBES} SELECT match_id, p.team, probe_at, d.stat_day, d.n_events, d.top_value
FROM probes p ASOF LEFT JOIN daily d ON p.team = d.team AND p.probe_at > d.stat_day""",
    "join_06_both_sides": f"""WITH {DAILY}, {PROBES}, g AS (SELECT match_id, coalesce(h.n_events, 0) AS h_n_events, coalesce(a.n_events, 0) AS a_n_events,
  coalesce(h.top_value, 0) AS h_top_value, coalesce(a.top_value, 0) AS a_top_value
FROM probes p ASOF LEFT JOIN daily h ON p.team = h.team AND p.probe_at > h.stat_day ASOF LEFT JOIN daily a ON p.rival = a.team AND p.probe_at > a.stat_day)
SELECT *, h_n_events - a_n_events AS diff_n_events, round(h_top_value - a_top_value, 4) AS diff_top_value FROM g""",
    "join_07_h2h": f"""WITH {MATCHES}, m AS (SELECT match_id, scheduled_at, home % 25 AS home, away % 25 AS away,
  CASE WHEN home_score > away_score THEN home % 25 WHEN home_score < away_score THEN away % 25 ELSE -1 END AS winner FROM matches WHERE home_score IS NOT NULL AND home % 25 <> away % 25),
g AS (SELECT *, coalesce(list(winner) OVER (PARTITION BY least(home, away), greatest(home, away) ORDER BY scheduled_at, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS last FROM m)
SELECT match_id, len(last)::INT AS n_meetings, len(list_filter(last, lambda x: x = home))::INT AS home_wins, len(list_filter(last, lambda x: x = away))::INT AS away_wins,
  round(CASE WHEN len(last) > 0 THEN len(list_filter(last, lambda x: x = home)) / len(last) END, 3) AS home_win_pct FROM g""",
    "join_08_rest_days": f"""WITH {MATCHES}, m AS (SELECT match_id, home, scheduled_at::DATE AS day FROM matches)
SELECT match_id, home, coalesce(day - max(day) OVER (PARTITION BY home ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 7)::BIGINT AS rest_days FROM m""",
    "win_01_rolling": f"""SELECT event_id, {", ".join(f"round(avg({_V}) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS roll_{n}" for n in (5, 10, 20))},
  count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS games_played FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "win_02_season_reset": f"""WITH a AS (SELECT *, weekofyear(ts) AS season FROM events),
b AS (SELECT *, coalesce((season <> lag(season) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT, 0) AS c FROM a),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM b)
SELECT event_id, run, {", ".join(f"round(avg({_V}) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS roll_{n}" for n in (5, 10))},
  count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS games_played FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)""",
    "win_04_ratio_of_sums": """WITH l AS (SELECT *, round(l_extendedprice)::BIGINT AS price, round(l_discount * 100)::BIGINT AS off FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sum(price * off) OVER w / nullif(sum(price) OVER w, 0), 4) AS ratio FROM l
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_quantity, price, off ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    "win_12_cluster": """WITH RECURSIVE o AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT user_id, event_id, rn, ts AS anchor, event_id AS cluster FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.rn, CASE WHEN o.ts - w.anchor > INTERVAL 120 MINUTE THEN o.ts ELSE w.anchor END,
         CASE WHEN o.ts - w.anchor > INTERVAL 120 MINUTE THEN o.event_id ELSE w.cluster END
  FROM walk w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT user_id, event_id, cluster FROM walk""",
    "join_13_near_dup": """SELECT x.user_id, x.event_type, x.event_id AS a, y.event_id AS b FROM events x JOIN events y
ON x.user_id = y.user_id AND x.event_type = y.event_type AND (x.ts < y.ts OR (x.ts = y.ts AND x.event_id < y.event_id)) AND y.ts - x.ts <= INTERVAL 120 MINUTE""",
    "win_13_folds": f"""WITH {MATCHES}, o AS (SELECT scheduled_at::DATE AS day, row_number() OVER (ORDER BY scheduled_at::DATE, match_id) - 1 AS i, count(*) OVER () AS n FROM matches),
f AS (SELECT *, n // 6 AS size, n - (n // 6) * 5 AS first FROM o)
SELECT ((i - first) // size + 1)::BIGINT AS fold, count(*) AS n_test, min(day)::TIMESTAMP AS first_day, max(day)::TIMESTAMP AS last_day FROM f WHERE i >= first GROUP BY 1""",
    "flt_01_operational_day": "SELECT date_trunc('day', ts - INTERVAL 7 HOUR)::TIMESTAMP + INTERVAL 7 HOUR AS starts, count(*) AS n FROM events GROUP BY 1",
    "flt_02_calendar_day": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1",
    "ups_02_map_merge": """WITH e AS (
  SELECT user_id, ts, event_id, unnest(json_keys(props)) AS k, NULL::INT AS x, props FROM events),
v AS (SELECT user_id, ts, event_id, k, (props->>k)::INT AS v FROM e UNION ALL SELECT user_id, ts, event_id, event_type, (event_id % 100)::INT FROM events),
l AS (SELECT user_id, k, arg_max(v, (ts, event_id)) AS v FROM v GROUP BY ALL)
SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS merged FROM l GROUP BY user_id""",
    "agg_32_key_union": "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events",
    "win_15_ranks": f"""WITH {MATCHES} SELECT match_id, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER w AS quartile,
  lead(match_id) OVER w AS following, first_value(match_id) OVER w AS leader FROM matches WINDOW w AS (PARTITION BY league ORDER BY total DESC, match_id)""",
    "join_14_symmetric": f"""WITH {MATCHES}, m AS (SELECT match_id, home % 40 AS home, away, date_trunc('month', scheduled_at) AS month FROM matches WHERE home % 40 <> away)
SELECT x.match_id AS a, y.match_id AS b, x.home = y.home AS same_sides FROM m x JOIN m y ON least(x.home, x.away) = least(y.home, y.away)
 AND greatest(x.home, x.away) = greatest(y.home, y.away) AND x.month = y.month AND x.match_id < y.match_id""",
}
