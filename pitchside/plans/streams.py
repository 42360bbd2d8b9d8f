"""Queries over streaming operators: the event table is read as a stream, and what the stream stored is the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions.rowmodels import present
from pitchside.operators.upkeep import stored_batches
from pitchside.plans.live import _normal
from pitchside.sources.scratch import scratch
from pitchside.streaming import streams as S
from pitchside.streaming import timers as T


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # as a glob, a file or a folder


def _stored(out: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now; timers are kept in the store that they need."""
    spark, path = out.sparkSession, scratch(out.sparkSession)
    key, store = T.STATE_STORE
    old = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        run: Callable[[DataFrame, int], None] = lambda batch, number: T.store_batch(batch, 0 if mode == "complete" else number, f"{path}/out")
        out.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, old)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _of_user(users: str = "user_id") -> tuple:
    return F.col(users) % 7, F.col(users) % 5


def str_01_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live value of matches (users) whose break (a view) is two minutes old, and at each price (a purchase) after that (STR-01)."""
    e = _events(spark, sf_dir)
    home, away = _of_user()
    state = F.when(F.col("event_type") == "view", "HT").when(F.col("event_type") == "click", "2H").otherwise("1H")
    states = e.where("event_type in ('view', 'click', 'signup')").select(
        F.col("user_id").alias("match_id"), F.col("ts").cast("timestamp").alias("at"), F.lit("basketball").alias("sport"), F.lit(0.55).alias("prior"), home.cast("int").alias("home"), away.cast("int").alias("away"),
        F.lit(24.0).alias("clock"), state.alias("state"), present({"x": F.lit(1.0)}).alias("stats"),
    )
    prices = e.where("event_type = 'purchase'").select(F.col("user_id").alias("match_id"), F.col("ts").cast("timestamp").alias("at"), (1.2 + F.round("value") / 10).alias("odds"))
    return _stored(T.live_values(states, prices)).select("match_id", F.unix_millis("at").alias("at_ms"), "prob", "ev")


def str_02_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each user's 20 values before each event, by keyed state (STR-02)."""
    e = _events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return _stored(S.rolling_state(e, "user_id", "ts", "value")).select(F.col("key").alias("user_id"), F.unix_micros("at").alias("at_us"), F.round(F.when(F.col("n_before") > 0, F.col("mean_before")), 6).alias("mean_before"), "n_before")


def str_05_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first signup is a bet, purchases and errors are results: settled, expired or late (STR-05, FLT-06, FLT-08)."""
    status = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "purchase", "WON").otherwise("LOST")
    bets = _events(spark, sf_dir).where("event_type in ('signup', 'purchase', 'error')").select(
        F.col("user_id").alias("bet_id"), F.when(F.col("user_id") % 2 == 0, "REAL").otherwise("PAPER").alias("ledger"), status.alias("status"), F.col("ts").cast("timestamp").alias("at")
    )
    return _stored(T.expiring(bets)).select("bet_id", F.unix_millis("at").alias("at_ms"), "status", "outcome")


def str_06_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of a batch as one message of the 500 earliest (STR-06)."""
    e = _events(spark, sf_dir).where("event_type = 'error'").select("ts", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("text"))
    path = scratch(spark)
    T.digests(e, f"{path}/out", f"{path}/state", "ts", "text")
    return spark.read.parquet(f"{path}/out").select("message")


def str_07_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of what is there now, stored by a job that is run twice (STR-07)."""
    path = scratch(spark)
    for _ in range(2):
        stored_batches(_events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "value"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


def str_08_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each user (STR-08)."""
    e = _events(spark, sf_dir).select("user_id", "ts", "value")
    return _stored(S.latest_values(e, ["user_id"], "ts", "value"), "complete").select("user_id", "value")


QUERIES = {f.__name__: f for f in (str_01_breaks, str_02_rolling, str_05_expiry, str_06_digest, str_07_stored, str_08_latest)}
_P = _normal("48", "12")
SQL = {
    "str_01_breaks": f"""WITH e AS (SELECT user_id AS k, epoch_us(ts) // 1000 AS at_ms, event_type AS t, 1.2::DOUBLE + round(value) / 10 AS odds FROM events),
s0 AS (SELECT k, at_ms, CASE t WHEN 'view' THEN 'HT' WHEN 'click' THEN '2H' ELSE '1H' END AS state FROM e WHERE t IN ('view', 'click', 'signup')),
s1 AS (SELECT *, state IS DISTINCT FROM lag(state) OVER (PARTITION BY k ORDER BY at_ms) AS new FROM s0),
s2 AS (SELECT k, at_ms, state, lead(at_ms) OVER (PARTITION BY k ORDER BY at_ms) AS until FROM s1 WHERE new),
b AS (SELECT k, at_ms + 120000 AS due, coalesce(until, 9e15::BIGINT) AS until FROM s2 WHERE state = 'HT' AND coalesce(until, 9e15::BIGINT) > at_ms + 120000),
p AS (SELECT k, at_ms, odds FROM e WHERE t = 'purchase'),
w AS (SELECT max(at_ms) - 10000 AS wm FROM e WHERE t <> 'error'),
fired AS (SELECT b.k, b.due AS at_ms, (SELECT arg_max(odds, p.at_ms) FROM p WHERE p.k = b.k AND p.at_ms <= b.due) AS odds FROM b, w WHERE b.due <= wm OR EXISTS (SELECT 1 FROM e x WHERE x.k = b.k AND x.at_ms > b.due AND x.t <> 'error')),
rows_ AS (SELECT * FROM fired WHERE odds IS NOT NULL UNION ALL SELECT p.k, p.at_ms, p.odds FROM p JOIN b ON p.k = b.k AND p.at_ms > b.due AND p.at_ms < b.until),
m AS (SELECT k, at_ms, odds, 0.55::DOUBLE AS p, (k % 7)::DOUBLE AS h, (k % 5)::DOUBLE AS w, 24.0::DOUBLE AS clock FROM rows_),
q AS (SELECT k, at_ms, odds, {_P} AS x FROM m)
SELECT k AS match_id, at_ms, round(x, 6) AS prob, round(x * (odds - 1) - (1 - x), 6) AS ev FROM q WHERE odds > 1""",
    "str_02_rolling": """SELECT user_id, epoch_us(ts) AS at_us, round(avg(value) OVER w, 6) AS mean_before, count(*) OVER w AS n_before FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "str_05_expiry": """WITH e AS (
  SELECT user_id AS bet_id, epoch_us(ts) // 1000 AS at_ms, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'WON' ELSE 'LOST' END AS status,
    CASE WHEN user_id % 2 = 0 THEN 60 ELSE 5760 END * 60000 AS wait FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
b AS (SELECT bet_id, min(at_ms) AS placed, min(at_ms) + any_value(wait) AS due FROM e WHERE status = 'PENDING' GROUP BY bet_id),
s AS (SELECT bet_id, min(at_ms) AS at_ms FROM e JOIN b USING (bet_id) WHERE status <> 'PENDING' AND at_ms >= placed AND at_ms <= due GROUP BY bet_id)
SELECT bet_id, at_ms, status, 'settled' AS outcome FROM e JOIN s USING (bet_id, at_ms) WHERE status <> 'PENDING'
UNION ALL SELECT bet_id, due, 'VOID', 'expired' FROM b WHERE bet_id NOT IN (SELECT bet_id FROM s) AND (due <= (SELECT max(at_ms) - 60000 FROM e) OR EXISTS (SELECT 1 FROM e WHERE e.bet_id = b.bet_id AND e.at_ms > b.due))
UNION ALL SELECT e.bet_id, e.at_ms, e.status, 'late' FROM e LEFT JOIN b USING (bet_id) LEFT JOIN s ON s.bet_id = e.bet_id AND s.at_ms = e.at_ms
  WHERE e.status <> 'PENDING' AND s.at_ms IS NULL AND (placed IS NULL OR e.at_ms < placed OR e.at_ms - placed > 259200000)""",
    "str_06_digest": """WITH m AS (SELECT ts, 'user ' || user_id AS text FROM events WHERE event_type = 'error' ORDER BY ts, text LIMIT 500)
SELECT count(*) || ' alerts' || chr(10) || string_agg(text, chr(10) ORDER BY ts, text) AS message FROM m""",
    "str_07_stored": "SELECT event_id, value FROM events WHERE event_type = 'purchase'",
    "str_08_latest": "SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY user_id",
}
