import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitchside.functions import registry as G
from pitchside.streaming import timers

T0 = dt.datetime(2024, 5, 1, 12, 0)
STATES = f"match_id long, at timestamp, {timers.MATCH}"


@pytest.fixture()
def stateful(spark):
    key, value = timers.STATE_STORE
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(key, old)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def at(minutes=0, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def put(spark, folder, schema, *files):
    """One file for each micro-batch."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def collect(df, name, checkpoint):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return df.sparkSession.table(name).collect()


def test_a_break_gives_a_value_though_nothing_follows(stateful, tmp_path):
    spark = stateful
    base = tmp_path.as_uri()
    row = lambda m, t, state, home=1, away=0: (m, t, "football", 0.5, home, away, 45.0, state, {"home_xg": 1.2, "away_xg": 0.4})
    states = [[row(1, at(0), "1H", 0), row(1, at(45), "HT"), row(2, at(45), "HT"), row(3, at(45), "HT")], [row(2, at(46), "2H"), row(9, at(60), "1H")]]
    prices = [[(1, at(44), 1.8), (1, at(45, 30), 1.9), (2, at(45), 2.0)], [(1, at(48), 2.2), (9, at(60), 3.0)]]
    put(spark, f"{base}/s", STATES, *states)
    put(spark, f"{base}/p", "match_id long, at timestamp, odds double", *prices)
    live = timers.live_values(stream(spark, f"{base}/s", STATES), stream(spark, f"{base}/p", "match_id long, at timestamp, odds double"))
    got = {(r["match_id"], r["at"]): r["ev"] for r in collect(live, "live_rows", f"{base}/c")}
    # match 1 by its timer and by the later price; 2 left its break before; 3 has no price
    assert set(got) == {(1, at(47)), (1, at(48))}
    m = spark.createDataFrame(states[0][1:2], STATES)
    for odds, when in ((1.9, at(47)), (2.2, at(48))):
        want = m.select(G.live_value(F.col("sport"), F.col("prior"), F.col("home"), F.col("away"), F.col("clock"), F.lit(odds), F.col("stats"))["ev"]).first()[0]
        assert got[1, when] == want


def test_bets_expire_and_late_results_go_aside(stateful, tmp_path):
    spark = stateful
    base = tmp_path.as_uri()
    schema = "bet_id long, ledger string, status string, at timestamp"
    day = 24 * 60
    first = [(1, "REAL", "PENDING", at(0)), (2, "REAL", "PENDING", at(0)), (2, "REAL", "PENDING", at(5)), (3, "PAPER", "PENDING", at(0)), (4, "PAPER", "PENDING", at(1)), (5, "REAL", "LOST", at(2))]
    second = [(1, "REAL", "WON", at(30)), (4, "PAPER", "LOST", at(2 * day)), (6, "REAL", "PENDING", at(2 * day))]
    third = [(1, "REAL", "WON", at(2 * day + 5)), (2, "REAL", "WON", at(3 * day + 60)), (7, "REAL", "PENDING", at(5 * day))]
    last = [(3, "PAPER", "WON", at(6 * day)), (8, "REAL", "PENDING", at(6 * day))]
    put(spark, f"{base}/b", schema, first, second, third, last)
    timers.routed(timers.expiring(stream(spark, f"{base}/b", schema)), F.col("outcome") != "late", {True: f"{base}/out", False: f"{base}/late"}, f"{base}/c")
    own = {(r["bet_id"], r["status"], r["at"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert own == {
        (1, "WON", at(30)), (2, "VOID", at(60)), (4, "LOST", at(2 * day)), (6, "VOID", at(2 * day + 60)), (3, "VOID", at(4 * day)), (7, "VOID", at(5 * day + 60)),
    }
    assert {(r["bet_id"], r["status"]) for r in spark.read.parquet(f"{base}/late").collect()} == {(5, "LOST"), (2, "WON"), (3, "WON")}


def test_a_replayed_digest_is_sent_once(spark, tmp_path):
    base = tmp_path.as_uri()
    rows = [(at(i), f"alert {i}") for i in range(4)]
    put(spark, f"{base}/a", "at timestamp, text string", rows[:1], rows[1:])
    timers.digests(stream(spark, f"{base}/a", "at timestamp, text string"), f"{base}/sent", f"{base}/c", "at", "text")
    want = {(0, "alert 0"), (1, "3 alerts\nalert 1\nalert 2\nalert 3")}
    sent = lambda: sorted((r["batch"], r["message"]) for r in spark.read.parquet(f"{base}/sent").collect())
    assert sent() == sorted(want)
    timers.digest_batch(spark.createDataFrame(rows[1:], "at timestamp, text string"), 1, f"{base}/sent", "at", "text")
    assert sent() == sorted(want)
