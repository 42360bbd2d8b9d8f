"""The driver's tables in the roles of the domain, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers: match, selection, book, odds, when they were seen, live or not."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"),
        F.col("l_linenumber").alias("selection"),
        F.col("l_suppkey").alias("book"),
        F.round(1.01 + F.col("l_quantity") / 10, 4).alias("odds"),
        F.col("l_shipdate").alias("scraped_at"),
        (F.col("l_linestatus") == "O").alias("is_live"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("price"),
    )


PRICES = """prices AS (
  SELECT l_orderkey AS match_id, l_linenumber AS selection, l_suppkey AS book,
         round(1.01 + l_quantity / 10, 4) AS odds, l_shipdate AS scraped_at,
         l_linestatus = 'O' AS is_live, l_partkey AS part, l_extendedprice AS price
  FROM lineitem)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches of two teams, with scores."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("match_id"),
        F.col("o_custkey").alias("home"),
        (F.col("o_custkey") % 25).alias("league"),
        ((F.col("o_custkey") * 7 + o) % 40).alias("away"),
        F.col("o_orderdate").alias("scheduled_at"),
        F.when(F.col("o_orderstatus") == "O", "not_started").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("finished").alias("state"),
        F.when(o % 11 != 0, o % 5).cast("int").alias("home_score"),
        F.when(o % 11 != 0, F.col("o_custkey") % 4).cast("int").alias("away_score"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("priority"),
    )


MATCHES = """matches AS (
  SELECT o_orderkey AS match_id, o_custkey AS home, o_custkey % 25 AS league,
         (o_custkey * 7 + o_orderkey) % 40 AS away, o_orderdate AS scheduled_at,
         CASE o_orderstatus WHEN 'O' THEN 'not_started' WHEN 'P' THEN 'in_progress' ELSE 'finished' END AS state,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 5 END::INT AS home_score,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 4 END::INT AS away_score,
         o_totalprice AS total, o_orderpriority AS priority
  FROM orders)"""


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as bets: money in whole cents, odds in hundredths."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("book"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("model_"), F.col("l_suppkey") % 6).alias("model"),
        F.when(F.col("l_linestatus") == "F", "REAL").otherwise("PAPER").alias("ledger"),
        F.when(F.col("l_returnflag") == "A", "WON").when(F.col("l_returnflag") == "R", "LOST").otherwise("PENDING").alias("status"),
        F.round(F.col("l_extendedprice") / 10).cast("long").alias("stake_c"),
        F.round(101 + F.col("l_quantity") * 10).cast("long").alias("odds_h"),
        F.round(F.col("l_quantity") / 51, 6).alias("p"),
        F.col("l_shipdate").alias("placed_at"),
    )


BETS = """bets AS (
  SELECT l_orderkey AS match_id, l_partkey AS part, l_suppkey AS book, l_linenumber AS line,
         'model_' || (l_suppkey % 6) AS model,
         CASE l_linestatus WHEN 'F' THEN 'REAL' ELSE 'PAPER' END AS ledger,
         CASE l_returnflag WHEN 'A' THEN 'WON' WHEN 'R' THEN 'LOST' ELSE 'PENDING' END AS status,
         round(l_extendedprice / 10)::BIGINT AS stake_c, round(101 + l_quantity * 10)::BIGINT AS odds_h,
         round(l_quantity / 51, 6) AS p, l_shipdate AS placed_at
  FROM lineitem)"""
#: Columns that tell bets apart.
BET_KEY = ["match_id", "part", "book", "line", "stake_c", "odds_h", "placed_at"]


def pnl_cents():
    """Profit in cents, half to even (odds in hundredths, stake in cents)."""
    return F.when(F.col("status") == "WON", F.bround((F.col("stake_c") * (F.col("odds_h") - 100)).cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)"), 0).cast("long")).when(
        F.col("status") == "LOST", -F.col("stake_c")
    ).otherwise(F.lit(0))


_V = "(stake_c * (odds_h - 100))"
PNL_CENTS = f"""(CASE status WHEN 'WON' THEN {_V} // 100 + CASE WHEN {_V} % 100 > 50 OR ({_V} % 100 = 50 AND ({_V} // 100) % 2 = 1) THEN 1 ELSE 0 END
  WHEN 'LOST' THEN -stake_c ELSE 0 END)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
