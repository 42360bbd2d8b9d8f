"""Readers of raw files and feeds, all as strings first, typed by the cleaning functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import cleaning as C


def csv_rows(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Rows of all CSV files of a folder as strings, with the file's name."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").option("pathGlobFilter", glob).csv(path)
    return rows.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where none of the columns is null or blank."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.trim(c) != ""))
    return df


def football_matches(rows: DataFrame) -> DataFrame:
    """Typed football matches: dates in any of the formats, seasons, scores and a map of closing odds."""
    day = C.parsed_date(F.col("Date"))
    odds_columns = [c for c in rows.columns if c[-1:] in "HDA" and c[:-1] in ("B365", "BW", "GB", "IW", "LB", "SB", "WH", "SJ", "VC", "BS")]
    entries = F.array(*[F.struct(F.lit(c.lower()).alias("k"), C.safe_float(F.col(c)).alias("v")) for c in odds_columns]) if odds_columns else F.array().cast("array<struct<k:string,v:double>>")
    return required(rows, "HomeTeam", "AwayTeam", "Date").select(
        C.season_in_name(F.col("source_file"), day).alias("season"),
        F.col("Div").alias("division"),
        day.alias("match_date"),
        F.trim("HomeTeam").alias("home_team"),
        F.trim("AwayTeam").alias("away_team"),
        C.safe_int(F.col("FTHG"), None).cast("int").alias("home_score"),
        C.safe_int(F.col("FTAG"), None).cast("int").alias("away_score"),
        F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("odds"),
        "source_file",
    )


ODDS_EVENTS = """id string, home_team string, away_team string, commence_time string,
  bookmakers array<struct<key: string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: double>>>>>>"""


def odds_events(spark: SparkSession, path: str) -> DataFrame:
    """Prices of nested odds events, one row each; broken records are left out."""
    events = spark.read.schema(ODDS_EVENTS + ", _corrupt_record string").option("multiLine", False).json(path)
    return (
        events.where("id is not null")
        .select("id", "home_team", "away_team", F.try_to_timestamp("commence_time").alias("starts"), F.explode("bookmakers").alias("b"))
        .select("id", "home_team", "away_team", "starts", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
        .select("id", "home_team", "away_team", "starts", "book", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
        .select(
            "id", "starts", "book", "market",
            F.when(F.col("o.name") == F.col("home_team"), "home").when(F.col("o.name") == F.col("away_team"), "away").otherwise(F.lower("o.name")).alias("selection"),
            F.col("o.price").alias("odds"),
        )
    )
