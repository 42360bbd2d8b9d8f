"""Places of rows within their keys, without a task for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.common import cut


def salted(df: DataFrame) -> DataFrame:
    """df with salt, which parts equal rows; to be written with cut() before it is used."""
    return df.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))


def parts_of(df: DataFrame, rows: int) -> int:
    """Ranges of about so many rows; at least one for each core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def placed(df: DataFrame, key: str, order: list[str], rows: int) -> tuple[DataFrame, DataFrame, int]:
    """df in the order of key, order and salt, dealt to ranges of about so many rows, however often
    one key occurs. df: a written table with salt.

    Gives the table with part (the range) and at (its place); for each part and key there: first (the
    least at), cnt, begin (rows of the key in parts before) and n (all rows of the key); and the
    number of parts, which are numbered from 0.
    """
    ordered = cut(
        df.repartitionByRange(parts_of(df, rows), key, *order, "salt")
        .sortWithinPartitions(key, *order, "salt")
        .drop("salt")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33).cast("int"))
    )
    before = Window.partitionBy(key).orderBy("part")
    starts = (
        ordered.groupBy("part", key)
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("cnt"))
        .withColumn("begin", F.sum("cnt").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cnt"))
        .withColumn("n", F.sum("cnt").over(Window.partitionBy(key)))
    )
    starts = cut(starts)
    return ordered, starts, (starts.agg(F.max("part")).first()[0] or 0) + 1
