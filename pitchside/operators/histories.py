"""As-of joins, last meetings, rest days, rolling statistics and clusters of a key's history."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def asof_before(probes: DataFrame, facts: DataFrame, key: str, probe_time: str, fact_time: str, values: list[str]) -> DataFrame:
    """Each probe with the values of the latest fact of its key that is strictly earlier.

    Probes and facts share one sorted exchange: a union and a window instead of a range join, so a
    key costs its rows, not their product. Facts at the probe's own time are not seen.
    """
    names = probes.columns
    fact = F.struct(F.col(fact_time).alias("at"), *values)
    rows = probes.select(F.col(key).alias("_k"), F.col(probe_time).alias("_t"), F.struct(*names).alias("_p")).unionByName(
        facts.select(F.col(key).alias("_k"), F.col(fact_time).alias("_t"), fact.alias("_f")), allowMissingColumns=True
    )
    # seconds as the range key leave everything of the same instant out
    before = Window.partitionBy("_k").orderBy(F.unix_micros(F.col("_t").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_s", F.last("_f", ignorenulls=True).over(before)).where("_p is not null")
    return seen.select("_p.*", F.col("_s.at").alias(fact_time), *[F.col(f"_s.{v}").alias(v) for v in values])


def rest_days(df: DataFrame, key: str, day: str) -> Column:
    """Days since the key's last earlier day, for a window over the rows themselves."""
    n = F.unix_date(day)
    before = Window.partitionBy(key).orderBy(n).rangeBetween(Window.unboundedPreceding, -1)
    return n - F.max(n).over(before)


def meetings(df: DataFrame, a: str, b: str, time: Column, *ties: Column) -> Window:
    """A window over the meetings of an unordered pair, in order of time."""
    return Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(time, *ties)


def previous(n: int, keys: list[str | Column], order: list[Column]) -> Window:
    """The n rows before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)


def rolling_means(df: DataFrame, keys: list[str], order: list[Column], values: list[str], sizes: list[int], digits: int = 4) -> DataFrame:
    """Means of the rows before the current one, and how many rows came before, in one sort."""
    every = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    columns = {
        f"roll_{n}_{v}": F.round(F.avg(v).over(previous(n, keys, order)), digits) for n in sizes for v in values
    }
    return df.withColumns(columns | {"games_played": F.count(F.lit(1)).over(every)})


def runs(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str = "run") -> DataFrame:
    """Number of the run of equal values that a row is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(0))
    return df.withColumn("_c", change).withColumn(name, F.sum("_c").over(w)).drop("_c")


def ratio_of_sums(top: str, bottom: str, w: Window, digits: int = 4) -> Column:
    total = F.sum(bottom).over(w)
    return F.round(F.when(total != 0, F.sum(top).over(w) / total), digits)


def anchored_clusters(df: DataFrame, keys: list[str], time: str, tie: str, minutes: int = 15) -> DataFrame:
    """Clusters of a key's rows: a row further than so many minutes from its cluster's first begins the next.

    The greedy walk reads the sorted rows of a partition as a stream and keeps the first time and row
    of the open cluster only, so a key of any length takes linear time and no memory.
    """
    limit = minutes * 60 * 1_000_000
    rows = df.select(*keys, F.col(tie).cast("long").alias(tie), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"))
    schema = StructType([*rows.drop("_t").schema.fields, StructField("cluster", LongType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, anchor, first = None, 0, 0
        for pdf in batches:
            found = []
            for *key, i, t in pdf.itertuples(index=False):
                if key != open_ or t - anchor > limit:
                    open_, anchor, first = key, t, i
                found.append(first)
            yield pdf.drop(columns="_t").assign(cluster=found)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "_t", tie).mapInPandas(walk, schema)


def near_pairs(df: DataFrame, keys: list[str], time: str, tie: str, minutes: int = 15) -> DataFrame:
    """Pairs of a key's rows at most so many minutes apart, earlier first.

    Times fall into bins of that length, so pairs are looked for in a bin and the next one only.
    """
    limit = minutes * 60
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000
    rows = df.select(*keys, F.col(tie).alias("i"), seconds.alias("s")).withColumn("bin", F.floor(F.col("s") / limit))
    x = rows.select(*keys, F.col("i").alias("a"), F.col("s").alias("sa"), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"))
    y = rows.select(*keys, F.col("i").alias("b"), F.col("s").alias("sb"), "bin")
    later = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    return x.join(y, [*keys, "bin"]).where(later & (F.col("sb") - F.col("sa") <= limit)).select(*keys, "a", "b")


def placed(df: DataFrame, day: Column, tie: str) -> DataFrame:
    """df with day_, position_ (0-based, by day and tie) and n_ (all rows).

    Places come from the counts of days, a small table, and a window within each day, so no task
    sorts all rows.
    """
    rows = df.withColumn("day_", day)
    days = rows.groupBy("day_").agg(F.count(F.lit(1)).alias("here_"))
    upto = Window.orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("day_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = days.select("day_", F.coalesce(F.sum("here_").over(upto), F.lit(0)).alias("before_"), F.sum("here_").over(whole).alias("n_"))
    within = F.row_number().over(Window.partitionBy("day_").orderBy(tie)) - 1
    return rows.withColumn("within_", within).join(starts, "day_").withColumn("position_", F.col("before_") + F.col("within_")).drop("before_", "within_")


def fold_of(n: Column, k: int, position: Column) -> Column:
    """Test fold of a row by its 0-based position among n rows (null: training only)."""
    size = F.floor(n / (k + 1))
    first = n - size * k
    return F.when(position >= first, F.floor((position - first) / size) + 1)


def product(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, terms)
