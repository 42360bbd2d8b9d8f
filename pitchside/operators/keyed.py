"""Latest, best and first rows of a key: aggregates that combine on the map side before the shuffle.

Rows as structs make Spark sort its (already combined) groups; a window would sort and shuffle every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Of each key the columns keep of the row that is greatest by order."""
    row = F.max_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(row.alias("r")).select(*keys, "r.*")


def best_price(df: DataFrame, keys: list[str], odds: str, book: str) -> DataFrame:
    """The highest odds of each key, the least book that has them, and the number of offers."""
    return df.groupBy(*keys).agg(
        F.max(odds).alias("best_odds"),
        F.max_by(book, F.struct(F.col(odds), (-F.col(book)).alias("b"))).alias("best_book"),
        F.count(F.lit(1)).alias("n_offers"),
    )


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows, by TakeOrderedAndProject."""
    return df.orderBy(*order).limit(k)


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def union_first(sources: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of all sources, those of the first source of each key; then by order."""
    tagged = [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s)
    rest = [c for c in every.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct("priority", *order))
    return every.groupBy(*keys).agg(row.alias("r")).select(*keys, "r.*")


def merged_maps(df: DataFrame, keys: list[str], map_column: str, order: list[Column]) -> DataFrame:
    """One map of each key: of every entry the value of the last row that has it."""
    entries = df.select(*keys, F.explode(map_column).alias("k", "v"), F.struct(*order).alias("o"))
    last = entries.groupBy(*keys, "k").agg(F.max_by("v", "o").alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(map_column))


def ranked_upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], status: str, ranks: dict[str, int]) -> DataFrame:
    """New values win; a status moves up its rank only. Keys of either side stay."""
    rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    o = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in [*values, status]])
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in [*values, status]])
    ns, os_ = F.col(f"new_{status}"), F.col(f"old_{status}")
    return o.join(n, keys, "full").select(
        *keys,
        *[F.coalesce(F.col(f"new_{c}"), F.col(f"old_{c}")).alias(c) for c in values],
        F.when(ns.isNull(), os_).when(os_.isNull() | (rank[ns] >= rank[os_]), ns).otherwise(os_).alias(status),
    )
