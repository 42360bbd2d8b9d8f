"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources, in code point order with null last, weigh 3, 1, 2, 3, 1, 2 ... and share RATIO of all
words; a target stops at REPEATS times its source's words and the excess goes to the others by
weight. Every source is permuted by the MD5 of its documents' ids and texts and dealt into blocks
of about BLOCK_WORDS words by the first hexadecimal digits, as many as its size asks for. A quota
of a source is so many whole epochs of its blocks and a part of one more, the blocks before a cut.

A splitting tree divides the quotas of all sources between the halves of the output shards by
multivariate hypergeometric draws, and so on to single shards; the driver draws the top of the
tree, tasks the subtrees below. A shard draws the places that its counts give it of the permuted
blocks of each source, so no two shards draw one block copy, and is put in random order locally.
What the mix takes of a document is what the shards drew of its block; in the block at the cut it is
the documents before it, found by the next digits.

The driver and one broadcast hold one row for each source (name, words, quota), nothing that grows
with the documents; TOP_NODES bounds the nodes of the tree there. Reruns agree: every draw depends on
ids, texts and SEED only.

Size: runs of characters other than blank and 09 to 0D; null and empty texts have size 0. Repeated
rows are separate rows with one place in the permutation; rows without an id have places by their
texts. Without any words all targets are 0. Extra columns are kept by mix().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchside.llm.common import cut, table

WEIGHTS = (3.0, 1.0, 2.0)
RATIO = 1.5
REPEATS = 2
SEED = 11
#: Words of a block and bytes of text of an output shard, about.
BLOCK_WORDS = 100_000
SHARD_BYTES = 64_000_000
#: Hexadecimal digits that part the documents of a cut block.
DIGITS = 3
#: Nodes of the splitting tree that the driver draws.
TOP_NODES = 256


def targets(totals: list[tuple[str | None, int]]) -> list[tuple[str | None, int, float]]:
    """Source, words and target of each, in order."""
    rows = sorted(totals, key=lambda r: (r[0] is None, r[0] or ""))
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]
    cap = [float(REPEATS * r[1]) for r in rows]
    left, share = RATIO * sum(r[1] for r in rows), sum(weight)
    target = [0.0] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: cap[i] / weight[i]):
        if cap[i] * share <= left * weight[i]:  # it stops at its cap
            target[i], left, share = cap[i], left - cap[i], share - weight[i]
        else:
            target[i] = weight[i] * left / share
    return [(r[0], r[1], t) for r, t in zip(rows, target, strict=True)]


def subtrees(quota: np.ndarray, begin: np.ndarray, a: int, b: int, most: int = 1, seed: int = SEED) -> Iterator[tuple]:
    """The splitting tree over shards a to b, down to nodes of so many shards: a, b, and for each
    source the blocks of the node and the place where they begin."""
    if b - a <= most:
        yield a, b, quota, begin
        return
    mid = (a + b) // 2
    n = int(quota.sum()) * (mid - a) // (b - a)
    rng = np.random.default_rng([seed, a, b])
    left = rng.multivariate_hypergeometric(quota, n, method="marginals") if n else np.zeros_like(quota)
    yield from subtrees(left, begin, a, mid, most, seed)
    yield from subtrees(quota - left, begin + left, mid, b, most, seed)


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns)."""
    quotas = np.asarray(quotas, np.int64)
    nodes = list(subtrees(quotas, np.zeros_like(quotas), 0, shards, 1, seed))
    return np.stack([q for _, _, q, _ in nodes], axis=1)


def draws(spark: SparkSession, names: list[str], quotas: np.ndarray, shards: int) -> DataFrame:
    """s, place and shard of every block copy that a shard draws; disjoint, quotas exact."""
    none = np.zeros_like(quotas)
    top = [(a, b, q.tolist(), begin.tolist()) for a, b, q, begin in subtrees(quotas, none, 0, shards, -(-shards // TOP_NODES))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, quota, begin in pdf.itertuples(index=False):
                for shard, _, n, at in subtrees(np.array(quota, np.int64), np.array(begin, np.int64), a, b):
                    of = np.repeat(np.arange(len(n)), n)
                    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + at[of]
                    yield pd.DataFrame({"s": np.array(names, object)[of], "place": place, "shard": np.int32(shard)})

    nodes = spark.createDataFrame(top if names else [], "a int, b int, quota array<long>, begin array<long>")
    return nodes.repartition(max(1, min(len(top), 64))).mapInPandas(run, "s string, place long, shard int")


def keyed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with s (the source, never null) and h (the place in its permutation)."""
    own = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return docs.withColumn("s", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))).withColumn("h", F.md5(own.cast("binary")))


class Mix:
    """The blocks of all sources and what each shard draws of them.

    sized: doc_id, source, size, s, h of each row. goals: one row for each source: s, source_size,
    target, full (whole epochs), rest (words of the part of one more), digits (of a block's name).
    handed: for each block s, d1 and drawn, the (epoch, shard) of its copies; and in the block of the
    cut also at (the h of the document there), left (words missing there), words and rows of that h.
    """

    def __init__(self, docs: DataFrame, shards: int | None = None):
        spark = docs.sparkSession
        size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        self.sized = cut(
            keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))
            .select("doc_id", "source", size.alias("size"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "s", "h")
        )
        per_source = self.sized.groupBy("s").agg(F.sum("size").alias("words"), F.sum("bytes").alias("bytes")).collect()
        totals = {r["s"][1:] if r["s"] else None: int(r["words"]) for r in per_source}
        volume = RATIO * sum(r["bytes"] for r in per_source)
        self.shards = shards or max(1, int(-(-volume // SHARD_BYTES)))
        rows = []
        for source, words, target in targets(list(totals.items())):
            goal = int(np.floor(target + 0.5))
            full = min(goal // words, REPEATS) if words else 0
            digits = max(1, int(np.ceil(np.log(max(words, 1) / BLOCK_WORDS) / np.log(16))))
            rows.append(("" if source is None else "=" + source, words, target, full, goal - full * words, digits))
        self.goals = spark.createDataFrame(rows, "s string, source_size long, target double, full int, rest long, digits int")
        named = self.in_blocks(self.sized)
        before = Window.partitionBy("s").orderBy("d1").rowsBetween(Window.unboundedPreceding, -1)
        missing = F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))
        blocks = cut(
            named.groupBy("s", "d1").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("full").alias("full"))
            .withColumn("missing", missing)
            .select("s", "d1", "full", "missing", (F.col("missing") > 0).alias("part"), ((F.col("missing") > 0) & (F.col("missing") < F.col("words"))).alias("open"))
        )
        counts = {r["s"]: r["n"] for r in blocks.groupBy("s").agg(F.sum(F.col("full") + F.col("part").cast("int")).alias("n")).collect()}
        names = [r[0] for r in rows]
        quotas = np.array([counts.get(s, 0) for s in names], np.int64)
        order = Window.partitionBy("s").orderBy(F.xxhash64("s", "d1", "epoch", F.lit(SEED)), "d1", "epoch")
        copies = blocks.select(
            "s", "d1", F.explode(F.slice(F.array(*[F.lit(e) for e in range(REPEATS + 1)]), 1, F.col("full") + F.col("part").cast("int"))).alias("epoch")
        ).withColumn("place", F.row_number().over(order).cast("long") - 1)
        drawn = (
            copies.join(draws(spark, names, quotas, self.shards), ["s", "place"])
            .groupBy("s", "d1")
            .agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("drawn"))
        )
        self.handed = cut(
            blocks.join(drawn, ["s", "d1"], "left").join(self._cuts(named, blocks.where("open")), ["s", "d1"], "left").select("s", "d1", "full", "drawn", "at", "left", "words", "rows")
        )

    def in_blocks(self, rows: DataFrame) -> DataFrame:
        """rows with the goals of their source and d1, the name of their block."""
        return rows.join(F.broadcast(self.goals), "s").withColumn("d1", F.expr("substr(h, 1, digits)"))

    def _cuts(self, named: DataFrame, blocks: DataFrame) -> DataFrame:
        """Where the last epoch ends in the blocks given, at most one a source: s, d1, at, left, words, rows."""
        inner = named.join(F.broadcast(blocks.select("s", "d1", "missing")), ["s", "d1"])
        inner = inner.withColumn("d2", F.expr(f"substr(h, digits + 1, {DIGITS})"))

        def at_cut(level: DataFrame, key: str) -> DataFrame:
            before = F.coalesce(F.sum("words").over(Window.partitionBy("s", "d1").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            return level.withColumn("left", F.col("missing") - before).where("left > 0 and left <= words")

        part = at_cut(inner.groupBy("s", "d1", "d2", "missing").agg(F.sum("size").alias("words")), "d2")
        deep = inner.drop("missing").join(F.broadcast(part.select("s", "d1", "d2", F.col("left").alias("missing"))), ["s", "d1", "d2"])
        return at_cut(
            deep.groupBy("s", "d1", "h", "missing").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "h"
        ).select("s", "d1", F.col("h").alias("at"), "left", "words", "rows")

    @staticmethod
    def copies(last: Column) -> Column:
        """The shards of the copies that a row gets; last: whether its last epoch's copy is one."""
        drawn = F.filter("drawn", lambda x: (x["epoch"] < F.col("full")) | last)
        return F.coalesce(F.transform(drawn, lambda x: x["shard"]), F.array().cast("array<int>"))


def plan(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, shards.

    taken: words that the shards drew; the document at the cut gives just as many of its words as are
    missing. shards: the shard of each copy.
    """
    m = Mix(docs, shards)
    rows = m.in_blocks(m.sized).drop("full").join(m.handed, ["s", "d1"])
    below = F.col("at").isNull() | (F.col("h") < F.col("at"))
    plain = rows.where(below | (F.col("h") > F.col("at"))).withColumn("part", F.when(below, F.col("size")).otherwise(F.lit(0)))
    # rows alike in id and text share the place of the cut: one after the other
    nth = F.row_number().over(Window.partitionBy("s").orderBy("doc_id")) - 1
    equal = rows.where("h = at").withColumn("part", F.least(F.greatest(F.col("left") - nth * F.col("size"), F.lit(0)), F.col("size")))
    both = plain.unionByName(equal).withColumn("shards", m.copies(F.col("part") > 0))
    words = F.aggregate("drawn", F.lit(0).cast("long"), lambda n, x: n + F.when(x["epoch"] < F.col("full"), F.col("size")).otherwise(F.col("part")))
    return both.select("doc_id", "source", "size", "source_size", "target", F.coalesce(words, F.lit(0)).alias("taken"), "shards")


def mix(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mixed rows: each row of docs as often as the mix takes it, whole, in shuffled shards.

    The document at the cut is taken if at least half of its words are missing. A shard is one
    partition of the result, in random order.
    """
    m = Mix(docs, shards)
    names = docs.columns
    c = [f"c{i}" for i in range(len(names))]
    rows = keyed(docs.toDF(*c), *[c[names.index(x)] for x in ("doc_id", "source", "text")])
    last = F.col("at").isNull() | (F.col("h") < F.col("at")) | ((F.col("h") == F.col("at")) & (2 * F.col("left") >= F.col("words")))
    return (
        m.in_blocks(rows)
        .drop("full")
        .join(m.handed.where("drawn is not null").hint("shuffle_hash"), ["s", "d1"])
        .select(*c, "h", F.posexplode(m.copies(last)).alias("copy", "shard"))
        .repartitionById(m.shards, F.col("shard"))
        .sortWithinPartitions("shard", F.xxhash64("h", "copy", F.lit(SEED)))
        .select(*c)
        .toDF(*names)
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards: the numbers of the shards that drew the document, a number for each copy."""
    return plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards")
    )


QUERIES = {"op8_mixing": op8}
#: The sizes, targets and words taken, without the tree: the test's independent account of them.
CONTRACT_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS words,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sized GROUP BY source),
capped AS (
  SELECT *, 2.0::DOUBLE * words AS cap, sum(1.5::DOUBLE * words) OVER () AS everything FROM totals),
runs AS (
  SELECT *,
    everything - coalesce(sum(cap) OVER before, 0) AS room, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS share
  FROM capped
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT room, share FROM runs WHERE cap * share > room * w ORDER BY cap / w, source NULLS LAST LIMIT 1),
goals AS (
  SELECT r.source, r.words, CASE WHEN l.room IS NULL OR r.cap * r.share <= r.room * r.w THEN r.cap ELSE r.w * l.room / l.share END AS target
  FROM runs r LEFT JOIN level l ON true),
cuts AS (
  SELECT *, floor(target + 0.5)::BIGINT AS goal, CASE WHEN words > 0 THEN least(floor(target + 0.5)::BIGINT // words, 2) ELSE 0 END AS full_copies FROM goals)
SELECT s.doc_id, s.size, g.words AS source_size, g.target,
  (g.full_copies * s.size + least(greatest(g.goal - g.full_copies * g.words
    - coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), s.size))::BIGINT AS taken
FROM sized s JOIN cuts g ON s.source IS NOT DISTINCT FROM g.source
"""
