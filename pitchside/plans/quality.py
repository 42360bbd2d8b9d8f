"""Queries over data quality and merging: coverage, gates, gaps, upserts, re-keying, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import cleaning as C
from pitchside.operators import keyed
from pitchside.plans.adapters import BETS, MATCHES, bets, events, matches, table
from pitchside.sources.scan import file_counts, scan
from pitchside.sources.scratch import scratch


def _coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live and historical rows with what each of them has (SET-02)."""
    m = matches(spark, sf_dir)
    live = m.select(
        F.col("league").alias("sport"), F.lit("live").alias("kind"), (F.col("home_score").isNotNull() & F.col("away_score").isNotNull()).alias("score"),
        (F.col("match_id") % 5 != 0).alias("halftime"), (F.col("total") > 30_000).alias("features"), (F.length(F.col("home").cast("string")) > 2).alias("canonical"),
        ((F.col("state") == "not_started") & (F.col("scheduled_at") < F.lit("1996-01-01").cast("timestamp_ntz"))).alias("stale"),
    )
    past = events(spark, sf_dir).select(
        (F.col("user_id") % 25).alias("sport"), F.lit("past").alias("kind"), F.lit(True).alias("score"), (F.col("value") > 5).alias("halftime"),
        (F.col("event_type") != "error").alias("features"), F.lit(True).alias("canonical"), F.lit(False).alias("stale"),
    )
    return live.unionByName(past)


COVERAGE = f"""{MATCHES}, rows_ AS (
  SELECT league AS sport, 'live' AS kind, home_score IS NOT NULL AND away_score IS NOT NULL AS score, match_id % 5 <> 0 AS halftime, total > 30000 AS features,
         length(home::VARCHAR) > 2 AS canonical, state = 'not_started' AND scheduled_at < TIMESTAMP '1996-01-01' AS stale FROM matches
  UNION ALL SELECT user_id % 25, 'past', true, value > 5, event_type <> 'error', true, false FROM events)"""
_PARTS = ("score", "halftime", "features", "canonical")
_SLO = {"score": 0.95, "halftime": 0.80, "features": 0.70, "canonical": 0.98}


def agg_14_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _coverage_rows(spark, sf_dir).groupBy("sport").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "live").alias("n_live"),
        *[F.round(F.count_if(F.col(c)) / F.count(F.lit(1)), 4).alias(f"{c}_ratio") for c in _PARTS], F.count_if("stale").alias("n_stale"),
    )
    return g


def agg_15_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service levels that are missed, and what may run (AGG-15)."""
    c = agg_14_coverage(spark, sf_dir)
    missed = C.failures(*[(F.col(f"{n}_ratio") >= v, n) for n, v in _SLO.items()], (F.col("n_stale") == 0, "stale"))
    return c.select(
        "sport", missed.alias("violations"), ((F.col("features_ratio") >= 0.70) & (F.col("canonical_ratio") >= 0.98)).alias("can_train"), (F.col("canonical_ratio") >= 0.98).alias("can_predict")
    )


def agg_16_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each match and kind of gap."""
    m = matches(spark, sf_dir)
    before = F.col("scheduled_at") < F.lit("1996-01-01").cast("timestamp_ntz")
    kinds = F.array_compact(F.array(
        F.when((F.col("state") == "finished") & F.col("home_score").isNull(), F.lit("no_score")), F.when((F.col("state") == "not_started") & before, F.lit("stale")),
        F.when(F.col("total") < 20_000, F.lit("no_stats")), F.when(F.col("home") % 13 == 0, F.lit("no_odds")),
    ))
    return m.select("match_id", F.explode(kinds).alias("gap_type"))


def agg_24_kanban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by state and whether they have bets (AGG-24, SET-05)."""
    has = bets(spark, sf_dir).select("match_id").distinct().withColumn("has", F.lit(True))
    return matches(spark, sf_dir).join(has, "match_id", "left").groupBy("state", F.coalesce("has", F.lit(False)).alias("has_bets")).agg(F.count(F.lit(1)).alias("n"), F.min("match_id").alias("first_match"))


def agg_25_feature_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the wanted keys that a row has, and whether it is half of them (AGG-25, FLT-12)."""
    n = F.col("event_id")
    have = F.array_compact(F.array(*[F.when(n % k != 0, F.lit(f"k{k}")) for k in (2, 3, 5, 7, 11)]))
    return events(spark, sf_dir).select("event_id", F.round(F.size(have) / 5, 2).alias("ratio"), (F.size(have) >= 2.5).alias("enough"))


def agg_19_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("n_nations"))


def agg_30_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How names were resolved (AGG-30)."""
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit(1).alias("known"))
    raw = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("k"), "c_custkey")
    how = F.when(F.col("known").isNotNull(), "exact").when(F.col("c_custkey") % 2 == 0, "registered").otherwise("unresolved")
    return raw.join(known, "k", "left").groupBy(how.alias("resolution")).agg(F.count(F.lit(1)).alias("n"))


def snk_06_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each month and what is left of its budget (SNK-06, SRC-11)."""
    g = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("used"))
    return g.withColumn("left", F.greatest(F.lit(0), 5_000 - F.col("used")))


def src_13_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that knows a match's score (SRC-13)."""
    m = matches(spark, sf_dir).select("match_id")
    source = lambda i, k: m.where(F.col("match_id") % k == 0).select("match_id", F.struct((F.col("match_id") % (7 + i)).alias("score"), F.lit(f"s{i}").alias("source")).alias(f"r{i}"))
    got = m
    for i, k in enumerate((2, 3, 5)):
        got = got.join(source(i, k), "match_id", "left")
    return got.withColumn("r", F.coalesce("r0", "r1", "r2")).where("r is not null").select("match_id", "r.score", "r.source")


def ups_01_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows merged with new ones by key: new values win, missing ones keep the old (UPS-01, UPS-03)."""
    m = matches(spark, sf_dir).select("match_id", "home_score", "away_score")
    old = m.where("match_id % 3 <> 0").select("match_id", *[F.col(c).alias(f"o_{c}") for c in ("home_score", "away_score")])
    new = m.where("match_id % 2 = 0").select("match_id", (F.col("home_score") + 1).alias("home_score"), F.when(F.col("match_id") % 4 == 0, F.col("away_score")).alias("away_score"))
    return old.join(new, "match_id", "full").select("match_id", *[F.coalesce(c, f"o_{c}").alias(c) for c in ("home_score", "away_score")])


def ups_10_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets of duplicate matches moved to the first of their key (UPS-10)."""
    m = matches(spark, sf_dir).select("match_id", "home", "away", F.to_date("scheduled_at").alias("day"))
    keep = m.groupBy("home", "away").agg(F.min("match_id").alias("keeper"))
    moved = m.join(keep, ["home", "away"]).select("match_id", "keeper")
    return bets(spark, sf_dir).join(moved, "match_id").groupBy("keeper").agg(F.count(F.lit(1)).alias("n_bets"), F.count_distinct("match_id").alias("n_matches"))


def join_12_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows whose key is not there yet (JOIN-12)."""
    b = bets(spark, sf_dir)
    there = b.where("book % 2 = 0").select("match_id", "line").distinct()
    return b.where("book % 2 = 1").select("match_id", "line").distinct().join(there, ["match_id", "line"], "left_anti")


def join_20_self_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of a game as one, home side first (JOIN-20)."""
    l = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    row = F.struct("l_quantity", "l_partkey", "l_suppkey")
    g = l.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_linenumber") == 1, row)).alias("h"), F.min(F.when(F.col("l_linenumber") == 2, row)).alias("a"))
    return g.where("h is not null and a is not null").select("l_orderkey", F.col("h.l_partkey").alias("home"), F.col("a.l_partkey").alias("away"))


def set_03_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sports and days of three lists of gaps (SET-03)."""
    m = matches(spark, sf_dir).select("league", F.date_trunc("month", "scheduled_at").cast("timestamp_ntz").alias("month"), "match_id")
    lists = [m.where(F.col("match_id") % k == 0).select("league", "month") for k in (7, 11, 13)]
    return lists[0].union(lists[1]).union(lists[2]).distinct()


def set_06_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a user's events in the order of their first use (SET-06, UPS-14)."""
    e = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("sources"))


def src_07_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, written as CSV files by segment, scanned as one table: rows, rejects and sums of each segment (SRC-01, SRC-05, SRC-07)."""
    path = scratch(spark)
    balance = F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal"))
    table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_custkey").alias("Key"), F.concat(F.lit("Zo\u00eb, "), "c_name").alias("Name"), balance.alias("Balance")).write.partitionBy("c_mktsegment").option("header", True).csv(path)
    rows, _ = scan(spark, path, needs=("Key", "Balance"))
    part = F.url_decode(F.regexp_extract("source_file", "c_mktsegment=([^/]+)/", 1))
    good = rows.where(F.size("missing") == 0)
    per_file = file_counts(rows).withColumn("segment", part).groupBy("segment").agg(F.sum("rows").alias("n_rows"), F.sum("rejected").alias("rejected"), F.sum("bad_bytes").alias("bad_bytes"))
    sums = good.groupBy(part.alias("segment")).agg(F.round(F.sum(F.col("cells")["Balance"].cast("double")), 2).alias("balance"), F.max(F.col("cells")["Name"]).alias("last_name"))
    return per_file.join(sums, "segment")


QUERIES = {
    f.__name__: f
    for f in (
        src_07_folder,
        agg_14_coverage, agg_15_gate, agg_16_gaps, agg_24_kanban, agg_25_feature_ratio, agg_19_distinct, agg_30_resolutions, snk_06_usage, src_13_fallback,
        ups_01_history, ups_10_repoint, join_12_idempotent, join_20_self_merge, set_03_dates, set_06_provenance,
    )
}
_RATIOS = ", ".join(f"round(count(*) FILTER ({c}) / count(*), 4) AS {c}_ratio" for c in _PARTS)
_COVER = f"{COVERAGE}, cover AS (SELECT sport, count(*) AS total, count(*) FILTER (kind = 'live') AS n_live, {_RATIOS}, count(*) FILTER (stale) AS n_stale FROM rows_ GROUP BY sport)"
_MISSED = ", ".join(f"CASE WHEN NOT {c}_ratio >= {v} THEN '{c}' END" for c, v in _SLO.items())
SQL = {
    "src_07_folder": """SELECT c_mktsegment AS segment, count(*) AS n_rows, count(*) FILTER (c_custkey % 10 = 0) AS rejected, 0::BIGINT AS bad_bytes,
  round(sum(c_acctbal) FILTER (c_custkey % 10 <> 0), 2) AS balance, max('Zo\u00eb, ' || c_name) FILTER (c_custkey % 10 <> 0) AS last_name FROM customer GROUP BY c_mktsegment""",
    "agg_14_coverage": f"WITH {_COVER} SELECT * FROM cover",
    "agg_15_gate": f"WITH {_COVER} SELECT sport, concat_ws(',', {_MISSED}, CASE WHEN n_stale <> 0 THEN 'stale' END) AS violations, features_ratio >= 0.7 AND canonical_ratio >= 0.98 AS can_train, canonical_ratio >= 0.98 AS can_predict FROM cover",
    "agg_16_gaps": f"""WITH {MATCHES} SELECT match_id, 'no_score' AS gap_type FROM matches WHERE state = 'finished' AND home_score IS NULL
UNION ALL SELECT match_id, 'stale' FROM matches WHERE state = 'not_started' AND scheduled_at < TIMESTAMP '1996-01-01'
UNION ALL SELECT match_id, 'no_stats' FROM matches WHERE total < 20000 UNION ALL SELECT match_id, 'no_odds' FROM matches WHERE home % 13 = 0""",
    "agg_24_kanban": f"WITH {MATCHES} SELECT state, has_bets, count(*) AS n, min(match_id) AS first_match FROM (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = match_id) AS has_bets FROM matches) GROUP BY ALL",
    "agg_25_feature_ratio": "SELECT event_id, round(k / 5, 2) AS ratio, k >= 2.5 AS enough FROM (SELECT event_id, (event_id % 2 <> 0)::INT + (event_id % 3 <> 0)::INT + (event_id % 5 <> 0)::INT + (event_id % 7 <> 0)::INT + (event_id % 11 <> 0)::INT AS k FROM events)",
    "agg_19_distinct": "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS n_nations FROM customer GROUP BY 1",
    "agg_30_resolutions": "SELECT CASE WHEN c_custkey % 40 IN (SELECT n_nationkey FROM nation) THEN 'exact' WHEN c_custkey % 2 = 0 THEN 'registered' ELSE 'unresolved' END AS resolution, count(*) AS n FROM customer GROUP BY 1",
    "snk_06_usage": "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS used, greatest(0, 5000 - count(*)) AS left FROM events GROUP BY ALL",
    "src_13_fallback": f"""WITH {MATCHES} SELECT match_id, CASE WHEN match_id % 2 = 0 THEN match_id % 7 WHEN match_id % 3 = 0 THEN match_id % 8 ELSE match_id % 9 END AS score,
  CASE WHEN match_id % 2 = 0 THEN 's0' WHEN match_id % 3 = 0 THEN 's1' ELSE 's2' END AS source FROM matches WHERE match_id % 2 = 0 OR match_id % 3 = 0 OR match_id % 5 = 0""",
    "ups_01_history": f"""WITH {MATCHES}, o AS (SELECT * FROM matches WHERE match_id % 3 <> 0), n AS (SELECT match_id, home_score + 1 AS home_score, CASE WHEN match_id % 4 = 0 THEN away_score END AS away_score FROM matches WHERE match_id % 2 = 0)
SELECT coalesce(o.match_id, n.match_id) AS match_id, coalesce(n.home_score, o.home_score)::INT AS home_score, coalesce(n.away_score, o.away_score)::INT AS away_score FROM o FULL JOIN n ON o.match_id = n.match_id""",
    "ups_10_repoint": f"""WITH {BETS}, {MATCHES}, k AS (SELECT match_id, min(match_id) OVER (PARTITION BY home, away) AS keeper FROM matches)
SELECT keeper, count(*) AS n_bets, count(DISTINCT b.match_id) AS n_matches FROM bets b JOIN k ON b.match_id = k.match_id GROUP BY keeper""",
    "join_12_idempotent": f"WITH {BETS} SELECT DISTINCT match_id, line FROM bets b WHERE book % 2 = 1 AND NOT EXISTS (SELECT 1 FROM bets c WHERE c.book % 2 = 0 AND c.match_id = b.match_id AND c.line = b.line)",
    "join_20_self_merge": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_linenumber <= 2)
SELECT h.l_orderkey, h.l_partkey AS home, a.l_partkey AS away FROM r h JOIN r a ON h.l_orderkey = a.l_orderkey AND h.l_linenumber = 1 AND a.l_linenumber = 2 AND h.rn = 1 AND a.rn = 1""",
    "set_03_dates": f"WITH {MATCHES} SELECT DISTINCT league, date_trunc('month', scheduled_at)::TIMESTAMP AS month FROM matches WHERE match_id % 7 = 0 OR match_id % 11 = 0 OR match_id % 13 = 0",
    "set_06_provenance": "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS sources FROM f GROUP BY user_id",
}
