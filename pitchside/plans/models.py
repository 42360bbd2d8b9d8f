"""Queries over probability models: closed forms on rate and rating pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import probability as P
from pitchside.plans.adapters import table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of rates for each two nations of a region."""
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), "n_regionkey")
    b = n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", (0.4 + F.col("a") * 0.11).alias("rh"), (0.3 + F.col("b") * 0.09).alias("ra"))


PAIRS = """pairs AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, 0.4::DOUBLE + a.n_nationkey * 0.11::DOUBLE AS rh, 0.3::DOUBLE + b.n_nationkey * 0.09::DOUBLE AS ra
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)"""


def _rounded(struct: str, *names: str) -> list:
    return [F.round(F.col(f"{struct}.{n}"), 6).alias(n) for n in names]


def mth_07_dixon_coles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("s", P.dixon_coles(F.col("rh"), F.col("ra"))).select("a", "b", *_rounded("s", "home", "draw", "away"))


def mth_08_over_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, a = F.col("rh"), F.col("ra")
    return _pairs(spark, sf_dir).select("a", "b", F.round(P.poisson_over(h, a, 2.5), 6).alias("over"), F.round(P.both_score(h, a), 6).alias("both_score"))


def mth_10_hockey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("s", P.hockey(F.col("rh") + 1, F.col("ra") + 1)).select("a", "b", *_rounded("s", "home", "draw", "away", "home_ot", "away_ot"))


def mth_11_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basketball and American football (MTH-11, MTH-12)."""
    a, b = F.col("a"), F.col("b")
    rows = _pairs(spark, sf_dir).withColumn("s", P.basketball(105 + a * 0.7, 110 - b * 0.3, 104 + b * 0.6, 111 - a * 0.2, 95 + (a + b) * 0.2)).withColumn("f", P.american_football(a * 0.5 - 5, b * 0.4 - 4))
    return rows.select("a", "b", *_rounded("s", "home", "over", "cover"), F.round("f.home", 6).alias("nfl_home"), F.round("f.over", 6).alias("nfl_over"))


def mth_17_ml_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round(P.total_over(F.col("rh") + F.col("ra") + 1, F.lit(2.5)), 6).alias("over"))


def mth_11_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = (F.col("a") * 2).cast("double")
    return _pairs(spark, sf_dir).select("a", "b", F.round(P.live_normal(F.lit(0.55), (F.col("b") - 10).cast("double"), left, 48.0, 12.0), 6).alias("home"))


def mth_09_football_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select("a", "b", F.round(P.football_live((a % 4).cast("int"), (b % 3).cast("int"), ((a * 7 + b * 5) % 95).cast("double"), F.col("rh"), F.col("ra")), 6).alias("home"))


def mth_16_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring rates from the first number known, zero counting as missing, and how sure they are."""
    k = F.col("p_partkey")
    n = lambda m, r: F.when(k % m != r, (k % m).cast("double") / 10)
    played = k % 30
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(P.first_known(n(3, 1), n(5, 2), n(7, 3), default=1.35), 6).alias("home_rate"), F.round(P.first_known(n(4, 1), n(2, 1), default=1.10), 6).alias("away_rate"),
        F.when(played >= 20, "high").when(played >= 5, "medium").otherwise("low").alias("confidence"),
    )


def _phi(z: str) -> str:
    z = f"(least(greatest({z}, -8.0::DOUBLE), 8.0::DOUBLE))"
    term = f"exp((2 * n + 1) * ln(abs({z})) + n * ln(2.0::DOUBLE) + lgamma(n + 1.0::DOUBLE) - lgamma(2.0::DOUBLE * n + 2))"
    return f"(0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * (SELECT coalesce(sum({term}), 0) FROM range(0, 121) t(n) WHERE {z} <> 0))"


def _pmf(k: str, r: str) -> str:
    return f"(exp(-({r})) * pow({r}, {k}) / factorial(({k})::INT)::DOUBLE)"


_CELLS = f"""{PAIRS}, cells AS (
  SELECT a, b, i, j, {_pmf("i", "rh")} * {_pmf("j", "ra")} * CASE WHEN i = 0 AND j = 0 THEN 1 + rh * ra * 0.13::DOUBLE WHEN i = 1 AND j = 0 THEN 1 - ra * 0.13::DOUBLE
    WHEN i = 0 AND j = 1 THEN 1 - rh * 0.13::DOUBLE WHEN i = 1 AND j = 1 THEN 1.13::DOUBLE ELSE 1 END AS m
  FROM pairs, range(0, 11) x(i), range(0, 11) y(j))"""
QUERIES = {
    "mth_07_dixon_coles": mth_07_dixon_coles,
    "mth_08_over_under": mth_08_over_under,
    "mth_10_hockey": mth_10_hockey,
    "mth_11_normal": mth_11_normal,
    "mth_11_live": mth_11_live,
    "mth_17_ml_total": mth_17_ml_total,
    "mth_09_football_live": mth_09_football_live,
    "mth_16_parameters": mth_16_parameters,
}
SQL = {
    "mth_07_dixon_coles": f"WITH {_CELLS} SELECT a, b, round(sum(m) FILTER (i > j) / sum(m), 6) AS home, round(sum(m) FILTER (i = j) / sum(m), 6) AS draw, round(sum(m) FILTER (i < j) / sum(m), 6) AS away FROM cells GROUP BY a, b",
    "mth_08_over_under": f"WITH {PAIRS} SELECT a, b, round(1 - ({' + '.join(_pmf(str(k), 'rh + ra') for k in range(3))}), 6) AS over, round((1 - exp(-rh)) * (1 - exp(-ra)), 6) AS both_score FROM pairs",
    "mth_10_hockey": f"""WITH {PAIRS}, c AS (SELECT a, b, i, j, {_pmf("i", "rh + 1")} * {_pmf("j", "ra + 1")} AS m FROM pairs, range(0, 13) x(i), range(0, 13) y(j)),
g AS (SELECT a, b, sum(m) FILTER (i > j) AS h, sum(m) FILTER (i = j) AS d, sum(m) FILTER (i < j) AS w FROM c GROUP BY a, b)
SELECT a, b, round(h, 6) AS home, round(d, 6) AS draw, round(w, 6) AS away, round(h + d * 0.52, 6) AS home_ot, round(w + d * 0.48, 6) AS away_ot FROM g""",
    "mth_11_normal": f"""WITH {PAIRS}, t AS (SELECT a, b, (105 + a * 0.7::DOUBLE + 111 - a * 0.2::DOUBLE) / 2 * (95 + (a + b) * 0.2::DOUBLE) / 100 AS hp,
  (104 + b * 0.6::DOUBLE + 110 - b * 0.3::DOUBLE) / 2 * (95 + (a + b) * 0.2::DOUBLE) / 100 AS ap, a * 0.5::DOUBLE - 5 AS x, b * 0.4::DOUBLE - 4 AS y FROM pairs)
SELECT a, b, round({_phi("((hp - ap + 3) / 12)")}, 6) AS home, round(1 - {_phi("((224.5 - (hp + ap)) / 12)")}, 6) AS over, round({_phi("((hp - ap + 3 - 3.5) / 12)")}, 6) AS cover,
  round({_phi("((x - y + 2.5) / 13.5)")}, 6) AS nfl_home, round(1 - {_phi("((44.5 - (44 + 0.3 * (x + y))) / 13)")}, 6) AS nfl_over FROM t""",
    "mth_11_live": f"""WITH {PAIRS}, t AS (SELECT a, b, a * 2.0::DOUBLE AS left_, b - 10.0::DOUBLE AS diff FROM pairs)
SELECT a, b, round(CASE WHEN left_ <= 0 THEN CASE WHEN diff > 0 THEN 1.0::DOUBLE WHEN diff < 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END
  ELSE {_phi("((diff + 0.05::DOUBLE * 24 * left_ / 48) / (12 * sqrt(greatest(left_, 0.001) / 48)))")} END, 6) AS home FROM t""",
    "mth_17_ml_total": f"WITH {PAIRS} SELECT a, b, round(1 - {_phi('((2.5 - (rh + ra + 1)) / greatest(0.15::DOUBLE * (rh + ra + 1), 1.0))')}, 6) AS over FROM pairs",
    "mth_09_football_live": f"""WITH {PAIRS}, t AS (SELECT a, b, a % 4 AS h, b % 3 AS w, greatest(0.0::DOUBLE, 90 - (a * 7 + b * 5) % 95) / 90 AS left_, rh, ra FROM pairs),
r AS (SELECT *, greatest(rh * left_, 0.01) AS lh, greatest(ra * left_, 0.01) AS la FROM t),
c AS (SELECT a, b, h, w, left_, sum({_pmf("i", "lh")} * {_pmf("j", "la")}) FILTER (h + i > w + j) AS win FROM r, range(0, 11) x(i), range(0, 11) y(j) GROUP BY ALL)
SELECT a, b, round(least(greatest(CASE WHEN left_ <= 0 THEN (h > w)::INT::DOUBLE ELSE win END, 1e-6), 1 - 1e-6), 6) AS home FROM c""",
    "mth_16_parameters": """WITH n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 1 THEN (p_partkey % 3)::DOUBLE / 10 END AS a, CASE WHEN p_partkey % 5 <> 2 THEN (p_partkey % 5)::DOUBLE / 10 END AS b,
  CASE WHEN p_partkey % 7 <> 3 THEN (p_partkey % 7)::DOUBLE / 10 END AS c, CASE WHEN p_partkey % 4 <> 1 THEN (p_partkey % 4)::DOUBLE / 10 END AS d, CASE WHEN p_partkey % 2 <> 1 THEN (p_partkey % 2)::DOUBLE / 10 END AS e FROM part)
SELECT k AS p_partkey, round(coalesce(nullif(a, 0), nullif(b, 0), nullif(c, 0), 1.35), 6) AS home_rate, round(coalesce(nullif(d, 0), nullif(e, 0), 1.10), 6) AS away_rate,
  CASE WHEN k % 30 >= 20 THEN 'high' WHEN k % 30 >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM n""",
}
