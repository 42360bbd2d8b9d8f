"""Queries that SQL cannot express: recursions, similarity of names, learners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import kernels as K
from pitchside.functions import matching as M
from pitchside.functions import registry as G
from pitchside.functions.rowmodels import present
from pitchside.operators import boosting as B
from pitchside.operators import training as T
from pitchside.operators import walkforward as W
from pitchside.plans.adapters import MATCHES, matches, table
from pitchside.plans.live import _played
from pitchside.sources.scratch import scratch
from pitchside.sources.stores import latest_model

#: Folds, and rounds of trees of the queries (the operators take any number; 200 for a model in use).
FOLDS, ROUNDS = 5, 5


def mth_13_tennis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (0.55 + (F.col("s_suppkey") % 20) / 100).alias("a"), (0.55 + (F.col("s_suppkey") % 17) / 100).alias("b"))
    return s.withColumn("r", K.tennis(F.col("a"), F.col("b"))).select("s_suppkey", F.round("r.set_win", 6).alias("set_win"), F.round("r.match_win", 6).alias("match_win"), F.round("r.games", 4).alias("games"))


def mth_13_total_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of more games than a line, of three and of five sets (MTH-13)."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (0.55 + (k % 20) / 100).alias("a"), (0.55 + (k % 17) / 100).alias("b"), (20.5 + k % 9).alias("line"))
    return s.select("s_suppkey", "line", *[F.round(K.tennis_over(F.col("a"), F.col("b"), F.col("line") + more, n), 6).alias(f"over_{n}") for n, more in ((3, 0), (5, 14))])


def mth_14_darts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (0.4 + (F.col("s_suppkey") % 30) / 100).alias("h"), (0.4 + (F.col("s_suppkey") % 23) / 100).alias("a"))
    return s.select("s_suppkey", F.round(K.darts(F.col("h"), F.col("a")), 6).alias("win"))


def join_18_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name, misspelt, and the known name it is closest to."""
    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("canonical")).distinct()
    wrong = p.select(F.concat(F.substring("canonical", 1, 3), F.lit("z"), F.substring("canonical", 4, 100)).alias("name"))
    return M.closest_names(wrong, p).select("name", "canonical", F.round("ratio", 4).alias("ratio"))


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Matches with players' names written in four ways, some bound to an event, and the day's events."""
    first = F.element_at(F.array(*map(F.lit, ("anna", "boris", "carla", "dmitri", "elena"))), (F.col("home") % 5 + 1).cast("int"))
    last = F.concat(F.lit("player"), (F.col("home") % 97).cast("string"))
    rival = F.concat(F.lit("fritz rival"), F.col("away").cast("string"))
    m = matches(spark, sf_dir).withColumn("day", F.to_date("scheduled_at"))
    full = F.concat_ws(" ", first, last)
    style = F.col("match_id") % 4
    short = F.when(style == 0, full).when(style == 1, F.concat(last, F.lit(" "), F.substring(first, 1, 1), F.lit("."))).when(style == 2, F.concat(last, F.lit(", "), first)).otherwise(F.concat(F.lit("x "), last))
    events = m.select(F.col("match_id").alias("event_id"), "day", full.alias("home"), rival.alias("away"))
    bound = F.when(F.col("match_id") % 9 == 0, F.col("match_id"))
    return m.select("match_id", "day", bound.alias("bound"), short.alias("home"), rival.alias("away")), events


def join_15_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and the event that is bound or, on their day, has the same teams (JOIN-15, JOIN-19)."""
    return M.event_matches(*_written(spark, sf_dir))


def join_16_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and the first event of their day that fits any pass (JOIN-16)."""
    return M.event_matches(*_written(spark, sf_dir), fixture_order=True)


def join_17_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of players and events by equal names, abbreviations and last names only (JOIN-17)."""
    return M.event_matches(*_written(spark, sf_dir), passes=(0, 1, 3))


def prj_35_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tables and rows of each page, with a table of the page's own numbers before it."""
    own = F.concat(F.lit("<table></table><table><tr><th>id</th></tr><tr></tr><tr><td>"), F.col("page_id"), F.lit("</td></tr></table>"))
    t = M.html_tables(F.concat(own, F.coalesce("html", F.lit(""))))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.size("t").alias("n_tables"), F.coalesce(F.aggregate("t", F.lit(0), lambda a, x: a + F.size(x)), F.lit(0)).alias("n_rows"))


def _folds(spark: SparkSession, sf_dir: str) -> tuple[list[B.Trees], DataFrame]:
    return W.fold_models(_played(spark, sf_dir), FOLDS, trees=ROUNDS)


def ml_05_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of five folds of the outcome and goals trees over the training set, if it passes the gate (ML-01, ML-03, ML-04, ML-05, WIN-13)."""
    return B.fold_scores(_folds(spark, sf_dir)[1], FOLDS)


def agg_26_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the metrics over the folds (AGG-26)."""
    return B.fold_summary(ml_05_walk_forward(spark, sf_dir))


def ml_06_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome probabilities and goals of every match, by a model of the matches before 1996 that was stored and found again (ML-02 to ML-06, SNK-02, SNK-03)."""
    folder = scratch(spark)
    W.train(_played(spark, sf_dir).where("scheduled_at < timestamp_ntz'1996-01-01'"), folder, "football", folds=2, gated=False, trees=ROUNDS)
    model, _ = latest_model(spark, folder, "football", "outcome")
    every = T.vectors(matches(spark, sf_dir))
    return model.transform(every.select("match_id", *T.COLUMNS)).select("match_id", *[F.round(F.col("p")[i], 4).alias(f"p{i}") for i in range(3)], F.round("total", 4).alias("goals"))


def mth_13_tennis_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tennis and darts matches under way: live probability from sets or legs won (MTH-13, MTH-14, MTH-15)."""
    k = F.col("s_suppkey")
    n = lambda m, r: F.when(k % m != r, (k % m).cast("double"))
    tennis = present({"p_serve_home": 0.55 + (k % 20) / 100, "p_serve_away": 0.55 + (k % 17) / 100, "best_of": F.when(k % 2 == 0, 5).otherwise(3), "a_serving": n(2, 5),
        "games_home": n(6, 1), "games_away": n(5, 2), "points_home": n(4, 3), "points_away": n(3, 2)})
    darts = present({"p_leg_home": 0.4 + (k % 30) / 100, "p_leg_away": 0.4 + (k % 23) / 100, "sets": k % 2, "home_throwing": n(2, 5)})
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.struct(F.lit("tennis").alias("sport"), tennis.alias("stats")), F.struct(F.lit("darts").alias("sport"), darts.alias("stats")))).alias("m")).select("s_suppkey", "m.*")
    live = G.updated(F.col("sport"), F.lit(0.5), k % 3, k % 2, F.lit(0.0), F.col("stats"))
    return s.select("s_suppkey", "sport", F.round(live, 6).alias("home"))


QUERIES = {f.__name__: f for f in (mth_13_tennis, mth_13_tennis_live, mth_13_total_games, mth_14_darts, join_18_fuzzy, join_15_events, join_16_first_fit, join_17_players, prj_35_html, ml_05_walk_forward, agg_26_fold_summary, ml_06_inference)}


def _abbreviates(short: str, full: str) -> str:
    parts, first, last = f"string_split({full}, ' ')", f"split_part({full}, ' ', 1)", f"string_split({full}, ' ')[-1]"
    x = lambda p, i: f"regexp_extract({short}, '{p}', {i})"
    comma, after, before = r"^([^,]+),\s*(.+)$", r"^(.+?)\s+([a-z])\.(?:[a-z]\.)*$", r"^([a-z])\.\s*(.+)$"
    given = f"regexp_replace({x(comma, 2)}, '\\.+$', '')"
    return f"""CASE WHEN len({parts}) < 2 THEN false
    WHEN {x(comma, 1)} <> '' THEN trim({x(comma, 1)}) = {last} AND ({given} = {first} OR length({given}) = 1 AND {given} = left({first}, 1))
    WHEN {x(after, 1)} <> '' THEN {x(after, 1)} = {last} AND {x(after, 2)} = left({first}, 1)
    WHEN {x(before, 2)} <> '' THEN {x(before, 2)} = {last} AND {x(before, 1)} = left({first}, 1) ELSE false END"""


def _event_sql(order: str, tiers: str = "-1, 0, 1, 2, 3") -> str:
    words = lambda c: f"list_filter(string_split({c}, ' '), lambda t: length(t) >= 3)"
    split = lambda c: f"list_filter(regexp_split_to_array({c}, '[\\s,.]+'), lambda t: t <> '')"
    side = lambda a, b: f"greatest(len(list_intersect({words(a)}, {words(b)})), CASE WHEN (contains({a}, {b}) OR contains({b}, {a})) AND list_has_any({split(a)}, {split(b)}) THEN 1 ELSE 0 END)"
    same = lambda a, b: f"({a} = {b} OR ({_abbreviates(a, b)}) OR ({_abbreviates(b, a)}))"
    last = lambda c: f"CASE WHEN contains({c}, ',') THEN trim(split_part({c}, ',', 1)) ELSE list_reduce(string_split({c}, ' '), lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) END"
    return f"""WITH {MATCHES},
named AS (SELECT match_id, scheduled_at::DATE AS day, ['anna', 'boris', 'carla', 'dmitri', 'elena'][home % 5 + 1] AS f, 'player' || (home % 97) AS l, 'fritz rival' || away AS rival FROM matches),
m AS (SELECT match_id, day, CASE WHEN match_id % 9 = 0 THEN match_id END AS bound, rival AS away,
  CASE match_id % 4 WHEN 0 THEN f || ' ' || l WHEN 1 THEN l || ' ' || left(f, 1) || '.' WHEN 2 THEN l || ', ' || f ELSE 'x ' || l END AS home FROM named),
e AS (SELECT match_id AS event_id, day, f || ' ' || l AS home, rival AS away FROM named),
sides AS (SELECT m.match_id, e.event_id, m.home AS mh, e.home AS eh, m.away AS ma, e.away AS ea, {side("m.home", "e.home")} AS sh, {side("m.away", "e.away")} AS sa FROM m JOIN e ON m.day = e.day),
tiers AS (SELECT *, unnest([CASE WHEN mh = eh AND ma = ea THEN 0 END, CASE WHEN {same("mh", "eh")} AND {same("ma", "ea")} THEN 1 END,
    CASE WHEN sh > 0 AND sa > 0 THEN 2 END, CASE WHEN {last("mh")} = {last("eh")} AND {last("ma")} = {last("ea")} THEN 3 END]) AS tier FROM sides),
every AS (SELECT match_id, event_id, tier, CASE WHEN tier = 2 THEN sh + sa ELSE 0 END AS score FROM tiers WHERE tier IS NOT NULL
  UNION ALL SELECT match_id, bound, -1, 0 FROM m WHERE bound IN (SELECT event_id FROM e))
SELECT match_id, event_id, tier::INT AS tier FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY {order}) AS rn FROM every WHERE tier IN ({tiers})) WHERE rn = 1"""


SQL: dict[str, str] = {
    "join_15_events": _event_sql("tier, score DESC, event_id"),
    "join_16_first_fit": _event_sql("tier >= 0, event_id, tier"),
    "join_17_players": _event_sql("tier, score DESC, event_id", "0, 1, 3"),
}
