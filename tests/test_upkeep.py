"""Cleaning of odd cells, upkeep run twice, stores, registries, learners, live kernels by plain recursion."""

import datetime as dt
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from pitchside.functions import cleaning as C
from pitchside.functions import matching as M
from pitchside.functions import registry as G
from pitchside.functions import rowmodels as R
from pitchside.functions.rowmodels import present
from pitchside.operators import histories as H
from pitchside.operators import training as T
from pitchside.operators import upkeep as U
from pitchside.sources import readers, stores

DAY = dt.datetime(2024, 5, 1, 18, 0)


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["x"] for r in rows.orderBy("i").select(column(F.col("c")).alias("x")).collect()]


def test_odd_cells(spark):
    assert one(spark, C.safe_int, "1e19", "12d", "0x1p3", "1_000", " 7.9 ", "", None, "-3.2") == [0, 0, 0, 1000, 7, 0, 0, -3]
    assert one(spark, C.safe_float, "1.5f", "Infinity", "NaN", ".5", "5.", "1e400", "1__0") == [None, None, None, 0.5, 5.0, None, None]
    assert one(spark, C.canonical_selection, "Home -1.50", "Over 3.00", "away 0.0", "Over 10.25", "X", "100") == ["home_-1.5", "over_3", "away_0", "over_10.25", "draw", "100"]
    day = lambda c: C.season_in_name(c, F.lit("2021-03-04").cast("date"))
    assert one(spark, day, "E0_20212022.csv", "E0_2122.csv", "E0_2023-24.csv", "x12345.csv", "E0_2199.csv") == ["2020-21", "2021-22", "2023-24", "2020-21", "2020-21"]


def test_repeated_names_have_a_row_each(spark):
    names = spark.createDataFrame([("manchester unitd",)] * 2 + [(None,), ("",)], "name string")
    known = spark.createDataFrame([("manchester united",), ("manchester city",), (None,)], "canonical string")
    assert [r["canonical"] for r in M.closest_names(names, known).collect()] == ["manchester united"] * 2


def test_event_passes(spark):
    m = spark.createDataFrame([(1, 1, "ann bell", "carl dee", 99), (2, 1, "z bell", "q dee", None), (3, 1, "red", "blue", None)], "match_id int, day int, home string, away string, bound int")
    e = spark.createDataFrame([(10, 1, "ann bell", "carl dee"), (9, 1, "y bell", "w dee"), (99, 5, "far", "away")], "event_id int, day int, home string, away string")
    got = lambda **k: {r["match_id"]: (r["event_id"], r["tier"]) for r in M.event_matches(m, e, **k).collect()}
    assert got() == {1: (99, -1), 2: (9, 2)}
    assert got(passes=(0, 1, 3)) == {1: (10, 0), 2: (9, 3)}
    assert got(fixture_order=True, passes=(0, 1, 2, 3)) == {1: (9, 2), 2: (9, 2)}


def test_long_chain_of_clusters(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("k"), "id", F.timestamp_seconds(F.col("id") * 60).alias("t"))
    got = H.anchored_clusters(rows, ["k"], "t", "id", 15)
    assert got.select("cluster").distinct().count() == 6250 and got.where("id - cluster > 15").count() == 0


def test_seeding_twice_adds_nothing(spark):
    f = spark.createDataFrame([(1, "a", "b", DAY), (2, "a", "b", DAY + dt.timedelta(hours=2)), (3, "c", "d", DAY)], "fixture_id int, home_team string, away_team string, scheduled_at timestamp_ntz")
    none = f.where("false")
    window = [F.lit(DAY + dt.timedelta(days=n)).cast("timestamp_ntz") for n in (-1, 1)]
    new = U.seeded(none, f, *window)
    assert sorted(r["fixture_id"] for r in new.collect()) == [1, 3]
    assert U.seeded(new, f.where("fixture_id <> 2"), *window).count() == 0
    late = f.where("fixture_id = 3").withColumn("scheduled_at", F.col("scheduled_at") + F.expr("interval 16 minutes"))
    assert U.seeded(new, late, *window).count() == 1


def test_scores_twice_change_nothing(spark):
    stats = present({"shots": F.lit(3), "old": F.lit(1)}).alias("stats")
    m = spark.createDataFrame([(1, None, None, "open", None), (2, 1, 0, "finished", "me"), (3, None, None, "open", None)], "match_id int, home_score int, away_score int, state string, source string").select("*", stats)
    a = spark.createDataFrame([(1, 2, 2, True), (2, 9, 9, True)], "match_id int, home_score int, away_score int, finished boolean").select("*", F.lit("x").alias("source"), present({"shots": F.lit(8)}).alias("stats"))
    got = U.with_scores(m, a)
    rows = {r["match_id"]: r for r in got.collect()}
    assert (rows[1]["home_score"], rows[1]["state"], rows[1]["source"], rows[1]["stats"]) == (2, "finished", "x", {"old": 1.0, "shots": 8.0})
    assert (rows[2]["home_score"], rows[2]["source"]) == (1, "me") and rows[3]["home_score"] is None
    assert sorted(map(str, U.with_scores(got, a).select(*got.columns).collect())) == sorted(map(str, got.collect()))


def test_aliases_are_learnt_in_order(spark):
    rows = [(1, "t", "Jannik Sinner"), (2, "t", "Sinner J."), (3, "t", "Jannik Siner"), (4, "t", "J. Sinner"), (5, "t", "JANNIK  SINNER"), (6, "f", "Sinner J."), (7, "t", " "), (8, "t", None)]
    got = U.learned_aliases(spark.createDataFrame(rows, "n int, sport string, name string"), "sport", "name", ["n"]).collect()
    assert {(r["sport"], r["key"]): (r["canonical"], r["how"]) for r in got} == {
        ("t", "jannik sinner"): ("Jannik Sinner", "new"), ("t", "sinner j."): ("Jannik Sinner", "abbreviation"), ("t", "j. sinner"): ("Jannik Sinner", "abbreviation"),
        ("t", "jannik siner"): ("Jannik Sinner", "fuzzy"), ("f", "sinner j."): ("Sinner J.", "new"),
    }


def test_digest(spark):
    m = lambda n: spark.createDataFrame([(i, f"m{i}") for i in range(n)], "at int, text string")
    assert sorted(r["message"] for r in U.digest(m(2), "at", "text").collect()) == ["m0", "m1"]
    assert [r["message"] for r in U.digest(m(4), "at", "text", most=3).collect()] == ["3 alerts\nm0\nm1\nm2"]
    assert U.digest(m(0), "at", "text").count() == 0


def test_stores(spark, tmp_path):
    path = tmp_path.as_uri() + "/t"
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert not stores.exists(spark, path)
    for _ in range(2):
        stores.save_table(rows, path, ["k"])
    assert sorted(r["k"] for r in stores.load_table(spark, path).collect()) == [1, 2]
    (tmp_path / "s.yaml").write_text("# limits\nrisk:\n  stake: 2.5\n  on: true\nname: 'x'\n")
    assert stores.settings(spark, (tmp_path / "s.yaml").as_uri(), {"name": "y", "other": 1}) == {"name": "x", "other": 1, "risk.stake": 2.5, "risk.on": True}
    stores.report(rows, tmp_path.as_uri() + "/r", "text")
    assert sorted(r["value"] for r in spark.read.text(tmp_path.as_uri() + "/r").collect())[0] == "k: 1, v: a"
    (tmp_path / "f.xml").write_text('<feed><entry><title>Knee injury</title><summary>&lt;b&gt;Out&lt;/b&gt; for weeks</summary><link href="u"/></entry><entry><title>Nothing</title></entry></feed>')
    got = stores.feed(spark, (tmp_path / "f.xml").as_uri(), ["injury", "of"]).collect()
    assert [(r["title"], r["snippet"]) for r in got] == [("Knee injury", "Out for weeks")]


def test_ingester_keeps_bad_rows_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("home,away,date,score_home,score_away,q1_home\n a ,b,2024-01-02,101,99,20\n,b,2024-01-02,1,2,3\n")
    good, bad = G.Ingester(readers.csv_rows, ("home", "away", "date"), R.nba).run(spark, str(tmp_path))
    row = good.collect()[0]
    assert (row["home_team"], row["season"], row["result"], row["match_stats"]) == ("a", "2023-24", "H", {"q1_home": 20.0})
    assert [r["missing"] for r in bad.collect()] == [["home"]]


def test_registry_names_what_there_is():
    with pytest.raises(KeyError, match="football"):
        G.MODELS.get("chess")


@lru_cache(None)
def walk(first, second, target, a, b):
    if max(a, b) >= target:
        return float(a >= target)
    return first * walk(second, first, target, a + 1, b) + (1 - first) * walk(second, first, target, a, b + 1)


def test_live_darts_and_tennis(spark):
    states = [(1, 0, 0, 6), (2, 3, 1, 4), (6, 2, 1, 6), (0, 4, 0, 5)]
    rows = spark.createDataFrame(states, "a int, b int, throws int, to int").withColumn("stats", present({"p_leg_home": F.lit(0.6), "p_leg_away": F.lit(0.55), "legs_to_win": F.col("to"), "home_throwing": F.col("throws")}))
    got = rows.select("a", "b", "throws", "to", G.updated(F.lit("darts"), F.lit(0.5), F.col("a"), F.col("b"), F.lit(0.0), F.col("stats")).alias("p")).collect()
    for r in got:
        first, second = (0.6, 0.45) if r["throws"] else (0.45, 0.6)
        assert r["p"] == pytest.approx(walk(first, second, r["to"], r["a"], r["b"]))
    even = spark.range(1).select(*[G.updated(F.lit("tennis"), F.lit(0.5), F.lit(a), F.lit(b), F.lit(0.0), present({"p_serve_home": F.lit(0.6), "p_serve_away": F.lit(0.6)})).alias(f"p{a}{b}") for a, b in ((0, 0), (1, 0), (1, 1), (2, 1), (0, 2))]).first()
    s = even["p11"]
    assert even["p10"] == pytest.approx(s + (1 - s) * s) and even["p00"] == pytest.approx(s * s * (3 - 2 * s)) and (even["p21"], even["p02"]) == (1.0, 0.0)


def test_gate(spark):
    rows = spark.range(30).select(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("c"))
    assert T.gate(rows, ["a", "b"]) == "ok"
    assert T.gate(rows, ["a", "b", "c"]) == "low coverage"
    assert T.gate(rows.limit(19), ["a"]) == "too few rows"
    assert T.gate(rows.limit(0), ["a"]) == "too few rows"


def test_dwelling(spark, tmp_path):
    rows = [(1, DAY + dt.timedelta(seconds=s), x) for s, x in ((0, "play"), (10, "break"), (100, "break"), (135, "break"), (200, "play"), (400, "play"))]
    schema = "k long, at timestamp, state string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(tmp_path.as_uri() + "/in")
    stream = U.dwelling(spark.readStream.schema(schema).parquet(tmp_path.as_uri() + "/in"), "k", "at", "state", ("break",))
    for _ in range(2):  # the second run finds nothing new
        U.stored_batches(stream, tmp_path.as_uri() + "/out", tmp_path.as_uri() + "/check")
    assert [(r["key"], r["seconds"]) for r in spark.read.parquet(tmp_path.as_uri() + "/out").collect()] == [(1, 125.0)]
