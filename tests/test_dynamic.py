import pytest
from pyspark.sql import functions as F

from pitchside.functions import cleaning as C
from pitchside.functions import dynamic as D


def features(spark, home, away, **more):
    rows = spark.createDataFrame([(home, away)], "h map<string,string>, a map<string,string>")
    return rows.select(D.dynamic_features(F.col("h"), F.col("a"), **more)).first()[0]


def test_any_numeric_key_becomes_a_feature(spark):
    got = features(spark, {"roll_3_new": "1.5", "venue": "home", "win_pct": "0.4", "elo_rating": "1500", "n": "3"}, {"roll_3_new": "1", "only": "2", "n": None})
    assert got == {
        "h_roll_3_new": 1.5, "a_roll_3_new": 1.0, "diff_roll_3_new": 0.5, "h_win_pct": 0.4, "a_win_pct": 0.0, "diff_win_pct": 0.4, "h_n": 3.0, "a_n": 0.0, "h_only": 0.0, "a_only": 2.0,
    }
    assert features(spark, None, {}) == {} and features(spark, None, {"x": "1"}) == {"h_x": 0.0, "a_x": 1.0}


def test_tennis_extras(spark):
    got = features(spark, {"age": "30", "hand": "L", "height_cm": "190", "elo_rating": "2000"}, {"age_years": "24.5", "hand": "R", "elo_rating": "1900"}, tennis=True)
    assert got["age_diff"] == 5.5 and got["hand_matchup"] == -1.0 and got["elo_diff"] == 100.0 and "height_diff" not in got


def test_maps_become_columns(spark):
    rows = spark.createDataFrame([(1, {"b": 2.0}), (2, {"a": 1.0}), (3, None)], "id int, f map<string,double>")
    names = D.feature_names(rows, "f")
    assert names == ["a", "b"]
    assert [tuple(r) for r in D.wide(rows, "f", names).orderBy("id").collect()] == [(1, 0.0, 2.0), (2, 1.0, 0.0), (3, 0.0, 0.0)]


@pytest.mark.parametrize(
    ("name", "day", "want"),
    [("nfl_2024.csv", "2023-10-01", "2024-25"), ("nfl_2023-24.xlsx", "2020-01-01", "2023-24"), ("nfl_1999_2009.csv", "2020-01-01", "2009-10"), ("games.csv", "2024-02-11", "2023-24"), ("games.csv", "2024-09-05", "2024-25")],
)
def test_season_of_a_file_wins_over_the_date(spark, name, day, want):
    assert spark.range(1).select(C.season_in_year(F.lit(name), F.lit(day).cast("date"))).first()[0] == want
