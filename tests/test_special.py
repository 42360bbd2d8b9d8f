import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchside.functions import kernels as K
from pitchside.functions import matching as M


@lru_cache(None)
def point_game(p, a=0, b=0):
    if a >= 3 and b >= 3:
        return p * p / (p * p + (1 - p) ** 2)
    if a == 4 or b == 4:
        return float(a == 4)
    return p * point_game(p, a + 1, b) + (1 - p) * point_game(p, a, b + 1)


@lru_cache(None)
def walk_set(pa, pb, a=0, b=0):
    """Set win and games by a plain walk over scores."""
    if max(a, b) >= 6 and abs(a - b) >= 2:
        return float(a > b), 0.0
    if a == b == 6:
        return float(K.tiebreak(np.array([pa]), np.array([pb]))[0]), 1.0
    p = point_game(pa) if (a + b) % 2 == 0 else 1 - point_game(pb)
    (w1, g1), (w2, g2) = walk_set(pa, pb, a + 1, b), walk_set(pa, pb, a, b + 1)
    return p * w1 + (1 - p) * w2, 1 + p * g1 + (1 - p) * g2


@pytest.mark.parametrize(("pa", "pb"), [(0.6, 0.6), (0.7, 0.55), (0.5, 0.5)])
def test_tennis(pa, pb):
    assert K.game(np.array([pa]))[0] == pytest.approx(point_game(pa))
    s, n = K.sets(np.array([pa]), np.array([pb]))
    assert (s[0], n[0]) == pytest.approx(walk_set(pa, pb))
    assert K.match(np.array([0.5]), 5)[0] == pytest.approx(0.5)


def test_tiebreak_is_even_for_equal_players_who_win_half():
    assert K.tiebreak(np.array([0.5]), np.array([0.5]))[0] == pytest.approx(0.5)


def test_darts():
    assert K.legs(np.array([0.5]), np.array([0.5]), 6)[0] == pytest.approx(0.5)
    assert K.legs(np.array([0.6]), np.array([0.4]), 1)[0] == pytest.approx(0.6)
    assert K.legs(np.array([0.6]), np.array([0.6]), 2)[0] == pytest.approx(0.6 * 0.4 + 0.6 * 0.6 * 0.6 + 0.4 * 0.4 * 0.6)


def test_names(spark):
    df = spark.createDataFrame([("  Müller   José ",), (None,)], "n string")
    assert [r["k"] for r in df.select(M.name_key(F.col("n")).alias("k")).collect()] == ["muller jose", None]
    cases = [("sinner j.", True), ("j. sinner", True), ("sinner, jannik", True), ("sinner, j.", True), ("sinner k.", False), ("jannik", False), ("sinner, k.", False)]
    got = spark.createDataFrame([(a, "jannik sinner") for a, _ in cases], "a string, b string").select(M.abbreviates(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r["x"] for r in got] == [w for _, w in cases]


def test_closest_names(spark):
    names = spark.createDataFrame([("manchester unitd",), ("nobody at all",)], "name string")
    known = spark.createDataFrame([("manchester united",), ("manchester city",)], "canonical string")
    assert [(r["name"], r["canonical"]) for r in M.closest_names(names, known).collect()] == [("manchester unitd", "manchester united")]


def test_event_matches(spark):
    m = spark.createDataFrame([(1, 1, "jannik sinner", "x one"), (2, 1, "red club fc", "blue town"), (3, 1, "a", "b")], "match_id int, day int, home string, away string")
    e = spark.createDataFrame([(10, 1, "sinner j.", "x one"), (11, 1, "red club", "blue town united"), (12, 1, "red club united", "blue side"), (13, 2, "a", "b")], "event_id int, day int, home string, away string")
    assert {r["match_id"]: (r["event_id"], r["tier"]) for r in M.event_matches(m, e).collect()} == {1: (10, 1), 2: (11, 2)}


def _words_tier(m, e, first):
    """The third pass, pair by pair."""
    long, every = (lambda c: {t for t in c.split(" ") if len(t) >= 3}), (lambda c: {t for t in re.split(r"[\s,.]+", c) if t})
    side = lambda a, b: max(len(long(a) & long(b)), int((a in b or b in a) and bool(every(a) & every(b))))
    out = {}
    for i, day, h, a in m:
        fits = [(0 if first else -side(h, x) - side(a, y), j) for j, on, x, y in e if on == day and side(h, x) and side(a, y)]
        if fits:
            out[i] = (min(fits)[1], 2)
    return out


def test_events_by_sets_of_words(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["fc", "ab", "red", "club", "town", "united", "sv", "blue", "red,", "ab.c", "player", "fc."]
    name = lambda: " ".join(rng.choice(vocabulary, rng.integers(1, 7)))
    rows = lambda n: [(i, int(rng.integers(1, 3)), name(), name()) for i in range(n)]
    m, e = rows(150), rows(25) + [(100, 1, "ab", "fc"), (101, 2, "ab.c red,", "fc")]
    m += [(900, 1, "ab", "fc."), (901, 2, "ab.c red, ab", "x fc"), (902, 1, "zz ab", "red fc")]
    ms, es = spark.createDataFrame(m, "match_id int, day int, home string, away string"), spark.createDataFrame(e, "event_id int, day int, home string, away string")
    for first in (False, True):
        got = {r["match_id"]: (r["event_id"], r["tier"]) for r in M.event_matches(ms, es, fixture_order=first, passes=(2,)).collect()}
        assert got == _words_tier(m, e, first)


def test_events_are_not_broadcast(spark, monkeypatch):
    from pitchside.plans import special

    plans = []
    cut = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(M, "cut", cut)
    for first in (False, True):
        plans.append(M.event_matches(*special._written(spark, "/root/testdata/sf0.001"), fixture_order=first)._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]


def test_html_tables(spark):
    page = "<p>x</p><table></table><table><tr></tr></table><TABLE border=1><tr><th>Club<th>Points</th></tr><tr></tr><tr><td> Red <i>Star</i></td><td>41</td></tr></TABLE>"
    got = spark.createDataFrame([(page,), (None,)], "h string").select(M.html_tables(F.col("h")).alias("t")).collect()
    assert got[0]["t"][0][1] == ["Red Star", "41"] and len(got[0]["t"]) == 1
    assert got[1]["t"] == []


def test_inference_covers_matches_without_a_score(spark, tmp_path):
    from datetime import datetime

    from pitchside.plans.special import ml_06_inference

    rows = [(i, i * 7 % 13, datetime(1995 + i % 2, 1 + i % 12, 1), "O", 1000.0 * (i % 9), "1") for i in range(1, 121)]
    schema = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string, o_totalprice double, o_orderpriority string"
    spark.createDataFrame(rows, schema).write.parquet(tmp_path.as_uri() + "/orders.parquet")
    got = ml_06_inference(spark, tmp_path.as_uri()).collect()
    assert sorted(r["match_id"] for r in got) == [r[0] for r in rows]
    assert all(None not in r for r in got)


def test_states_with_nulls_are_skipped():
    state = pd.DataFrame({"a": [1.0, None, 1.0], "b": [0.0, None, 2.0]})
    assert K._by_state(lambda a, b, x: x + a + b, state, np.array([0.5, 0.5, 0.5])).fillna(-1.0).tolist() == [1.5, -1.0, 3.5]


def test_live_values_are_computed_once(spark):
    from pitchside.plans.live import mth_02_live_value

    plan = mth_02_live_value(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_json_responses_are_read_once(spark):
    from pitchside.sources import stats as S

    df = spark.createDataFrame([("[]",)], "r string")
    for f in (S.football_json, S.points_json, S.hockey_json):
        plan = df.select(f(F.col("r")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1
