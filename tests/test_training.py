import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchside.operators import boosting as B
from pitchside.operators import learning as L
from pitchside.operators import walkforward as W
from pitchside.sources import stores

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(600):
        a, b, c = rng.random(), rng.randrange(5), rng.gauss(0, 1) if i % 9 else None
        y = 0 if a > 0.6 else 1 if b >= 3 else 2
        y = y if rng.random() < 0.9 else rng.randrange(3)
        out.append((i, a, float(b), c, float(y), 2.0 * a + b + rng.gauss(0, 0.1), None if i < 100 else (i - 100) // 100 + 1))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "match_id long, a double, b double, c double, label double, goals double, fold int").repartition(5)


@pytest.fixture(scope="module")
def fitted(frame):
    return B.boosted_folds(frame, COLUMNS, F.col("fold"), 5, trees=7, depth=3, rate=0.3)


def numbers(rows):
    return np.array([[0.0 if v is None else v for v in r[1:4]] for r in rows])


def test_folds_equal_models_fitted_alone(spark, frame, rows, fitted):
    """The model of fold k is the one that its earlier rows alone give (with the same bins)."""
    models, _ = fitted
    x = numbers(rows)
    y, total = np.array([int(r[4]) for r in rows]), np.array([r[5] for r in rows])
    fold = np.array([r[6] or 0 for r in rows])
    bins = B.binned(x, models[0].edges)
    for k in (1, 3, 6):
        own = fold < k
        s = np.zeros((own.sum(), 1, 4))
        s[:, :, -1] = total[own].mean()
        trees = [([], [], []) for _ in range(7)]
        for t in range(7):
            g, h = B._gradients(s, y[own], total[own], 3)
            f, b, v = np.full((4, 7), -1), np.full((4, 7), B.BINS), np.zeros((4, 8))
            for level in range(3):
                sums = np.zeros((4, 2**level, 3, B.BINS, 2))
                for out in range(4):
                    node = B._leaf(bins[own], f[out][: 2**level - 1], b[out][: 2**level - 1])
                    for j in range(3):
                        np.add.at(sums[out, :, j, :, 0], (node, bins[own][:, j]), g[:, 0, out])
                        np.add.at(sums[out, :, j, :, 1], (node, bins[own][:, j]), h[:, 0, out])
                at = slice(2**level - 1, 2 ** (level + 1) - 1)
                f[:, at], b[:, at], sides = B.best_splits(sums)
                if level == 2:
                    v = 0.3 * sides.reshape(4, 8)
            for out in range(4):
                s[:, 0, out] += v[out][B._leaf(bins[own], f[out], b[out])]
            trees[t] = (f, b, v)
        np.testing.assert_allclose(models[k - 1].outputs(bins[own]), s[:, 0], atol=1e-9)


def test_metrics_against_a_plain_computation(rows, fitted):
    models, scored = fitted
    got = {r["fold"]: r for r in B.fold_scores(scored, 5).collect()}
    x = B.binned(numbers(rows), models[0].edges)
    for k in range(1, 6):
        own = [i for i, r in enumerate(rows) if r[6] == k]
        s = models[k - 1].outputs(x[own])
        p = B.softmax(s[:, :3])
        y, total = np.array([int(rows[i][4]) for i in own]), np.array([rows[i][5] for i in own])
        assert (got[k]["n_train"], got[k]["n_test"]) == (100 * k, 100)
        assert got[k]["brier"] == pytest.approx(((p - np.eye(3)[y]) ** 2).sum(1).mean(), abs=1e-4)
        assert got[k]["accuracy"] == pytest.approx((p.argmax(1) == y).mean(), abs=1e-4)
        assert got[k]["rmse"] == pytest.approx(np.sqrt(((s[:, 3] - total) ** 2).mean()), abs=1e-4)
    summary = B.fold_summary(B.fold_scores(scored, 5)).first()
    briers = [got[k]["brier"] for k in range(1, 6)]
    assert summary["mean_brier"] == pytest.approx(np.mean(briers), abs=1e-4)
    assert summary["std_brier"] == pytest.approx(np.std(briers), abs=1e-4)
    assert got[5]["accuracy"] > 0.8 and got[5]["rmse"] < 0.6


def test_models_are_stored_and_found(spark, frame, fitted, tmp_path):
    folder = tmp_path.as_uri()
    assert stores.latest_model(spark, folder, "football", "outcome") is None
    first = stores.save_model(fitted[0][0], folder, "football", "outcome", {"rows": 100, "fold": 1})
    second = stores.save_model(fitted[0][-1], folder, "football", "outcome", {"rows": 600})
    assert first != second
    model, metadata = stores.latest_model(spark, folder, "football", "outcome")
    assert metadata == {"rows": 600}
    take = lambda m: [(r["match_id"], r["p"], r["prediction"], r["total"]) for r in m.transform(frame).orderBy("match_id").collect()]
    assert take(model) == take(fitted[0][-1])
    boosted = L.boosted(frame.limit(200), COLUMNS, trees=2, depth=2)
    stores.save_model(boosted, folder, "darts", "outcome", {"rows": 200})
    again, _ = stores.latest_model(spark, folder, "darts", "outcome")
    score = lambda m: [tuple(r["p"]) for r in L.predicted(m, frame, COLUMNS).orderBy("match_id").collect()]
    assert score(again) == score(boosted)
    linear = L.classifier(frame, COLUMNS)
    stores.save_model(linear, folder, "tennis", "outcome", {"rows": 600})
    again, _ = stores.latest_model(spark, folder, "tennis", "outcome")
    assert score(again) == score(linear)


def test_places_in_a_tree_are_those_of_a_walk():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (200, 4)).astype(np.uint8)
    feature, bins = rng.integers(-1, 4, 15), rng.integers(0, 8, 15)
    want = []
    for row in x:
        at = 0
        while at < 15:
            at = 2 * at + 1 + int(feature[at] >= 0 and row[feature[at]] > bins[at])
        want.append(at - 15)
    assert B._leaf(x, feature, bins).tolist() == want
    assert B._leaf(np.asfortranarray(x), feature, bins).tolist() == want
    assert B._shared([4, 5, 3, 30, 2], 60) == [[0, 1, 2], [3, 4]] and B._shared([9, 9], 1) == [[0], [1]]


def some_matches(spark, n):
    rng = random.Random(3)
    rows = [(i, rng.randrange(8), 8 + rng.randrange(8), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), rng.randrange(4), rng.randrange(3)) for i in range(n)]
    return spark.createDataFrame(rows, "match_id long, home long, away long, scheduled_at timestamp, home_score int, away_score int")


def test_training_ends_in_an_artifact_or_says_why(spark, tmp_path):
    folder = tmp_path.as_uri()
    metadata = W.train(some_matches(spark, 300), folder, "football", folds=3, trees=2, depth=2)
    assert [f["fold"] for f in metadata["by_fold"]] == [1, 2, 3] and metadata["mean_brier"] > 0
    _, found = stores.latest_model(spark, folder, "football", "outcome")
    assert found == {k: v for k, v in metadata.items() if k != "version"}
    with pytest.raises(W.NotTrained, match="too few rows"):
        W.train(some_matches(spark, 30), folder, "football")


def test_a_days_metrics_take_the_place_of_the_old(spark, tmp_path):
    path = f"{tmp_path.as_uri()}/metrics"
    schema = "model string, ledger string, day string, roi double"
    put = lambda *rows: stores.replace_keys(spark.createDataFrame(rows, schema), path, ["model", "day", "ledger"], "day")
    put(("m1", "REAL", "d1", 0.1), ("m1", "PAPER", "d1", 0.2), ("m2", "REAL", "d2", 0.3))
    before = spark.read.parquet(path).where("day = 'd2'").select("_metadata.file_name").distinct().collect()
    put(("m1", "REAL", "d1", 0.5), ("m3", "REAL", "d1", 0.6))
    put(("m1", "REAL", "d1", 0.5), ("m3", "REAL", "d1", 0.6))
    got = {(r["model"], r["ledger"], r["day"]): r["roi"] for r in spark.read.parquet(path).collect()}
    assert got == {("m1", "REAL", "d1"): 0.5, ("m1", "PAPER", "d1"): 0.2, ("m3", "REAL", "d1"): 0.6, ("m2", "REAL", "d2"): 0.3}
    assert spark.read.parquet(path).count() == 4
    assert spark.read.parquet(path).where("day = 'd2'").select("_metadata.file_name").distinct().collect() == before  # untouched


def test_rows_are_binned_before_they_are_placed(spark, monkeypatch):
    """The shuffles and sorts of the places carry bytes, not the numbers of all columns."""
    seen = []
    own = W.placed
    monkeypatch.setattr(W, "placed", lambda df, *a: seen.append(df.columns) or own(df, *a))
    models, scored = W.fold_models(some_matches(spark, 300), folds=3, trees=1, depth=1)
    assert len(models) == 4 and scored.where("fold = 3").count() > 0
    assert seen and all("x" in columns and not set(columns) & set(models[0].columns) for columns in seen)
