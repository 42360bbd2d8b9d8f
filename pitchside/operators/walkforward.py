"""Training that ends in a stored model: gate, folds, final fit, artifact with its metrics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.operators import boosting as B
from pitchside.operators import training as T
from pitchside.operators.histories import fold_of, placed
from pitchside.sources.scratch import cut
from pitchside.sources.stores import save_model


class NotTrained(ValueError):
    """No model is fitted; the text says why."""


def fold_models(matches: DataFrame, folds: int = 5, gated: bool = True, **settings: Any) -> tuple[list[B.Trees], DataFrame]:
    """The models of the folds and of all rows, and the scored rows, of matches whose training set passes the gate (if gated)."""
    rows = cut(T.training_set(matches))
    passed = T.gate(rows, T.COLUMNS) if gated else "ok"
    if passed != "ok":
        raise NotTrained(f"no model is fitted: {passed}")
    place = lambda df: placed(df, F.to_date("scheduled_at"), "match_id")
    return B.boosted_folds(rows, T.COLUMNS, fold_of(F.col("n_"), folds, F.col("position_")), folds, place=place, **settings)


def train(matches: DataFrame, folder: str, sport: str, kind: str = "outcome", folds: int = 5, gated: bool = True, **settings: Any) -> dict[str, Any]:
    """Fits and stores the final model with the metrics of its folds; gives the metadata and the version."""
    models, scored = fold_models(matches, folds, gated, **settings)
    by_fold = cut(B.fold_scores(scored, folds))
    summary = B.fold_summary(by_fold).first().asDict()
    detail = [r.asDict() for r in by_fold.orderBy("fold").collect()]  # a row for each fold
    metadata = {"rows": scored.count(), "columns": models[-1].columns, "settings": settings, "by_fold": detail} | summary
    return metadata | {"version": save_model(models[-1], folder, sport, kind, metadata)}
