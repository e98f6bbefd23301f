"""Split, fill, scale, tune, fit, score and explain a regression forest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.forest import (
    CANDIDATES,
    FOLDS,
    IMPUTE_TREES,
    TREES_PER_BAG,
    Forest,
    ForestImputer,
    ForestSpec,
    fit_bagged,
    fit_forest,
    fit_imputer,
    latin_grid,
    permutation_importance,
    predict,
    regression_metrics,
    tune_forest,
)
from freshet.operators.splitting import exact_split, standardize, unscale
from freshet.sources.workspace import stored


@dataclass(frozen=True)
class ModelRun:
    model: Forest
    imputer: ForestImputer
    candidates: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    importance: DataFrame


def run_model(
    rows: DataFrame,
    row_id: str,
    target: str,
    predictors: Sequence[str],
    spec: ForestSpec | None = None,
    folds: int = FOLDS,
    impute_trees: int = IMPUTE_TREES,
    share: float = 0.70,
    candidates: int = CANDIDATES,
    trees_per_bag: int = TREES_PER_BAG,
) -> ModelRun:
    """One forest from raw rows to importance.

    Gaps and scales are learnt from training rows only and applied to test rows. The forest with
    the tuned setting is fitted with all its trees; predictions return to the target's own scale
    before they are scored. The forest that is explained has the same setting and draws rows
    without replacement.
    """
    spec = spec or ForestSpec()
    kept = rows.select(row_id, target, *predictors)
    split = stored(exact_split(kept, row_id, share), "split")
    is_train = F.col("split") == "train"
    imputer = fit_imputer(split.where(is_train), predictors, row_id, impute_trees)
    filled = stored(imputer.transform(split), "filled")
    known = filled.where(is_train)
    scaled = stored(standardize(filled, [target, *predictors], known), "scaled")
    train, test = scaled.where(is_train), scaled.where(~is_train)

    grid = latin_grid(rows.sparkSession, len(predictors), candidates)
    tuned, compared = tune_forest(train, target, predictors, row_id, grid, spec, folds)
    model = fit_forest(train, target, predictors, tuned)
    scored = unscale(predict(model, test), [target, "prediction"], known, target)
    explained = fit_bagged(train, target, predictors, row_id, replace(tuned, bootstrap=False), trees_per_bag)
    importance = permutation_importance(explained, train, row_id)
    metrics = regression_metrics(scored, f"{target}_unscaled", "prediction_unscaled")
    return ModelRun(model, imputer, compared, scored, metrics, importance)
