"""From the feature table to saved results: compare groups, evaluate the best, score the market."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from matchform.functions.feature_sets import FEATURE_GROUPS, SEARCH_SPACE
from matchform.operators.scoring import market_baseline
from matchform.operators.selection import Settings, compare_groups, evaluate_holdout
from matchform.sources.result_store import save_results


def train_and_evaluate(
    features: DataFrame,
    folder: str,
    groups: Mapping[str, Sequence[str]] = FEATURE_GROUPS,
    settings: Settings = Settings(),
    count: int = 20,
    space: Mapping[str, Sequence] = SEARCH_SPACE,
    fraction: float = 0.8,
) -> tuple[DataFrame, dict, DataFrame]:
    """Run the whole comparison, save it, and return the summary, holdout metrics and market line."""
    summary = compare_groups(features, groups, settings, count, space)
    best = summary.orderBy("best_mean_log_loss").first()
    holdout = evaluate_holdout(
        features, best["selected_features"], best["best_params"], fraction, settings
    )
    save_results(summary, holdout, features, folder)
    return summary, holdout.metrics, market_baseline(features, fraction, 1.0)
