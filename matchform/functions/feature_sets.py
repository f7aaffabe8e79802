"""Candidate feature groups for model comparison; market probabilities are never among them."""

from __future__ import annotations

# The published feature groups, in their order.
FEATURE_GROUPS = {
    "team_identity": ["HomeTeam", "AwayTeam", "Div"],
    "results_form": [
        "home_points_last_5",
        "away_points_last_5",
        "home_goals_for_last_5",
        "away_goals_for_last_5",
        "home_goals_against_last_5",
        "away_goals_against_last_5",
        "home_points_home_last_5",
        "away_points_away_last_5",
    ],
    "xg_form": [
        "home_xg_last_5",
        "away_xg_last_5",
        "home_xg_against_last_5",
        "away_xg_against_last_5",
        "home_shots_on_target_for_last_5",
        "away_shots_on_target_for_last_5",
    ],
    "results_plus_xg": [
        "points_difference_last_5",
        "goals_difference_last_5",
        "home_points_home_last_5",
        "away_points_away_last_5",
        "home_xg_last_5",
        "away_xg_last_5",
        "home_xg_against_last_5",
        "away_xg_against_last_5",
    ],
    "teams_plus_form": [
        "HomeTeam",
        "AwayTeam",
        "Div",
        "home_xg_last_5",
        "away_xg_last_5",
        "home_xg_against_last_5",
        "away_xg_against_last_5",
        "points_difference_last_5",
        "rest_days_diff",
    ],
}

CATEGORICAL_FEATURES = ("HomeTeam", "AwayTeam", "Referee", "Div")

# The published search space of the tree model's parameters.
SEARCH_SPACE = {
    "num_leaves": [7, 15, 31],
    "max_depth": [3, 4, 6],
    "learning_rate": [0.01, 0.03, 0.05],
    "min_child_samples": [20, 30, 50],
    "subsample": [0.7, 0.8, 1.0],
    "colsample_bytree": [0.7, 0.8, 1.0],
    "reg_lambda": [0.0, 1.0, 5.0],
}


def default_features() -> list[str]:
    """Every feature of any group, once, in order of first mention."""
    seen: dict[str, None] = {}
    for members in FEATURE_GROUPS.values():
        seen.update(dict.fromkeys(members))
    return [*seen]
