"""Model fitting and selection on the test matches.

A fitted model's numbers have no SQL. What the contract fixes has: which rows are held out, which seasons
validate, and that every row gets three probabilities that sum to one. Those columns are returned.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from matchform.catalog import sql_common as Q
from matchform.catalog.fold_queries import NUMERIC
from matchform.catalog.history_queries import HISTORY, SIDE_JOINS
from matchform.catalog.join_queries import model_sql, model_table
from matchform.catalog.registry import query, rounded
from matchform.functions.feature_sets import FEATURE_GROUPS, SEARCH_SPACE
from matchform.operators import folds, history, reshape, selection
from matchform.operators.assemble import rejoin_sides, with_differences
from matchform.operators.scoring import MODEL_PROBS
from matchform.plans import features

FEATURES = ["points_difference_last_5", "goals_difference_last_5", "market_home_prob_fair"]
PARAMS = {"num_leaves": 15, "max_depth": 4, "min_child_samples": 20, "subsample": 0.8, "colsample_bytree": 1.0}
THRESHOLD = 0.5


def _form_table(t):
    """Matches with short form and the market's view of the home side."""
    means = {f"{m}_last_5": (m, 5) for m in history.LONG_MEASURES}
    sides = history.rolling_mean(
        reshape.result_sides(t.matches()), history.FORM_KEYS, history.EVENT_ORDER, means
    )
    kept = t.matches().select(
        "season", "league", "match_id", "kickoff", "Div", "FTR", "market_home_prob_fair"
    )
    return with_differences(rejoin_sides(kept, sides, tuple(means)))


_COMPLETE = f"""{HISTORY}, form AS (SELECT *, {Q.means(Q.FORM, [("points", 5), ("goals_for", 5)])} FROM history),
form_table AS (SELECT m.match_id, m.season, m."Div", m."FTR", market_home_prob_fair,
  home.points_last_5 - away.points_last_5 AS points_difference_last_5,
  home.goals_for_last_5 - away.goals_for_last_5 AS goals_difference_last_5 FROM matches m {SIDE_JOINS})"""


def _known(columns) -> str:
    return " AND ".join(f'"{c}" IS NOT NULL' for c in ("FTR", *columns))


def _with_sum(predictions):
    total = sum((F.col(p) for p in MODEL_PROBS[1:]), F.col(MODEL_PROBS[0]))
    return predictions.select("match_id", F.round(total, 6).alias("probability_sum"))


def _drop_correlated_sql() -> str:
    """The greedy walk as one step per candidate: it stays if no kept one before it is close to it."""
    corr = " UNION ALL ".join(
        f"""SELECT {i} AS i, {j} AS j, coalesce(abs(corr("{a}", "{b}")) > {THRESHOLD}, false) AS close FROM train"""
        for (i, a), (j, b) in combinations(enumerate(NUMERIC), 2)
    )
    steps = ["k0 AS (SELECT true AS stays)"]
    for j in range(1, len(NUMERIC)):
        rivals = " OR ".join(f"((SELECT stays FROM k{i}) AND (SELECT close FROM pairs WHERE i = {i} AND j = {j}))" for i in range(j))
        steps.append(f"k{j} AS (SELECT NOT ({rivals}) AS stays)")
    rows = " UNION ALL ".join(f"SELECT {j} AS place, '{name}' AS feature, stays FROM k{j}" for j, name in enumerate(NUMERIC))
    return f"""WITH {Q.RAW}, {Q.MEASURES}, train AS (SELECT * FROM raw_measures WHERE season < (SELECT max(season) FROM raw)),
        pairs AS ({corr}), {", ".join(steps)}, walk AS ({rows} UNION ALL SELECT {len(NUMERIC)}, 'Div', true)
        SELECT cast(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS position, feature FROM walk WHERE stays"""


@query("q_drop_correlated", _drop_correlated_sql())
def drop_correlated(t):
    train, _ = folds.season_holdout(t.raw_with_measures())
    kept = folds.drop_correlated(train, [*NUMERIC, "Div"], NUMERIC, THRESHOLD)
    return t.spark.createDataFrame(list(enumerate(kept)), "position int, feature string")


@query(
    "q_holdout_model",
    f"""WITH {_COMPLETE}, placed AS (SELECT match_id, row_number() OVER (ORDER BY match_id) AS n, count(*) OVER () AS total
          FROM form_table WHERE {_known(FEATURES)})
        SELECT match_id, 1.0::DOUBLE AS probability_sum FROM placed WHERE n > trunc(total * 0.8::DOUBLE)""",
)
def holdout_model(t):
    return _with_sum(selection.evaluate_holdout(_form_table(t), FEATURES, PARAMS).predictions)


@query(
    "q_final_season_model",
    f"""WITH {_COMPLETE}, known AS (SELECT * FROM form_table WHERE {_known([*FEATURES, "Div", "season"])})
        SELECT match_id, 1.0::DOUBLE AS probability_sum FROM known WHERE season = (SELECT max(season) FROM known)""",
)
def final_season_model(t):
    return _with_sum(selection.evaluate_final_season(_form_table(t), [*FEATURES, "Div"], PARAMS).predictions)


@query(
    "q_prematch_from_results",
    f"""WITH {HISTORY}, form AS (SELECT *, {Q.means(Q.FORM, [(m, 5) for m in ("points", "goals_for", "goals_against")])} FROM history)
        SELECT m.season, m.league, m.match_id, m."HomeTeam", m."AwayTeam",
          round(home.points_last_5 - away.points_last_5, 6) AS points_difference_last_5,
          round(home.goals_for_last_5 - away.goals_for_last_5, 6) AS goals_difference_last_5,
          round(home.goals_against_last_5, 6) AS home_goals_against_last_5, round(away.goals_against_last_5, 6) AS away_goals_against_last_5
        FROM matches m {SIDE_JOINS}""",
)
def prematch_from_results(t):
    wanted = ["points_difference_last_5", "goals_difference_last_5", "home_goals_against_last_5", "away_goals_against_last_5"]
    found = features.prematch_from_results(t.matches())
    return rounded(found.select("season", "league", "match_id", "HomeTeam", "AwayTeam", *wanted))


def _group_sql(name: str, members) -> str:
    known = " AND ".join(f'"{c}" IS NOT NULL' for c in ("match_id", "season", "FTR", *members))
    return f"""SELECT '{name}' AS grouping, cast({len(members)} AS INTEGER) AS feature_count, string_agg(season, ' ' ORDER BY season) AS validation_seasons,
        cast(count(*) AS INTEGER) AS folds FROM (
          SELECT season, row_number() OVER (ORDER BY season) AS n, count(*) OVER () AS total
          FROM (SELECT DISTINCT season FROM model WHERE {known})) WHERE n > 2 AND n < total"""


@query("q_group_comparison", f"WITH model AS ({model_sql()}) {' UNION ALL '.join(_group_sql(*g) for g in FEATURE_GROUPS.items())}")
def group_comparison(t):
    """All published groups and their features, up to eight selected; one parameter sample of the full space, four rounds."""
    settings = selection.Settings(trees=4)
    found = selection.compare_groups(model_table(t), FEATURE_GROUPS, settings, count=1, space=SEARCH_SPACE)
    seasons = F.array_join("validation_seasons", " ").alias("validation_seasons")
    return found.select("grouping", "feature_count", seasons, F.size("fold_log_losses").alias("folds"))
