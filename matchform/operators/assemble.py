"""Joins that bring histories, expected goals, prices and predictions back to matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from matchform.functions import scalars as S
from matchform.operators.reshape import VENUES

MATCH_KEY = ("season", "league", "match_id")

MODEL_COLUMNS = (
    "match_id", "kickoff", "HomeTeam", "AwayTeam", "Div", "season", "FTR", "Referee",
    "market_home_prob_fair", "market_draw_prob_fair", "market_away_prob_fair",
    "best_odds_home", "best_odds_draw", "best_odds_away",
    "home_points_home_last_5", "away_points_away_last_5",
    "goals_difference_last_5", "points_difference_last_5",
    "home_fouls_for_last_5", "away_fouls_for_last_5",
    "home_corners_for_last_5", "away_corners_for_last_5",
    "rest_days_diff",
    "home_xg_last_5", "away_xg_last_5",
    "home_xg_against_last_5", "away_xg_against_last_5",
    "home_points_last_5", "away_points_last_5",
    "home_goals_for_last_5", "away_goals_for_last_5",
    "home_goals_against_last_5", "away_goals_against_last_5",
    "home_shots_on_target_for_last_5", "away_shots_on_target_for_last_5",
)

BEST_ODDS = {"MaxH": "best_odds_home", "MaxD": "best_odds_draw", "MaxA": "best_odds_away"}


# A key of three parts, one of which is empty.
INCOMPLETE_KEY = "^(_[^_]*_[^_]*|[^_]*__[^_]*|[^_]*_[^_]*_)$"


def side_name(feature: str, venue: str) -> str:
    """``points_venue_last_5`` at home -> ``home_points_home_last_5``."""
    return f"{venue}_{feature.replace('_venue_', f'_{venue}_')}"


def rejoin_sides(
    matches: DataFrame, history: DataFrame, features: Sequence[str], key: Sequence[str] = MATCH_KEY
) -> DataFrame:
    """Match rows with the features of their home and away side.

    A match has one row per side, so one aggregation replaces a join per side and kind of
    feature; the left join then reuses its partitioning.
    """
    sides = history.groupBy(*key).agg(
        *[
            F.max(F.when(F.col("venue") == venue, F.col(feature))).alias(side_name(feature, venue))
            for venue in VENUES
            for feature in features
        ]
    )
    return matches.join(sides, list(key), "left")


def regroup_sides(
    history: DataFrame, features: Sequence[str], key: Sequence[str], carried: str
) -> DataFrame:
    """One row per match from its two sides: the fields ``carried`` by the home row, and both sides' features.

    The key starts with a struct and tells matches apart. Nothing moves where the sides already lie together by a part
    of it. As in a join, a match with NULL in the struct has no features.
    """
    sides = history.groupBy(*key).agg(
        F.max(carried).alias(carried),
        *[
            F.max(F.when(F.col("venue") == venue, F.col(feature))).alias(side_name(feature, venue))
            for venue in VENUES
            for feature in features
        ],
    )
    named = all_present([F.col(f"{key[0]}.{part}") for part in history.schema[key[0]].dataType.names])
    wanted = [side_name(feature, venue) for venue in VENUES for feature in features]
    return sides.select(*key, f"{carried}.*", *[F.when(named, F.col(name)).alias(name) for name in wanted])


def with_differences(df: DataFrame) -> DataFrame:
    """Home minus away over the last five matches, for points and goals."""
    return df.withColumns(
        {
            "points_difference_last_5": S.difference(
                F.col("home_points_last_5"), F.col("away_points_last_5")
            ),
            "goals_difference_last_5": S.difference(
                F.col("home_goals_for_last_5"), F.col("away_goals_for_last_5")
            ),
        }
    )


def join_xg(features: DataFrame, xg: DataFrame, by_league: bool = False) -> DataFrame:
    """Matches that have an xG row with the same date and codes; repeated keys fan out.

    Codes are not unique across leagues; ``by_league`` adds the league to the key. A key that lacks its
    date or a code matches nothing, so those rows are left out before they are shuffled.
    """
    keyed = xg.select(
        S.xg_key(F.col("date"), F.col("home_team_code"), F.col("away_team_code")).alias(
            "match_concat"
        ),
        "home_xg",
        "away_xg",
        *(["league"] if by_league else []),
    )
    names = ["match_concat", "league"] if by_league else ["match_concat"]
    return features.filter(~F.col("match_concat").rlike(INCOMPLETE_KEY)).join(keyed, names)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def attach_rolling_xg(features: DataFrame, history: DataFrame, key: Sequence[str] = ("match_id",)) -> DataFrame:
    """All feature rows with both sides' rolling xG; a match repeated in the history fans out.

    The history is grouped by match once. A match with several rows per side gets every home row
    with every away row, as two joins would give.
    """
    names = ("xg_last_5", "xg_against_last_5")
    sides = history.groupBy(*key).agg(
        *[F.collect_list(F.when(F.col("venue") == venue, F.struct(*names))).alias(f"__{venue}") for venue in VENUES]
    )
    joined = features.join(sides, list(key), "left")
    for venue in VENUES:
        joined = joined.withColumn(f"__{venue}", F.explode_outer(f"__{venue}"))
    columns = {f"{venue}_{name}": F.col(f"__{venue}.{name}") for venue in VENUES for name in names}
    return joined.withColumns(columns).drop(*[f"__{venue}" for venue in VENUES])


def match_columns() -> list[str]:
    """Columns of the model-ready table that a match has of its own, under the names they have before."""
    before = {new: old for old, new in BEST_ODDS.items()}
    return [before.get(name, name) for name in MODEL_COLUMNS[: MODEL_COLUMNS.index("best_odds_away") + 1]]


def select_model_columns(df: DataFrame) -> DataFrame:
    """The 35 columns of the model-ready table, in order."""
    return (
        df.withColumn("rest_days_diff", S.difference(F.col("home_rest_days"), F.col("away_rest_days")))
        .withColumnsRenamed(BEST_ODDS)
        .select(*MODEL_COLUMNS)
    )


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that stops when a key repeats on either side.

    Both sides are counted by the join key, so the check costs no shuffle the join would not do.
    """
    return _unique(left, key, "left").join(_unique(right, key, "right"), key, "left")


def _unique(df: DataFrame, key: str, side: str) -> DataFrame:
    others = [name for name in df.columns if name != key]
    message = f"{key} repeats on the {side} side"
    return (
        df.groupBy(key)
        .agg(*[F.first(name).alias(name) for name in others], F.count("*").alias("__rows"))
        .filter(F.assert_true(F.col("__rows") == 1, message).isNull())
        .drop("__rows")
    )


def attach_best_odds(scored: DataFrame, features: DataFrame) -> DataFrame:
    """Scored rows with the best price of each outcome."""
    return scored.join(features.select("match_id", *BEST_ODDS.values()), "match_id", "left")


def all_present(columns: Sequence[str | Column]) -> Column:
    """Condition that none of ``columns`` is NULL."""
    present = F.lit(True)
    for column in columns:
        present = present & (F.col(column) if isinstance(column, str) else column).isNotNull()
    return present
