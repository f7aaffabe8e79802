"""Raw matches and xG rows to the model-ready table, in one plan for all leagues and seasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from matchform.operators import assemble, history
from matchform.operators.assemble import MATCH_KEY
from matchform.operators.crosswalk import merge_crosswalk, seed_crosswalk
from matchform.operators.enrich import timed_matches, with_market_probs, with_match_key
from matchform.operators.ordering import chronological_number
from matchform.operators.reshape import match_sides, result_sides, xg_sides

FORM_COLUMNS = ("rest_days", *history.TEAM_MEANS, *history.VENUE_MEANS)
GLOBAL_ORDER = ("kickoff", "league", "match_id", "season")
# The key of a match with season and league packed into one column, which is never NULL and compares NULL as a value.
LEAGUE_SEASON = "league_season"
OWN_KEY = (LEAGUE_SEASON, "match_id")


def prematch_table(matches: DataFrame, **limits) -> DataFrame:
    """Matches with the form of both sides before kickoff."""
    form = history.form_features(match_sides(matches), **limits)
    return assemble.rejoin_sides(matches, form, FORM_COLUMNS).transform(assemble.with_differences)


def numbered_keys(matches: DataFrame, hot: bool = False) -> DataFrame:
    """Chronological ``__number`` of every match, by its key."""
    numbers = chronological_number(
        matches.select(*MATCH_KEY, "kickoff"), GLOBAL_ORDER[0], GLOBAL_ORDER[1:], "__number", hot
    )
    return numbers.select(F.struct("season", "league").alias(LEAGUE_SEASON), "match_id", "__number")


def rolling_xg_table(features: DataFrame, features_xg: DataFrame, **limits) -> DataFrame:
    """Feature rows with the rolling xG of both sides."""
    return assemble.attach_rolling_xg(features, history.xg_features(xg_sides(features_xg), **limits))


def xg_history(
    matches: DataFrame, xg: DataFrame, crosswalk: DataFrame, by_league: bool = False, **limits
) -> DataFrame:
    """Rolling xG of both sides of every match with an xG row, by its key.

    Seasons tell apart what kickoff and number leave tied, which is the chronological order in a league.
    """
    slim = with_match_key(matches.select(*MATCH_KEY, "kickoff", "HomeTeam", "AwayTeam"), crosswalk)
    joined = assemble.join_xg(slim.drop("home_team_code", "away_team_code"), xg, by_league)
    rolled = history.xg_features(xg_sides(joined, (*MATCH_KEY, "kickoff")), (*history.EVENT_ORDER, "season"), **limits)
    return rolled.withColumn(LEAGUE_SEASON, F.struct("season", "league"))


def build_features(
    raw: DataFrame,
    xg: DataFrame,
    curated: DataFrame,
    by_league: bool = False,
    ties: Sequence[str] = (),
    hot: bool = False,
    **limits,
) -> DataFrame:
    """The model-ready table; nothing runs before it is asked for.

    ``ties`` orders matches of the same teams at the same (or no) time. Wide rows move once, to their league-season:
    a match's own columns go with its home side through the form windows there. Numbers and xG are made from the
    keys alone and brought to the matches.
    """
    crosswalk = merge_crosswalk(seed_crosswalk(xg), curated)
    packed = raw.withColumn(LEAGUE_SEASON, F.struct("season", "league"))
    matches = timed_matches(packed, ties, (LEAGUE_SEASON,), hot=hot, **limits).withColumns(
        {name: F.col(f"{LEAGUE_SEASON}.{name}") for name in ("season", "league")}
    )
    kept = [name for name in assemble.match_columns() if name not in (*MATCH_KEY, "kickoff")]
    sides = match_sides(with_market_probs(matches), (*OWN_KEY, "kickoff"), kept)
    form = history.form_features(sides, hot=hot, keys=(LEAGUE_SEASON, "team"), **limits)
    table = assemble.regroup_sides(form, FORM_COLUMNS, (*OWN_KEY, "kickoff"), "carried")
    table = table.join(numbered_keys(matches, hot), list(OWN_KEY))
    rolled = xg_history(matches, xg, crosswalk, by_league, hot=hot, **limits)
    table = assemble.attach_rolling_xg(table, rolled.repartition(LEAGUE_SEASON), OWN_KEY)
    named = table.withColumns({"season": F.col(f"{LEAGUE_SEASON}.season"), "match_id": F.col("__number")})
    return assemble.select_model_columns(assemble.with_differences(named))


def prematch_from_results(matches: DataFrame, **limits) -> DataFrame:
    """Short pre-match table from results alone: points and goals over the last five."""
    means = {name: mean for name, mean in history.TEAM_MEANS.items()
             if mean[0] in history.LONG_MEASURES and mean[1] == 5}
    sides = result_sides(matches)
    form = history.rolling_mean(sides, history.FORM_KEYS, history.EVENT_ORDER, means, **limits)
    kept = matches.select("season", "league", "match_id", "kickoff", "HomeTeam", "AwayTeam", "FTR")
    return assemble.with_differences(assemble.rejoin_sides(kept, form, tuple(means)))
