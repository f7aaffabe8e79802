"""Unpivots, pivots and stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from matchform.functions import scalars as S

VENUES = ("home", "away")


def to_sides(
    df: DataFrame,
    keep: Sequence[str],
    measures: Mapping[str, tuple[Column, Column]],
    home: str = "HomeTeam",
    away: str = "AwayTeam",
) -> DataFrame:
    """Two rows per match, one from each team's side.

    ``measures`` gives for every output column its expression for the home and the away row.
    One explode of two structs: the source is scanned once and nothing is shuffled.
    """
    rows = [
        F.struct(
            F.col(team).alias("team"),
            F.lit(venue).alias("venue"),
            *[pair[index].alias(name) for name, pair in measures.items()],
        )
        for index, (venue, team) in enumerate(zip(VENUES, (home, away)))
    ]
    return df.select(*keep, F.explode(F.array(*rows)).alias("side")).select(*keep, "side.*")


def swapped(home: str, away: str) -> tuple[Column, Column]:
    """A measure both sides have: ``home`` on the home row, ``away`` on the away row."""
    return F.col(home), F.col(away)


def match_sides(
    matches: DataFrame,
    keep: Sequence[str] = ("season", "league", "match_id", "kickoff"),
    carried: Sequence[str] = (),
) -> DataFrame:
    """Team history of the match table: results, goals, shots, fouls, corners and cards.

    ``carried`` columns of the match go with its home row as the struct ``carried``.
    """
    row = F.struct(*carried)
    with_home = {"carried": (row, F.when(F.lit(False), row))} if carried else {}
    return to_sides(
        matches,
        keep,
        {
            "goals_for": swapped("FTHG", "FTAG"),
            "goals_against": swapped("FTAG", "FTHG"),
            "fouls_for": swapped("HF", "AF"),
            "corners_for": swapped("HC", "AC"),
            "yellow_cards_for": swapped("HY", "AY"),
            "red_cards_for": swapped("HR", "AR"),
            "points": (S.points(F.col("FTR"), "home"), S.points(F.col("FTR"), "away")),
            "shots_for": swapped("HS", "AS"),
            "shots_on_target_for": swapped("HST", "AST"),
            **with_home,
        },
    )


def result_sides(matches: DataFrame) -> DataFrame:
    """Team history with results and goals only."""
    return to_sides(
        matches,
        ("season", "league", "match_id", "kickoff"),
        {
            "goals_for": swapped("FTHG", "FTAG"),
            "goals_against": swapped("FTAG", "FTHG"),
            "points": (S.points(F.col("FTR"), "home"), S.points(F.col("FTR"), "away")),
        },
    )


def xg_sides(matches: DataFrame, keep: Sequence[str] = ("match_id", "kickoff", "league")) -> DataFrame:
    """Team history of expected goals created and conceded."""
    return to_sides(
        matches,
        keep,
        {"xg": swapped("home_xg", "away_xg"), "xg_against": swapped("away_xg", "home_xg")},
    )


def team_view(features: DataFrame, team: str | None = None) -> DataFrame:
    """Matches as each team saw them; one team when ``team`` is given."""
    sides = to_sides(
        features,
        ("match_id", "kickoff", "season", "Div", "FTR"),
        {
            "opponent": swapped("AwayTeam", "HomeTeam"),
            "xg_last_5": swapped("home_xg_last_5", "away_xg_last_5"),
            "win_prob": swapped("market_home_prob_fair", "market_away_prob_fair"),
            "points_venue_last_5": swapped("home_points_home_last_5", "away_points_away_last_5"),
        },
    )
    return sides if team is None else sides.filter(F.col("team") == team)


def outcome_shares(df: DataFrame, key: str = "Div", result: str = "FTR") -> DataFrame:
    """Share of H, D and A per key, zero where an outcome never happened."""
    return df.filter(F.col(result).isNotNull()).groupBy(key).agg(
        *[F.avg(F.when(F.col(result) == o, 1.0).otherwise(0.0)).alias(o) for o in S.OUTCOMES]
    )


def season_counts(
    df: DataFrame, leagues: Sequence[str] | None = None, season: str = "season", key: str = "Div"
) -> DataFrame:
    """Matches per season with one column per league, and all matches of the season.

    The leagues are those of the data (a handful of names) unless given. ``Total`` counts every match,
    also those of other leagues or of none.
    """
    if leagues is None:
        known = df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(key)
        leagues = [row[key] for row in known.collect()]
    counts = [F.count(F.when(F.col(key) == league, 1)).alias(league) for league in leagues]
    return df.groupBy(season).agg(*counts, F.count("*").alias("Total"))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is NULL there."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def entities(df: DataFrame, home: str = "HomeTeam", away: str = "AwayTeam") -> DataFrame:
    """Distinct team names from both sides, sorted."""
    return (
        df.select(F.explode(F.array(home, away)).alias("team")).distinct().orderBy("team")
    )


def fold_losses(summary: DataFrame) -> DataFrame:
    """One row per grouping and validation season from the arrays of a validation summary."""
    pairs = F.arrays_zip("validation_seasons", "fold_log_losses")
    return summary.select("grouping", F.explode(pairs).alias("fold")).select(
        "grouping",
        F.col("fold.validation_seasons").alias("validation_season"),
        F.col("fold.fold_log_losses").alias("log_loss"),
    )
