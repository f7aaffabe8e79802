"""Match-level columns: kickoff, number, codes, key and market probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from matchform.functions import scalars as S
from matchform.operators.crosswalk import attach_codes
from matchform.operators.ordering import number_rows

LEAGUE_SEASON = ("season", "league")


def with_market_probs(df: DataFrame) -> DataFrame:
    """Implied and margin-free probabilities from the average prices ``AvgH/AvgD/AvgA``."""
    implied = {
        "market_home_prob": S.implied_prob(F.col("AvgH")),
        "market_draw_prob": S.implied_prob(F.col("AvgD")),
        "market_away_prob": S.implied_prob(F.col("AvgA")),
    }
    fair = S.fair_probs(*[F.col(name) for name in implied])
    return df.withColumns(implied).withColumns(
        {f"{name}_fair": prob for name, prob in zip(implied, fair)}
    )


def number_matches(
    df: DataFrame, ties: Sequence[str] = (), keys: Sequence[str] = LEAGUE_SEASON, **limits
) -> DataFrame:
    """Zero-based ``match_id`` per league and season, by kickoff and names, then ``ties``."""
    order = ("kickoff", "HomeTeam", "AwayTeam", *ties)
    return number_rows(df, keys, order, "match_id", start=0, **limits)


def timed_matches(
    raw: DataFrame, ties: Sequence[str] = (), keys: Sequence[str] = LEAGUE_SEASON, **limits
) -> DataFrame:
    """Raw match rows with kickoff and ``match_id``."""
    parsed = raw.withColumn("kickoff", S.parse_kickoff(F.col("Date"), F.col("Time")))
    return number_matches(parsed, ties, keys, **limits)


def with_match_key(matches: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Matches with the codes of both teams and ``match_concat``."""
    return attach_codes(matches, crosswalk).withColumn(
        "match_concat",
        S.match_key(F.col("kickoff"), F.col("home_team_code"), F.col("away_team_code")),
    )


def enrich_matches(
    raw: DataFrame, crosswalk: DataFrame, ties: Sequence[str] = (), **limits
) -> DataFrame:
    """Raw match rows with kickoff, ``match_id``, codes, ``match_concat`` and probabilities."""
    return with_market_probs(with_match_key(timed_matches(raw, ties, **limits), crosswalk))
