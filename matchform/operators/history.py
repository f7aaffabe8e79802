"""Form before the event: rolling means, previous events and rest days.

Every frame ends one row earlier unless the caller asks for the current row, so a feature never
sees its own match. Partition keys are always explicit: results start again each season, expected
goals carry over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from matchform.functions import scalars as S
from matchform.operators.ordering import (
    BLOCK_ROWS,
    ascending,
    in_blocks,
    with_lookback,
)

FORM_KEYS = ("season", "league", "team")
VENUE_KEYS = ("season", "league", "team", "venue")
XG_KEYS = ("league", "team")
EVENT_ORDER = ("kickoff", "match_id")

LONG_MEASURES = ("points", "goals_for", "goals_against")
SHORT_MEASURES = (
    "shots_for", "shots_on_target_for", "fouls_for", "corners_for", "yellow_cards_for",
    "red_cards_for",
)

Means = Mapping[str, tuple[str, int]]

TEAM_MEANS: Means = {
    f"{measure}_last_{size}": (measure, size)
    for measures, sizes in ((LONG_MEASURES, (5, 10)), (SHORT_MEASURES, (5,)))
    for measure in measures
    for size in sizes
}
TEAM_MEANS_10_ALL: Means = {
    f"{measure}_last_10": (measure, 10) for measure in LONG_MEASURES + SHORT_MEASURES
}
VENUE_MEANS: Means = {
    f"{measure}_venue_last_{size}": (measure, size) for measure in LONG_MEASURES for size in (5, 10)
}
XG_MEANS: Means = {"xg_last_5": ("xg", 5), "xg_against_last_5": ("xg_against", 5)}


def mean_columns(
    window: WindowSpec, means: Means, include_current: bool = False, min_count: int = 1
) -> dict[str, Column]:
    """Rolling means over the last ``n`` rows, NULL below ``min_count`` known values."""
    columns = {}
    for name, (measure, size) in means.items():
        frame = window.rowsBetween(1 - size, 0) if include_current else window.rowsBetween(-size, -1)
        mean = F.avg(measure).over(frame)
        if min_count > 1:
            mean = F.when(F.count(measure).over(frame) >= min_count, mean)
        columns[name] = mean
    return columns


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    means: Means,
    include_current: bool = False,
    min_count: int = 1,
    **limits,
) -> DataFrame:
    """Add rolling means; all of them share one shuffle and one sort."""
    longest = max(size for _, size in means.values())
    return with_lookback(
        df, keys, order, longest,
        lambda window: mean_columns(window, means, include_current, min_count),
        **limits,
    )


def previous_event(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, **limits
) -> DataFrame:
    """The previous row's ``column`` within ``keys``."""
    return with_lookback(
        df, keys, order, 1, lambda window: {name: F.lag(column).over(window)}, **limits
    )


def rest_days(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], moment: str = "kickoff", **limits
) -> DataFrame:
    """Days since the same entity's previous event."""
    return previous_event(df, keys, order, moment, "__previous", **limits).withColumn(
        "rest_days", S.rest_days(F.col(moment), F.col("__previous"))
    ).drop("__previous")


def form_features(
    history: DataFrame,
    team_means: Means = TEAM_MEANS,
    venue_means: Means = VENUE_MEANS,
    hot: bool = False,
    block_rows: int = BLOCK_ROWS,
    keys: Sequence[str] = FORM_KEYS,
) -> DataFrame:
    """Rest days, overall form and venue form of a per-season team history.

    The venue keys extend the team keys, so the second window reuses the first one's shuffle and
    its groups cannot be larger.
    """
    longest = max(size for _, size in [*team_means.values(), *venue_means.values()])

    def team_columns(window: WindowSpec) -> dict[str, Column]:
        previous = F.lag("kickoff").over(window)
        return {"__previous": previous, **mean_columns(window, team_means)}

    def venue_columns(window: WindowSpec) -> dict[str, Column]:
        return mean_columns(window, venue_means)

    if hot:
        def add(df, keys, build):
            return in_blocks(df, keys, EVENT_ORDER, longest, build, block_rows)
    else:
        def add(df, keys, build):
            return with_plain_window(df, keys, build)

    form = add(history, keys, team_columns)
    form = form.withColumn("rest_days", S.rest_days(F.col("kickoff"), F.col("__previous")))
    return add(form.drop("__previous"), (*keys, "venue"), venue_columns)


def with_plain_window(df: DataFrame, keys: Sequence[str], build) -> DataFrame:
    """Window columns with one task per group."""
    return df.withColumns(build(Window.partitionBy(*keys).orderBy(*ascending(*EVENT_ORDER))))


def xg_features(history: DataFrame, order: Sequence[str] = EVENT_ORDER, **limits) -> DataFrame:
    """Expected goals over the last five matches, across seasons.

    A match joined to several xG rows appears several times; the measures break that tie.
    """
    return rolling_mean(history, XG_KEYS, (*order, "xg", "xg_against"), XG_MEANS, **limits)
