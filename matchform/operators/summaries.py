"""Aggregates over features and validation summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from matchform.operators.assemble import all_present
from matchform.operators.ordering import ascending, place
from matchform.operators.scoring import share


def kpis(df: DataFrame) -> DataFrame:
    """One row: matches, seasons, leagues and the share of home wins."""
    return df.agg(
        F.count("*").alias("matches"),
        F.countDistinct("season").alias("seasons"),
        F.countDistinct("Div").alias("leagues"),
        share(F.col("FTR") == "H").alias("home_win_rate"),
    )


def matches_used(
    df: DataFrame, groups: Mapping[str, Sequence[str]], always: Sequence[str] = ("FTR", "season")
) -> DataFrame:
    """Rows without a missing value per feature group, all groups in one pass."""
    counts = df.agg(
        *[
            F.count(F.when(all_present([*always, *columns]), 1)).alias(name)
            for name, columns in groups.items()
        ]
    )
    rows = [F.struct(F.lit(name).alias("grouping"), F.col(name).alias("matches_used")) for name in groups]
    return counts.select(F.inline(F.array(*rows)))


def coverage_flag(used: DataFrame) -> DataFrame:
    """One row: smallest and largest coverage, and whether they differ enough to warn."""
    low, high = F.col("lowest"), F.col("highest")
    return used.agg(
        F.min("matches_used").alias("lowest"), F.max("matches_used").alias("highest")
    ).withColumn(
        "flag",
        F.when(low < F.lit(0.9) * high, "warn").when(low < high, "note").otherwise("even"),
    )


def cv_mean(losses: DataFrame) -> DataFrame:
    """Unweighted mean of the fold losses per grouping."""
    return losses.groupBy("grouping").agg(F.avg("log_loss").alias("mean_log_loss"))


def best_group(means: DataFrame) -> DataFrame:
    """The grouping with the smallest mean loss; ties go to the first name."""
    return means.orderBy("mean_log_loss", "grouping").limit(1)


def coverage_gap(df: DataFrame, missing: str, present: str) -> DataFrame:
    """One row: how often ``missing`` is NULL although ``present`` is not."""
    gap = F.col(missing).isNull() & F.col(present).isNotNull()
    return df.filter(gap).agg(F.count("*").alias("rows"))


def category_index(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their zero-based rank in sorted order.

    The result has one row per category, so ranking it is a small job whatever the table's size.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    placed = place(values, ascending(column), "__rank").rows
    return placed.select(column, (F.col("__rank") - 1).alias("category_index"))
