"""Row filters and schema checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from matchform.functions import scalars as S


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Stop before any job runs if ``df`` lacks a column, and name all that it lacks."""
    have = set(df.columns)
    lacking = sorted({name for name in columns if name not in have})
    if lacking:
        raise KeyError(f"the table has no {', '.join(map(repr, lacking))}")


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every one of ``columns`` is known; NaN counts as missing.

    Plain conjuncts, so that a Parquet scan below receives the NULL checks.
    """
    require_columns(df, columns)
    types = dict(df.dtypes)
    for column in dict.fromkeys(columns):
        df = df.filter(F.col(column).isNotNull())
        if types[column] in ("double", "float"):
            df = df.filter(~F.isnan(F.col(column)))
    return df


def scope(df: DataFrame, leagues: Sequence[str], first: str, last: str) -> DataFrame:
    """Rows of the given leagues between two season labels, both included."""
    return df.filter(F.col("Div").isin(list(leagues)) & F.col("season").between(first, last))


def involving(df: DataFrame, team: str) -> DataFrame:
    """Rows where the team plays on either side."""
    return df.filter((F.col("HomeTeam") == team) | (F.col("AwayTeam") == team))


def filter_competition(df: DataFrame, name: str, column: str = "Comp") -> DataFrame:
    """Rows whose competition contains the first word of ``name``; all rows when none does."""
    word = name.replace("-", " ").split()[0].lower()
    hit = F.coalesce(F.lower(F.col(column)).contains(word), F.lit(False))
    any_hit = df.agg(F.coalesce(F.max(hit), F.lit(False)).alias("any_hit")).scalar()
    return df.filter(hit | ~any_hit)


def played_only(df: DataFrame, result: str = "Result") -> DataFrame:
    """Rows that have a result."""
    return df.filter(F.col(result).isNotNull() & (F.col(result) != ""))


def clean_log(df: DataFrame) -> DataFrame:
    """Dates parsed leniently, rows sorted by season and date with unknown dates last."""
    return df.withColumn("Date", S.lenient_date(F.col("Date"))).orderBy(
        F.col("Season").asc_nulls_last(), F.col("Date").asc_nulls_last()
    )
