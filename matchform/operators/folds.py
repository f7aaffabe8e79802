"""Season folds, their sizes, and correlations between candidate features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from matchform.functions import scalars as S
from matchform.operators.filters import complete_rows

Fold = tuple[list[str], str]


def seasons_with_year(df: DataFrame, season: str = "season") -> DataFrame:
    """Distinct seasons with their start year; one row per season."""
    return df.select(season).filter(F.col(season).isNotNull()).distinct().withColumn(
        "start_year", S.season_year(F.col(season))
    )


def ordered_seasons(df: DataFrame, season: str = "season") -> list[str]:
    """Season labels in chronological order (a handful of values)."""
    rows = seasons_with_year(df, season).orderBy("start_year", season).collect()
    return [row[season] for row in rows]


def outer_folds(seasons: Sequence[str]) -> list[Fold]:
    """Expanding folds over all but the last season; the first trains on two seasons."""
    if len(seasons) < 4:
        raise ValueError(f"outer folds need four seasons or more (two to train on, one to validate, one kept back); got {len(seasons)}")
    known = list(seasons[:-1])
    return [(known[:index], known[index]) for index in range(2, len(known))]


def inner_folds(seasons: Sequence[str]) -> list[Fold]:
    """Expanding folds inside a training set; the first trains on one season."""
    return [(list(seasons[:index]), seasons[index]) for index in range(1, len(seasons))]


def fold_relation(df: DataFrame, first: int, held_out: int, season: str = "season") -> DataFrame:
    """Folds as rows ``(fold, season, role)``, built from the table's own seasons.

    Fold ``k`` validates on the ``first + k``-th season and trains on all before it; the last
    ``held_out`` seasons stay out.
    """
    seasons = seasons_with_year(df, season).agg(
        F.sort_array(F.collect_list(F.struct("start_year", F.col(season).alias("season")))).alias("all")
    )
    last = F.size("all") - held_out
    valid = F.sequence(F.lit(first), last - 1)
    has_fold = last > first
    return (
        seasons.filter(has_fold)
        .select("all", F.explode(valid).alias("valid"))
        .select("valid", F.posexplode("all").alias("index", "entry"))
        .filter(F.col("index") <= F.col("valid"))
        .select(
            (F.col("valid") - first + 1).alias("fold"),
            F.col("entry.season").alias("season"),
            F.when(F.col("index") == F.col("valid"), "validation").otherwise("train").alias("role"),
        )
    )


def fold_sizes(df: DataFrame, required: Sequence[str], first: int = 2, held_out: int = 1) -> DataFrame:
    """Training and validation rows per fold, from one count per season."""
    complete = complete_rows(df, ["season", *required])
    counts = complete.groupBy("season").agg(F.count("*").alias("rows"))
    return (
        fold_relation(complete, first, held_out)
        .join(counts, "season")
        .groupBy("fold")
        .agg(
            F.sum(F.when(F.col("role") == "train", F.col("rows"))).alias("train_rows"),
            F.sum(F.when(F.col("role") == "validation", F.col("rows"))).alias("validation_rows"),
        )
    )


def season_holdout(df: DataFrame, season: str = "season") -> tuple[DataFrame, DataFrame]:
    """All rows before the last season, and the last season's rows."""
    year = S.season_year(F.col(season))
    last = df.agg(F.max(year).alias("last_year")).scalar()
    return df.filter(year < last), df.filter(year == last)


# What is kept of a pair (x, y) over rows where both are known: size, means, co-moment, squared distances, extremes.
MOMENTS = ("n", "mean_x", "mean_y", "shared", "of_x", "of_y", "low_x", "high_x", "low_y", "high_y")


def pair_moments(values: np.ndarray) -> np.ndarray:
    """``MOMENTS`` of every pair of columns, by pair; NaN is unknown. Distances are taken from the pair's own means."""
    known = ~np.isnan(values)
    filled = np.where(known, values, 0.0)
    found = []
    for i in range(values.shape[1] - 1):
        both = known[:, i + 1 :] & known[:, i, None]
        x, y = filled[:, i, None], filled[:, i + 1 :]
        n = both.sum(axis=0)
        mean_x, mean_y = (np.where(both, v, 0.0).sum(axis=0) / np.maximum(n, 1) for v in (x, y))
        dx, dy = np.where(both, x - mean_x, 0.0), np.where(both, y - mean_y, 0.0)
        ends = [side(np.where(both, v, worst), axis=0, initial=worst) for v in (x, y) for side, worst in ((np.min, np.inf), (np.max, -np.inf))]
        found.append(np.stack((n, mean_x, mean_y, (dx * dy).sum(axis=0), (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), *ends)))
    return np.concatenate(found, axis=1)


def merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together."""
    n = a[0] + b[0]
    weight = a[0] * b[0] / np.maximum(n, 1)
    dx, dy = b[1] - a[1], b[2] - a[2]
    part = b[0] / np.maximum(n, 1)
    means = (a[1] + dx * part, a[2] + dy * part)
    spread = (a[3] + b[3] + dx * dy * weight, a[4] + b[4] + dx * dx * weight, a[5] + b[5] + dy * dy * weight)
    ends = (np.minimum(a[6], b[6]), np.maximum(a[7], b[7]), np.minimum(a[8], b[8]), np.maximum(a[9], b[9]))
    return np.stack((n, *means, *spread, *ends))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute Pearson correlation of every pair, over the rows where both are known.

    Each partition adds up the moments of all pairs in blocks and sends one row for each pair; these are merged in the
    order of the partitions. A pair with a constant member (its least value is its greatest), or without rows, has no
    correlation (NULL). NaN counts as unknown.
    """
    columns = list(columns)
    pairs = list(combinations(columns, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            own = pair_moments(values)
            held = own if held is None else merged_moments(held, own)
        if held is not None:
            part = pa.array(np.full(len(pairs), TaskContext.get().partitionId()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), part, *map(pa.array, held)], ["pair", "part", *MOMENTS])

    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, correlation double")
    values = df.select(*[F.col(name).cast("double").alias(f"v{k}") for k, name in enumerate(columns)])
    sent = values.mapInArrow(run, ", ".join(["pair long", "part long", *(f"{m} double" for m in MOMENTS)]))
    lists = sent.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("part", *MOMENTS))).alias("parts"))

    @F.pandas_udf("double")
    def correlation(parts: pd.Series) -> pd.Series:
        out = []
        for rows in parts:
            total = reduce(merged_moments, (np.array([[r[m]] for m in MOMENTS]) for r in rows))[:, 0]
            n, _, _, shared, of_x, of_y, low_x, high_x, low_y, high_y = total
            # Roots are taken one by one: a product of two variances may leave the range of doubles.
            known = n > 0 and low_x != high_x and low_y != high_y and of_x > 0 and of_y > 0
            out.append(abs(shared / (np.sqrt(of_x) * np.sqrt(of_y))) if known else None)
        return pd.Series(out, dtype="float64")

    named = df.sparkSession.createDataFrame([(k, *pair) for k, pair in enumerate(pairs)], "pair long, left string, right string")
    found = lists.select("pair", correlation("parts").alias("correlation"))
    return named.join(found, "pair", "left").select("left", "right", "correlation")


def drop_correlated(
    df: DataFrame, candidates: Sequence[str], numeric: Sequence[str], threshold: float | None = 0.90
) -> list[str]:
    """Walk the candidates in order and drop each that correlates above ``threshold`` with a kept one.

    Only the small pair table comes to the driver. Categorical candidates and undefined
    correlations are kept.
    """
    measured = [name for name in candidates if name in set(numeric)]
    if threshold is None or len(candidates) < 2 or len(measured) < 2:
        return list(candidates)
    strong = {
        frozenset((row["left"], row["right"]))
        for row in correlation_pairs(df, measured).collect()
        if row["correlation"] is not None and row["correlation"] > threshold
    }
    kept: list[str] = []
    for name in candidates:
        if not any(frozenset((name, other)) in strong for other in kept):
            kept.append(name)
    return kept
