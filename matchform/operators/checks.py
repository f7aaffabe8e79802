"""Data expectations, as queries that count violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from matchform.operators.history import EVENT_ORDER, FORM_KEYS
from matchform.operators.ordering import in_blocks, number_rows

TOLERANCE = 1e-9


def check_chronology(df: DataFrame, key: str = "match_id", moment: str = "kickoff") -> DataFrame:
    """One row: repeated keys, and neighbours by ``key`` whose moments run backwards.

    Neighbours are compared in blocks of the rows sorted by ``key``, whose last row is repeated ahead of
    the next block, so no task sees all rows.
    """
    repeats = df.groupBy(key).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_keys")
    )
    rows = df.select(key, moment)
    seen = in_blocks(rows, (), (key,), 1, lambda w: {"__before": F.lag(moment).over(w)})
    backwards = F.count(F.when(F.col(moment) < F.col("__before"), 1))
    return seen.agg(backwards.alias("backward_steps")).withColumn("repeated_keys", repeats.scalar())


def check_prob_sum(df: DataFrame, probs: Sequence[str]) -> DataFrame:
    """One row: how many rows have probabilities that do not sum to one."""
    total = sum((F.col(name) for name in probs[1:]), F.col(probs[0]))
    return df.filter(F.abs(total - 1.0) > TOLERANCE).agg(F.count("*").alias("violations"))


def check_no_leakage(
    form: DataFrame, features: Sequence[str], keys: Sequence[str] = FORM_KEYS
) -> DataFrame:
    """One row: first events of an entity that nevertheless have a feature."""
    numbered = number_rows(form, keys, EVENT_ORDER, "__event")
    known = F.lit(False)
    for feature in features:
        known = known | F.col(feature).isNotNull()
    return numbered.filter((F.col("__event") == 1) & known).agg(F.count("*").alias("violations"))


def manual_mean(
    history: DataFrame, keys: Sequence[str], order: Sequence[str], measure: str, size: int, name: str
) -> DataFrame:
    """The rolling mean of ``measure`` without a frame: every row is handed to the next ``size``.

    Each row becomes ``size`` rows keyed by the event they count for, so the work grows with the
    rows and not with pairs of them.
    """
    numbered = number_rows(history, keys, order, "__event")
    given = numbered.select(
        *keys,
        F.explode(F.sequence(F.col("__event") + 1, F.col("__event") + size)).alias("__event"),
        F.col(measure).alias("__value"),
    )
    means = given.groupBy(*keys, "__event").agg(F.avg("__value").alias(name))
    return numbered.join(means, [*keys, "__event"], "left").drop("__event")
