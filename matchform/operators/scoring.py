"""Scores, calibration and baselines for probabilistic predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from matchform.functions import scalars as S
from matchform.operators.filters import complete_rows, require_columns
from matchform.operators.ordering import running_sums, temporal_slice

MODEL_PROBS = ("model_prob_H", "model_prob_D", "model_prob_A")
MARKET_PROBS = ("market_home_prob_fair", "market_draw_prob_fair", "market_away_prob_fair")
SOURCES = {"model": MODEL_PROBS, "market": MARKET_PROBS}

# The mean loss clips at the smallest double step above one, the row loss of reports at 1e-15.
MEAN_EPS = 2.0**-52
ROW_EPS = 1e-15


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(name) for name in names]


def add_scores(predictions: DataFrame) -> DataFrame:
    """Loss, Brier score and pick of model and market, on rows where both are complete."""
    scored = complete_rows(predictions, [*MODEL_PROBS, *MARKET_PROBS, "FTR"])
    result = F.col("FTR")
    return scored.withColumns(
        {
            **{f"{s}_log_loss": S.row_log_loss(*_columns(p), result, ROW_EPS) for s, p in SOURCES.items()},
            **{f"{s}_brier": S.row_brier(*_columns(p), result) for s, p in SOURCES.items()},
            **{f"{s}_pick": S.pick(*_columns(p)) for s, p in SOURCES.items()},
        }
    )


def mean_log_loss(df: DataFrame, probs: Sequence[str], result: str = "FTR", eps: float = MEAN_EPS) -> DataFrame:
    """One row: mean log loss. A class that never happened needs no special case."""
    return df.agg(F.avg(S.row_log_loss(*_columns(probs), F.col(result), eps)).alias("log_loss"))


def mean_brier(df: DataFrame, probs: Sequence[str], result: str = "FTR") -> DataFrame:
    """One row: mean three-class Brier score."""
    return df.agg(F.avg(S.row_brier(*_columns(probs), F.col(result))).alias("brier_score"))


def share(condition: Column) -> Column:
    """Share of rows where ``condition`` holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def accuracy(df: DataFrame, probs: Sequence[str], result: str = "FTR") -> DataFrame:
    """One row: share of matches whose most probable outcome happened."""
    return df.agg(share(S.pick(*_columns(probs)) == F.col(result)).alias("accuracy"))


def score_summary(scored: DataFrame) -> DataFrame:
    """One row: mean losses, Brier scores and accuracies, and model minus market."""
    metrics = ("log_loss", "brier", "accuracy")
    means = scored.agg(
        F.count("*").alias("matches"),
        *[F.avg(f"{s}_{m}").alias(f"{s}_{m}") for s in SOURCES for m in metrics[:2]],
        *[share(F.col(f"{s}_pick") == F.col("FTR")).alias(f"{s}_accuracy") for s in SOURCES],
    )
    return means.withColumns(
        {f"{m}_delta": F.col(f"model_{m}") - F.col(f"market_{m}") for m in metrics}
    )


def losses_by(scored: DataFrame, key: str = "Div") -> DataFrame:
    """Mean losses per key, with the smaller and the larger of the two."""
    model, market = F.col("model_log_loss"), F.col("market_log_loss")
    return (
        scored.groupBy(key)
        .agg(F.avg(model).alias("model_log_loss"), F.avg(market).alias("market_log_loss"))
        .withColumns({"lowest": F.least(model, market), "highest": F.greatest(model, market)})
    )


def calibration(scored: DataFrame, bins: int = 10, min_rows: int = 10) -> DataFrame:
    """Mean predicted and observed rate per probability bin, source and outcome.

    Bins are closed on the right, and zero belongs to the first. Edges are multiples of one bin's
    width, so a probability on an edge falls where the same doubles put it.
    """
    cases = [
        F.struct(
            F.lit(source).alias("source"),
            F.lit(outcome).alias("outcome"),
            F.col(column).alias("p"),
            F.when(F.col("FTR") == outcome, 1.0).otherwise(0.0).alias("y"),
        )
        for source, columns in SOURCES.items()
        for column, outcome in zip(columns, S.OUTCOMES)
    ]
    bin_number = F.lit(1)
    for index in range(1, bins):
        above = F.col("p") > F.lit(index * (1.0 / bins))
        bin_number = bin_number + F.when(above, 1).otherwise(0)
    return (
        scored.select(F.explode(F.array(*cases)).alias("case"))
        .select("case.*")
        .filter(F.col("p").between(0.0, 1.0))
        .groupBy("source", "outcome", bin_number.alias("bin"))
        .agg(
            F.avg("p").alias("predicted"), F.avg("y").alias("observed"), F.count("*").alias("matches")
        )
        .filter(F.col("matches") >= min_rows)
    )


def class_priors(train: DataFrame, result: str = "FTR") -> DataFrame:
    """One row: frequencies of H, D and A, zero for a class that never happened."""
    known = train.filter(F.col(result).isNotNull())
    return known.agg(*[share(F.col(result) == o).alias(f"prior_{o}") for o in S.OUTCOMES])


def with_priors(df: DataFrame, train: DataFrame, result: str = "FTR") -> DataFrame:
    """Every row with the class frequencies of ``train`` as its three probabilities."""
    names = [f"prior_{o}" for o in S.OUTCOMES]
    priors = class_priors(train, result).select(F.struct(*names).alias("priors")).scalar()
    return df.withColumn("__priors", priors).select("*", "__priors.*").drop("__priors")


def prior_baseline(train: DataFrame, valid: DataFrame, result: str = "FTR") -> DataFrame:
    """One row: losses of always predicting the training frequencies."""
    known = valid.filter(F.col(result).isNotNull()).transform(lambda df: with_priors(df, train, result))
    probs = _columns([f"prior_{o}" for o in S.OUTCOMES])
    return known.agg(
        F.count("*").alias("matches"),
        F.avg(S.row_log_loss(*probs, F.col(result), MEAN_EPS)).alias("log_loss"),
        F.avg(S.row_brier(*probs, F.col(result))).alias("brier_score"),
    )


def majority_accuracy(train: DataFrame, valid: DataFrame, result: str = "FTR") -> DataFrame:
    """One row: the most common training outcome and how often it happened in ``valid``.

    Outcomes that are equally common go in H, D, A order.
    """
    counts = class_priors(train, result)
    names = [F.col(f"prior_{o}") for o in S.OUTCOMES]
    common = counts.select(S.pick(*names).alias("majority")).scalar()
    known = valid.filter(F.col(result).isNotNull()).withColumn("majority", common)
    return known.agg(
        F.first("majority").alias("majority"),
        share(F.col(result) == F.col("majority")).alias("accuracy"),
    )


def market_baseline(
    df: DataFrame,
    start: float = 0.8,
    end: float = 1.0,
    result: str = "FTR",
    order: str = "match_id",
    probs: Sequence[str] = MARKET_PROBS,
) -> DataFrame:
    """One row: the market's losses on a chronological slice, rounded to four places."""
    kept = complete_rows(df, [order, result, *probs]).select(order, result, *probs)
    chosen = temporal_slice(kept, start, end, (order,))
    columns = _columns(probs)
    return chosen.agg(
        F.count("*").alias("match_count"),
        F.round(F.avg(S.row_log_loss(*columns, F.col(result), MEAN_EPS)), 4).alias("market_log_loss"),
        F.round(F.avg(S.row_brier(*columns, F.col(result))), 4).alias("market_brier_score"),
    ).select(
        "match_count",
        F.lit(f"{int(start * 100)}%").alias("start_percentile"),
        F.lit(f"{int(end * 100)}%").alias("end_percentile"),
        "market_log_loss",
        "market_brier_score",
    )


def gap_closed(naive: Column, model: Column, market: Column) -> Column:
    """Share of the distance from naive to market that the model covers."""
    return F.try_divide(naive - model, naive - market)


def cumulative_advantage(scored: DataFrame, **limits) -> DataFrame:
    """Running total of market loss minus model loss, by kickoff and match."""
    rows = scored.select("match_id", "kickoff", "market_log_loss", "model_log_loss")
    gain = F.col("market_log_loss") - F.col("model_log_loss")
    return running_sums(rows, (), ("kickoff", "match_id"), {"cumulative_advantage": gain}, **limits)


def match_log(scored: DataFrame) -> DataFrame:
    """Scored matches, latest first, with their title."""
    require_columns(scored, ["kickoff", "match_id", "HomeTeam", "AwayTeam"])
    title = F.concat("HomeTeam", F.lit(" vs "), "AwayTeam")
    return scored.withColumn("Match", title).orderBy(
        F.col("kickoff").desc_nulls_last(), F.col("match_id")
    )
