"""Saved results: validation summary, holdout predictions and run information, one folder for each run.

A run's three artefacts are written to a folder of their own; only when all are there does the manifest name it.
Readers follow the manifest, so a save that fails leaves the set before it in place.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from matchform.operators.assemble import join_one_to_one
from matchform.operators.selection import SUMMARY_SCHEMA, Evaluation
from matchform.sources.files import exists, read_text, replace_text

SUMMARY = "grouping_cv"
PREDICTIONS = "holdout_predictions"
RUN_INFO = "run_info"
MANIFEST = "current_run"

MATCH_COLUMNS = (
    "match_id", "kickoff", "season", "Div", "HomeTeam", "AwayTeam", "FTR",
    "market_home_prob_fair", "market_draw_prob_fair", "market_away_prob_fair",
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("created_utc", T.StringType()),
        T.StructField("best_grouping", T.StringType()),
        T.StructField("selected_features", T.ArrayType(T.StringType())),
        T.StructField("best_params", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("split_fraction", T.DoubleType()),
        T.StructField("train_matches", T.LongType()),
        T.StructField("test_matches", T.LongType()),
        T.StructField("holdout_log_loss", T.DoubleType()),
        T.StructField("holdout_brier_score", T.DoubleType()),
    ]
)


def save_results(summary: DataFrame, holdout: Evaluation, features: DataFrame, folder: str) -> str:
    """Write the three artefacts of a run and switch the manifest to it; predictions carry their match's columns."""
    spark, name = summary.sparkSession, f"run-{uuid.uuid4()}"
    own = f"{folder}/{name}"
    summary.coalesce(1).write.json(f"{own}/{SUMMARY}")
    predictions = join_one_to_one(holdout.predictions, features.select(*MATCH_COLUMNS), "match_id")
    predictions.write.parquet(f"{own}/{PREDICTIONS}")
    best = summary.orderBy("best_mean_log_loss").first()
    metrics = holdout.metrics
    run = (
        datetime.now(timezone.utc).isoformat(timespec="seconds"),
        best["grouping"],
        best["selected_features"],
        best["best_params"],
        metrics["split_fraction"],
        metrics["train_matches"],
        metrics["test_matches"],
        metrics["holdout_log_loss"],
        metrics["holdout_brier_score"],
    )
    spark.createDataFrame([run], RUN_SCHEMA).coalesce(1).write.json(f"{own}/{RUN_INFO}")
    replace_text(spark, f"{folder}/{MANIFEST}", name)
    return folder


def load_results(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The three artefacts of the run the manifest names, or None while there is none or one of them is missing."""
    if not exists(spark, f"{folder}/{MANIFEST}"):
        return None
    folder = f"{folder}/{read_text(spark, f'{folder}/{MANIFEST}')}"
    if not all(exists(spark, f"{folder}/{name}") for name in (SUMMARY, PREDICTIONS, RUN_INFO)):
        return None
    predictions = spark.read.parquet(f"{folder}/{PREDICTIONS}")
    return {
        SUMMARY: spark.read.schema(SUMMARY_SCHEMA).json(f"{folder}/{SUMMARY}"),
        "predictions": predictions.withColumn("kickoff", F.col("kickoff").cast("timestamp_ntz")),
        RUN_INFO: spark.read.schema(RUN_SCHEMA).json(f"{folder}/{RUN_INFO}"),
    }
