"""Feature table in Parquet, partitioned by season, and a CSV reader for saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from matchform.functions.feature_sets import CATEGORICAL_FEATURES
from matchform.operators.summaries import category_index

TEXT_COLUMNS = ("HomeTeam", "AwayTeam", "Div", "season", "FTR", "Referee")


def write_features(df: DataFrame, path: str) -> int:
    """Replace the table at ``path``; the row count comes from the same job.

    Rows are rebalanced by season first: adaptive execution cuts a season into files of even size,
    where every task would otherwise leave a small file in every season's folder.
    """
    seen = Observation("written")
    rows = df.hint("rebalance", F.col("season")).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").partitionBy("season").parquet(path)
    return seen.get["rows"]


def load_features(spark: SparkSession, path: str, with_categories: bool = False) -> DataFrame:
    """The feature table; optionally with its text columns numbered in sorted order."""
    df = spark.read.parquet(path)
    # Season folders would be read as numbers where their labels allow it.
    df = df.withColumn("season", F.col("season").cast("string"))
    if not with_categories:
        return df
    for column in (c for c in CATEGORICAL_FEATURES if c in df.columns):
        numbers = category_index(df, column).withColumnsRenamed({"category_index": f"index_{column}"})
        df = df.join(numbers, column, "left")
    return df


def load_features_csv(spark: SparkSession, path: str) -> DataFrame:
    """A feature table saved as CSV: numbers, one timestamp and the text columns."""
    raw = spark.read.csv(path, header=True)
    columns = []
    for name in raw.columns:
        value = F.col(f"`{name}`")
        if name == "match_id":
            value = value.try_cast("bigint")
        elif name == "kickoff":
            value = value.try_cast("timestamp_ntz")
        elif name not in TEXT_COLUMNS:
            value = value.try_cast("double")
        columns.append(value.alias(name))
    return raw.select(*columns)
