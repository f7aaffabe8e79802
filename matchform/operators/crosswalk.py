"""Team-name crosswalk: seed, curated rows, conflicts and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchform.functions.fixed_values import CURATED_TEAM_CODES


def seed_crosswalk(xg: DataFrame) -> DataFrame:
    """Names and codes seen in the xG feed, with how often each pair was at home."""
    return xg.groupBy(
        F.col("home_team").alias("team_name"), F.col("home_team_code").alias("team_code")
    ).agg(F.count("*").alias("count"))


def crosswalk_conflicts(xg: DataFrame) -> DataFrame:
    """Names the feed gives more than one code; a usable crosswalk has none."""
    pairs = xg.groupBy("home_team", "home_team_code").agg(F.count("*").alias("rows"))
    return pairs.groupBy("home_team").agg(F.count("*").alias("codes")).filter("codes > 1")


def curated_crosswalk(spark: SparkSession) -> DataFrame:
    """The fixed list of hand-kept names, in its own order."""
    rows = [(index, name, code) for index, (name, code) in enumerate(CURATED_TEAM_CODES)]
    return spark.createDataFrame(rows, "position bigint, team_name string, team_code string")


def merge_crosswalk(seed: DataFrame, curated: DataFrame) -> DataFrame:
    """Seed rows, plus the first curated row of every name the seed does not have.

    The name is the key: a seed name with two codes stops the job.
    """
    checked = (
        seed.groupBy("team_name")
        .agg(
            F.first("team_code").alias("team_code"),
            F.first("count").alias("count"),
            F.count("*").alias("codes"),
        )
        .filter(F.assert_true(F.col("codes") == 1, "a team name has more than one code").isNull())
        .drop("codes")
    )
    added = (
        curated.groupBy("team_name")
        .agg(F.min_by("team_code", "position").alias("team_code"))
        .join(checked, "team_name", "left_anti")
        .withColumn("count", F.lit(None).cast("bigint"))
    )
    return checked.unionByName(added)


def attach_codes(matches: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Code of both teams; teams without one stay, with NULL.

    No hint is given: adaptive execution broadcasts a lookup whose bytes are few and splits the
    partitions of hot teams where it shuffles.
    """
    for side, team in (("home", "HomeTeam"), ("away", "AwayTeam")):
        lookup = crosswalk.select(
            F.col("team_name").alias(team), F.col("team_code").alias(f"{side}_team_code")
        )
        matches = matches.join(lookup, team, "left")
    return matches
