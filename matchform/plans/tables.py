"""Binding of the test tables to the two-sided event model.

Every order is a fixture between two teams of one league; its line items give the measures.
Teams come from customers, so their number grows with the data and their histories do not.
The remainders below only spread values and edge cases (bad dates, missing times, unmapped
names, shared codes) over all rows; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchform.functions import scalars as S
from matchform.operators.enrich import with_market_probs
from matchform.session import tune


class Tables:
    """Lazy access to the Parquet tables of one folder, and the frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw(self) -> DataFrame:
        """Orders as raw match rows: text date and time, names, goals, result and prices."""
        return self.orders.transform(_as_matches)

    def raw_with_measures(self) -> DataFrame:
        """Raw match rows with the per-side counts of shots, fouls, corners and cards.

        The orders are joined as they are, so their few columns move, not what is derived from them.
        """
        measures = self._measures().withColumnRenamed("match_id", "o_orderkey")
        names = [name for name in measures.columns if name != "o_orderkey"]
        return self.orders.join(measures, "o_orderkey", "left").transform(_as_matches, *names)

    def matches(self) -> DataFrame:
        """Raw rows with their kickoff and market probabilities."""
        return self.raw().transform(_typed)

    def matches_with_measures(self) -> DataFrame:
        return self.raw_with_measures().transform(_typed)

    def xg(self) -> DataFrame:
        """xG feed: one row per order with line items on both sides, under the feed's names."""
        sides = self.lineitem.groupBy(F.col("l_orderkey").alias("match_id")).agg(
            F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("home"),
            F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("away"),
        )
        home, away = F.col("home_no"), F.col("away_no")
        return (
            self.orders.join(sides.dropna().withColumnRenamed("match_id", "o_orderkey"), "o_orderkey")
            .transform(_with_teams)
            .select(
                "match_id",
                F.when(F.col("match_id") % 223 == 0, F.lit("unknown"))
                .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
                .alias("date"),
                F.concat(F.lit("Club "), home).alias("home_team"),
                F.concat(F.lit("Club "), away).alias("away_team"),
                team_code(home).alias("home_team_code"),
                team_code(away).alias("away_team_code"),
                (F.col("home") / 10.0).alias("home_xg"),
                (F.col("away") / 10.0).alias("away_xg"),
                "league",
            )
        )

    def curated_codes(self) -> DataFrame:
        """Curated names from customers: variants, repeats and names the feed has too."""
        team = F.expr("c_custkey div 10")
        own = F.when(F.col("c_custkey") % 10 == 5, F.lit("Club ")).otherwise(F.lit("FC "))
        code = F.when(F.col("c_custkey") % 10 == 0, team_code(team)).otherwise(
            F.concat(F.lit("X"), F.col("c_custkey"))
        )
        return self.customer.select(
            F.col("c_custkey").alias("position"),
            F.concat(own, team).alias("team_name"),
            code.alias("team_code"),
        )

    def predictions(self) -> DataFrame:
        """Matches with a second set of probabilities standing in for a model's."""
        key = F.col("match_id")
        implied = {
            "__h": S.implied_prob(F.col("AvgH") + (key % 7) / F.lit(10.0)),
            "__d": S.implied_prob(F.col("AvgD") + (key % 5) / F.lit(10.0)),
            "__a": S.implied_prob(F.col("AvgA") + (key % 9) / F.lit(10.0)),
        }
        home, draw, away = S.fair_probs(*map(F.col, implied))
        known = key % 401 != 0
        return self.matches().withColumns(implied).select(
            "match_id",
            F.when(known, home).alias("model_prob_H"),
            F.when(known, draw).alias("model_prob_D"),
            F.when(known, away).alias("model_prob_A"),
            "kickoff", "season", "Div", "HomeTeam", "AwayTeam", "FTR",
            "market_home_prob_fair", "market_draw_prob_fair", "market_away_prob_fair",
        )

    def _measures(self) -> DataFrame:
        columns = []
        for status, side in (("O", "H"), ("F", "A")):
            mine = F.col("l_linestatus") == status
            values = {
                "S": F.sum(F.when(mine, F.col("l_quantity").cast("bigint"))),
                "ST": F.sum(F.when(mine, 1)),
                "F": F.sum(F.when(mine, F.col("l_linenumber").cast("bigint"))),
                "C": F.max(F.when(mine, F.col("l_linenumber").cast("bigint"))),
                "Y": F.sum(F.when(mine, F.when(F.col("l_returnflag") == "R", 1).otherwise(0))),
                "R": F.sum(F.when(mine, F.when(F.col("l_returnflag") == "A", 1).otherwise(0))),
            }
            columns += [value.alias(f"{side}{name}") for name, value in values.items()]
        return self.lineitem.groupBy(F.col("l_orderkey").alias("match_id")).agg(*columns)


def team_name(number):
    """Spelling used by the match files."""
    prefix = (
        F.when(number % 20 == 19, F.lit("AC ")).when(number % 4 == 0, F.lit("Club ")).otherwise(F.lit("FC "))
    )
    return F.concat(prefix, number)


def team_code(number):
    """Short code; some teams share theirs with another, as real codes do."""
    return F.concat(F.lit("C"), F.when(number % 40 == 39, number - 5).otherwise(number))


def _with_teams(orders: DataFrame) -> DataFrame:
    home = F.expr("o_custkey div 10")
    return orders.withColumns(
        {
            "match_id": F.col("o_orderkey"),
            "home_no": home,
            "away_no": home + 5 * (1 + F.col("o_orderkey") % 7),
            "league": F.concat(F.lit("L"), home % 5),
        }
    )


def _as_matches(orders: DataFrame, *others: str) -> DataFrame:
    key = F.col("o_orderkey")
    goals_home = F.floor("o_totalprice") % 5
    goals_away = F.floor(F.col("o_totalprice") / 7) % 4
    result = (
        F.when(key % 307 == 0, F.lit(None))
        .when(goals_home > goals_away, F.lit("H"))
        .when(goals_home == goals_away, F.lit("D"))
        .otherwise(F.lit("A"))
    )
    quarter = F.lpad((key % 4 * 15).cast("string"), 2, "0")
    prices = {
        "H": F.lit(1.2) + (key % 37) / F.lit(10.0),
        "D": F.lit(3.0) + (key % 11) / F.lit(10.0),
        "A": F.lit(1.5) + (key % 53) / F.lit(10.0),
    }
    return orders.transform(_with_teams).select(
        "match_id",
        "league",
        F.col("league").alias("Div"),
        S.season_label(F.year("o_orderdate")).alias("season"),
        F.when(key % 211 == 0, F.lit("postponed"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
        .alias("Date"),
        F.when(key % 17 != 0, F.concat((12 + key % 8).cast("string"), F.lit(":"), quarter)).alias(
            "Time"
        ),
        team_name(F.col("home_no")).alias("HomeTeam"),
        team_name(F.col("away_no")).alias("AwayTeam"),
        goals_home.cast("bigint").alias("FTHG"),
        goals_away.cast("bigint").alias("FTAG"),
        result.alias("FTR"),
        F.when(F.col("league") == "L0", F.col("o_orderpriority")).alias("Referee"),
        *[price.alias(f"Avg{side}") for side, price in prices.items()],
        *[(price * F.lit(1.05)).alias(f"Max{side}") for side, price in prices.items()],
        *others,
    )


def _typed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("kickoff", S.parse_kickoff(F.col("Date"), F.col("Time"))).transform(
        with_market_probs
    )
