from datetime import datetime

import pytest
from pyspark.sql import functions as F

from matchform.functions import scalars as S
from matchform.functions.feature_sets import FEATURE_GROUPS, default_features
from matchform.operators import filters, folds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "date, time, expected",
    [
        ("01/08/2025", "15:00", datetime(2025, 8, 1, 15)),
        ("1/8/2025", "5:03", datetime(2025, 8, 1, 5, 3)),
        ("01/08/2025", None, datetime(2025, 8, 1)),
        ("31/02/2025", "15:00", None),
        ("01/13/2025", "15:00", None),
        ("01/08/2025", "24:00", None),
        ("1/8/25", "15:00", datetime(25, 8, 1, 15)),
        ("2025-08-01", "15:00", None),
        (None, "15:00", None),
    ],
)
def test_kickoff(spark, date, time, expected):
    assert one(spark, S.parse_kickoff(F.lit(date).cast("string"), F.lit(time).cast("string"))) == expected


def test_kickoff_ignores_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # 02:30 does not exist there on this day.
        column = S.parse_kickoff(F.lit("09/03/2025"), F.lit("02:30"))
        assert one(spark, column) == datetime(2025, 3, 9, 2, 30)
        earlier = S.parse_kickoff(F.lit("08/03/2025"), F.lit("02:30"))
        assert one(spark, S.rest_days(column, earlier)) == 1.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rest_days_keep_the_fraction(spark):
    late = F.lit("2024-01-02 12:00:00.000001").cast("timestamp_ntz")
    early = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert one(spark, S.rest_days(late, early)) == pytest.approx(1.5 + 1e-6 / 86400, abs=1e-15)


def test_keys_skip_or_spread_nulls(spark):
    ts, none = F.lit("2025-08-01 15:00:00").cast("timestamp_ntz"), F.lit(None).cast("string")
    assert one(spark, S.match_key(ts, none, none)) == "2025-08-01__"
    assert one(spark, S.match_key(ts, F.lit("A"), F.lit("B"))) == "2025-08-01_A_B"
    assert one(spark, S.xg_key(F.lit("2025-08-01"), none, F.lit("B"))) is None
    assert one(spark, S.xg_key(F.lit("01/08/2025"), F.lit("A"), F.lit("B"))) is None


def test_price_of_zero(spark):
    assert one(spark, S.implied_prob(F.lit(0.0))) == float("inf")
    assert one(spark, S.implied_prob(F.lit(4.0))) == 0.25
    assert one(spark, S.implied_prob(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("label, year", [("2020/21", 2020), ("2021", 2021), ("1920", 1920)])
def test_season_year(spark, label, year):
    assert one(spark, S.season_year(F.lit(label))) == year


def test_season_without_a_year(spark):
    with pytest.raises(Exception, match="no start year"):
        one(spark, S.season_year(F.lit("spring")))


def test_seasons_in_order(spark):
    df = spark.createDataFrame([("2122",), ("1920",), ("2627",), (None,)], "season string")
    assert folds.ordered_seasons(df) == ["1920", "2122", "2627"]


def test_unknown_result_has_no_points(spark):
    assert one(spark, S.points(F.lit("X"), "home")) is None
    assert [one(spark, S.points(F.lit(r), "away")) for r in "HDA"] == [0, 1, 3]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, y string")
    assert [r["y"] for r in filters.complete_rows(df, ["x", "y"]).collect()] == ["a"]


def test_missing_columns_are_named(spark):
    with pytest.raises(KeyError, match="no 'b', 'c'"):
        filters.require_columns(spark.range(1), ["id", "c", "b"])


def test_competition_filter_falls_back(spark):
    df = spark.createDataFrame([("Premier League",), ("FA Cup",), (None,)], "Comp string")
    assert filters.filter_competition(df, "premier-league").count() == 1
    assert filters.filter_competition(df, "Bundesliga").count() == 3


def test_feature_groups_hold_no_market_columns():
    assert len(FEATURE_GROUPS) == 5
    assert not any(f.startswith("market_") for f in default_features())
    assert len(default_features()) == len(set(default_features())) and "HomeTeam" in default_features()
