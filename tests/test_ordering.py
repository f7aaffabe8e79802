"""Blocks must give what plain windows give, whatever their size and however skewed the groups."""

import random

import pytest
from pyspark.sql import Window, functions as F

from matchform.operators import history, ordering
from tests.frames import side_history

SCHEMA = (
    "season string, league string, match_id bigint, team string, venue string, kickoff timestamp_ntz, "
    "points bigint, goals_for bigint, goals_against bigint"
)


@pytest.fixture(scope="module")
def sides(spark):
    rows = side_history()
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def collected(df, *columns):
    return sorted(df.select(*columns).collect(), key=repr)


def test_positions_are_the_sorted_order(sides):
    placed = ordering.place(sides, ordering.ascending("kickoff", "match_id"))
    rows = placed.rows.orderBy(placed.column).collect()
    assert [r[placed.column] for r in rows] == list(range(1, placed.total + 1))
    keys = [(r["kickoff"] is None, r["kickoff"], r["match_id"]) for r in rows]
    known = [k for k in keys if not k[0]]
    assert known == sorted(known) and [k[0] for k in keys] == sorted(k[0] for k in keys)


def test_place_of_no_rows(spark):
    placed = ordering.place(spark.createDataFrame([], "a int"), ordering.ascending("a"))
    assert placed.total == 0 and placed.rows.count() == 0


@pytest.mark.parametrize("block_rows", [11, 64, 10_000])
def test_form_in_blocks_equals_plain_windows(sides, block_rows):
    means = {k: v for k, v in history.TEAM_MEANS.items() if v[0] in history.LONG_MEASURES}
    names = ["match_id", "team", "rest_days", *means, *history.VENUE_MEANS]
    plain = history.form_features(sides, means)
    blocks = history.form_features(sides, means, hot=True, block_rows=block_rows)
    assert collected(plain, *names) == collected(blocks, *names)


def test_lookback_must_fit_into_a_block(sides):
    with pytest.raises(ValueError, match="exceed"):
        ordering.in_blocks(sides, ["team"], ["match_id"], 10, lambda w: {}, 10)


@pytest.mark.parametrize("block_rows", [7, 100])
@pytest.mark.parametrize("keys", [("team",), ()])
def test_running_sums_in_blocks(sides, keys, block_rows):
    window = Window.partitionBy(*keys).orderBy(*ordering.ascending("kickoff", "match_id")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    expected = sides.withColumn("run", F.sum("goals_for").over(window))
    found = ordering.running_sums(
        sides, keys, ("kickoff", "match_id"), {"run": F.col("goals_for")}, hot=True, block_rows=block_rows
    )
    assert collected(expected, "match_id", "run") == collected(found, "match_id", "run")


def test_running_sums_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, v int")
    found = ordering.running_sums(df, ("k",), ("v",), {"run": F.col("v")}, hot=True, block_rows=1)
    assert sorted((r["k"] or "", r["run"]) for r in found.collect()) == [("", 1), ("", 3), ("a", 3), ("a", 7)]


def test_row_numbers_in_blocks(sides):
    plain = ordering.number_rows(sides, ("team",), ("kickoff", "match_id"), "n", start=0)
    blocks = ordering.number_rows(
        sides, ("team",), ("kickoff", "match_id"), "n", start=0, hot=True, block_rows=9
    )
    assert collected(plain, "match_id", "n") == collected(blocks, "match_id", "n")


def test_splits_follow_truncated_fractions(sides):
    train, test = ordering.temporal_split(sides, 0.799, ("kickoff", "match_id"))
    assert train.count() == int(600 * 0.799) and test.count() == 600 - int(600 * 0.799)
    part = ordering.temporal_slice(sides, 0.333, 0.5, ("match_id",))
    assert sorted(r["match_id"] for r in part.collect()) == list(range(199, 300))


@pytest.mark.parametrize("fraction", [0, 1, -0.1])
def test_split_fraction_is_checked(sides, fraction):
    with pytest.raises(ValueError):
        ordering.temporal_split(sides, fraction, ("match_id",))


def test_empty_slice_is_an_error(sides):
    with pytest.raises(ValueError, match="no rows"):
        ordering.temporal_slice(sides, 0.0, 0.001, ("match_id",))


def test_splits_of_moments_with_ties_and_gaps(sides):
    rows = sorted(sides.collect(), key=lambda r: (r["kickoff"] is None, r["kickoff"] or 0, r["match_id"]))
    for fraction in (0.001, 0.3, 0.5, 0.97, 0.999):
        train, test = ordering.temporal_split(sides, fraction, ("kickoff", "match_id"))
        cut = int(600 * fraction)
        assert {r["match_id"] for r in train.collect()} == {r["match_id"] for r in rows[:cut]}
        assert {r["match_id"] for r in test.collect()} == {r["match_id"] for r in rows[cut:]}


def test_chronological_numbers_are_lazy_and_right(spark, sides):
    found = ordering.chronological_number(sides, "kickoff", ("league", "match_id"), "number")
    assert "SinglePartition" not in found.select("match_id").limit(1)._jdf.queryExecution().analyzed().toString()
    rows = sorted(sides.collect(), key=lambda r: (r["kickoff"] is None, r["kickoff"] or 0, r["match_id"]))
    numbers = {r["match_id"]: r["number"] for r in found.collect()}
    assert numbers == {r["match_id"]: n for n, r in enumerate(rows, 1)}


def test_a_hot_day_spreads_over_tasks(spark):
    """95 % of the rows have one moment: numbered with ``hot`` they lie in several partitions, in the right order."""
    moment = F.when(F.col("id") % 20 == 0, F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(cast(id % 700 as int))")).otherwise(F.expr("timestamp_ntz'2021-05-05'"))
    df = spark.range(40_000).select(F.when(F.col("id") % 97 > 0, moment).alias("kickoff"), F.concat(F.lit("L"), F.col("id") % 3).alias("league"), F.col("id").alias("match_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would be drawn together
    try:
        found = ordering.chronological_number(df, "kickoff", ("league", "match_id"), "number", hot=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    share = found.where("kickoff = '2021-05-05'").groupBy(F.spark_partition_id()).count().agg(F.max("count") / F.sum("count")).first()[0]
    assert share < 0.6
    lazy = ordering.chronological_number(df, "kickoff", ("league", "match_id"), "number")
    assert collected(found, "match_id", "number") == collected(lazy, "match_id", "number")


@pytest.mark.parametrize("lead", ["cast(id % 97 as string)", "case when id % 7 = 0 then null when id % 11 = 0 then double('nan') when id % 13 = 0 then double('inf') when id % 17 = 0 then double('-inf') else id % 30 / 7 end", "cast(id * id as decimal(30, 2))", "id % 3 = 0", "case when id = 5 then 9223372036854775807 else id end", "cast(null as int)"])
def test_cuts_of_any_leading_key(spark, monkeypatch, lead):
    monkeypatch.setattr(ordering, "PARTS", 16)
    df = spark.range(500).repartition(5).select(F.expr(lead).alias("k"), "id")
    rows = [r["id"] for r in df.orderBy(*ordering.ascending("k", "id")).collect()]
    for fraction in (0.01, 0.5, 0.93):
        train, test = ordering.temporal_split(df, fraction, ("k", "id"))
        cut = int(500 * fraction)
        assert {r["id"] for r in train.collect()} == set(rows[:cut]) and {r["id"] for r in test.collect()} == set(rows[cut:])


def test_global_order_has_no_single_partition_window(sides):
    plan = ordering.global_order(sides, ("kickoff", "match_id"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_form_windows_share_one_shuffle(spark, tmp_path, sides):
    path = str(tmp_path / "sides")
    sides.write.parquet(path)
    means = {k: v for k, v in history.TEAM_MEANS.items() if v[0] in history.LONG_MEASURES}
    form = history.form_features(spark.read.parquet(path), means)
    assert form._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
