"""What reaches the scan, and how often rows are shuffled."""

import pytest
from pyspark.sql import Window, functions as F

from matchform.operators import assemble, filters, ordering, reshape, scoring
from matchform.plans.tables import Tables
from matchform.sources import feature_store
from tests.frames import priced_seasons


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features") / "table")
    pdf = priced_seasons(4, 50)
    feature_store.write_features(spark.createDataFrame(pdf), path)
    return feature_store.load_features(spark, path)


def test_null_checks_reach_the_scan(stored):
    text = plan(filters.complete_rows(stored, ["FTR", "market_home_prob_fair"]).select("match_id"))
    assert "IsNotNull(FTR)" in text and "IsNotNull(market_home_prob_fair)" in text
    assert "AwayTeam" not in text


def test_seasons_are_pruned(stored):
    kept = filters.scope(stored, ["L1"], "2020/21", "2021/22")
    assert kept.count() == 100
    text = plan(kept)
    assert "season" in text[text.index("PartitionFilters"):].split("]")[0]


def test_sides_scan_once_and_stay_narrow(stored):
    text = plan(reshape.to_sides(stored, ("match_id",), {"p": reshape.swapped("market_home_prob_fair", "market_away_prob_fair")}))
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_team_filter_moves_below_the_window(stored):
    form = stored.withColumn("n", F.row_number().over(Window.partitionBy("HomeTeam").orderBy("match_id")))
    text = plan(form.filter(F.col("HomeTeam") == "North"))
    assert "EqualTo(HomeTeam,North)" in text


def test_rejoin_shuffles_each_input_once(spark, stored):
    keys = ("season", "match_id")
    history = reshape.to_sides(stored, keys, {"p": reshape.swapped("market_home_prob_fair", "market_away_prob_fair")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(assemble.rejoin_sides(stored, history, ("p",), keys))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2


def test_one_to_one_check_adds_no_shuffle(spark, stored):
    left, right = stored.select("match_id", "FTR"), stored.select("match_id", "kickoff")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(assemble.join_one_to_one(left, right, "match_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2


def test_large_orders_have_no_single_task(stored):
    scored = stored.withColumns({p: F.col(m) for p, m in zip(scoring.MODEL_PROBS, scoring.MARKET_PROBS)})
    rows = scoring.cumulative_advantage(scoring.add_scores(scored), block_rows=20)
    totals = [r["cumulative_advantage"] for r in rows.collect()]
    assert len(totals) == 200 and set(totals) == {0.0}
    train, _ = ordering.temporal_split(stored, 0.5, ("match_id",))
    assert "SinglePartition" not in plan(train)


def test_parts_of_a_shuffle_stay_small(spark):
    """Queries on tables deal their shuffles finely and let adaptive execution join small parts, whatever the session's number."""
    tables = Tables(spark, "/root/testdata/sf0.001")
    counted = tables.lineitem.groupBy("l_orderkey").count()
    assert "hashpartitioning(l_orderkey" in counted._jdf.queryExecution().toString()
    exchange = [line for line in counted._jdf.queryExecution().toString().splitlines() if "Exchange hashpartitioning(l_orderkey" in line][-1]
    assert int(exchange.split(")")[0].split(", ")[-1]) >= 400
    counted.collect()
    assert counted.rdd.getNumPartitions() < 40
