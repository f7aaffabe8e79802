"""Features look only at earlier matches, and the whole build matches hand results."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchform.operators import assemble, checks, crosswalk, enrich, history, reshape
from matchform.plans import features
from matchform.session import tune
from tests.frames import earlier_means, points_of, triangle


@pytest.fixture(scope="module")
def no_codes(spark):
    return spark.createDataFrame([], "team_name string, team_code string, count bigint")


def prematch(spark, pdf, codes):
    matches = enrich.enrich_matches(spark.createDataFrame(pdf), codes)
    return features.prematch_table(matches).orderBy("match_id").toPandas()


def test_form_equals_means_of_earlier_matches(spark, no_codes):
    season = triangle(20)
    table = prematch(spark, season, no_codes)
    goals = lambda row, venue: row["FTHG" if venue == "home" else "FTAG"]
    shots = lambda row, venue: row["HS" if venue == "home" else "AS"]
    for name, value, size in (("points_last_5", points_of, 5), ("points_last_10", points_of, 10), ("goals_for_last_5", goals, 5), ("shots_for_last_5", shots, 5)):
        for venue in ("home", "away"):
            expected = [pair[venue] for pair in earlier_means(season, value, size)]
            assert table[f"{venue}_{name}"].astype(object).where(table[f"{venue}_{name}"].notna(), None).tolist() == pytest.approx(expected)
    for venue in ("home", "away"):
        found = table[f"{venue}_points_{venue}_last_5"]
        expected = [pair[venue] for pair in earlier_means(season, points_of, 5, venue)]
        assert found.astype(object).where(found.notna(), None).tolist() == pytest.approx(expected)
    fair = table[["market_home_prob_fair", "market_draw_prob_fair", "market_away_prob_fair"]]
    assert fair.sum(axis=1).tolist() == pytest.approx([1.0] * 20)
    assert list(table["match_id"]) == list(range(20))
    assert table["match_concat"].iloc[0] == "2025-08-02__"
    assert table.loc[3, "home_rest_days"] > 0


def test_row_order_does_not_matter(spark, no_codes):
    pdf = triangle()
    first = prematch(spark, pdf, no_codes)
    second = prematch(spark, pdf.sample(frac=1, random_state=4), no_codes)
    pd.testing.assert_frame_equal(first, second[first.columns])


def test_own_result_and_later_matches_do_not_leak(spark, no_codes):
    pdf = triangle()
    wanted = [c for c in prematch(spark, pdf, no_codes).columns if "_last_" in c or c.endswith("rest_days")]
    before = prematch(spark, pdf, no_codes)[wanted]
    changed = pdf.copy()
    changed.loc[6, ["FTR", "FTHG", "FTAG"]] = ["A", 0, 8]
    after = prematch(spark, changed, no_codes)[wanted]
    pd.testing.assert_frame_equal(before.iloc[:7], after.iloc[:7])
    assert not before.iloc[7:].equals(after.iloc[7:])
    shorter = prematch(spark, pdf.iloc[:8], no_codes)[wanted]
    pd.testing.assert_frame_equal(before.iloc[:8], shorter)


def test_results_restart_each_season(spark, no_codes):
    old, new = triangle(7), triangle(3, "2026/27", "2026-08-08")
    table = prematch(spark, pd.concat([old, new]), no_codes)
    first = table[(table["season"] == "2026/27") & (table["match_id"] == 0)]
    assert first["home_points_last_5"].isna().all()


@pytest.fixture(scope="module")
def xg_matches(spark):
    rows = [
        (i, datetime(2025, 8, 1) + timedelta(days=7 * i), "L1", "Otters", "Herons", 0.5 + i, 4.0 * (i + 1))
        for i in range(4)
    ]
    return spark.createDataFrame(
        rows,
        "match_id bigint, kickoff timestamp_ntz, league string, HomeTeam string, AwayTeam string, home_xg double, away_xg double",
    )


def test_rolling_xg(xg_matches):
    table = features.rolling_xg_table(xg_matches, xg_matches).orderBy("match_id").toPandas()
    assert pd.isna(table.loc[0, "home_xg_last_5"]) and pd.isna(table.loc[0, "home_xg_against_last_5"])
    row = table.loc[2, ["home_xg_last_5", "home_xg_against_last_5", "away_xg_last_5", "away_xg_against_last_5"]]
    assert row.tolist() == [1.0, 6.0, 6.0, 1.0]


def test_match_without_xg_stays_and_is_skipped_in_history(xg_matches):
    table = features.rolling_xg_table(xg_matches, xg_matches.filter("match_id <> 1")).orderBy("match_id").toPandas()
    assert len(table) == 4
    assert pd.isna(table.loc[1, "home_xg_last_5"])
    assert table.loc[3, "home_xg_last_5"] == pytest.approx((0.5 + 2.5) / 2)


def xg_feed(spark, pdf):
    rows = [
        (str(pd.to_datetime(d, dayfirst=True).date()), h, a, h[:3].upper(), a[:3].upper(), 1.0 + i, 0.5, "L1")
        for i, (d, h, a) in enumerate(zip(pdf["Date"], pdf["HomeTeam"], pdf["AwayTeam"]))
    ]
    return spark.createDataFrame(
        rows,
        "date string, home_team string, away_team string, home_team_code string, away_team_code string, "
        "home_xg double, away_xg double, league string",
    )


def test_full_build(spark):
    pdf = triangle()
    table = features.build_features(
        spark.createDataFrame(pdf), xg_feed(spark, pdf), crosswalk.curated_crosswalk(spark)
    )
    assert tuple(table.columns) == assemble.MODEL_COLUMNS and len(table.columns) == 35
    rows = table.orderBy("match_id").toPandas()
    assert list(rows["match_id"]) == list(range(1, 13))
    feed = [{"home": 1.0 + i, "away": 0.5} for i in range(12)]
    pdf["n"] = range(12)
    expected = [pair["home"] for pair in earlier_means(pdf, lambda row, venue: feed[row["n"]][venue], 5)]
    assert rows["home_xg_last_5"].astype(object).where(rows["home_xg_last_5"].notna(), None).tolist() == pytest.approx(expected)
    assert rows["best_odds_home"].tolist() == pytest.approx(pdf["MaxH"].tolist())
    found = checks.check_chronology(table).first()
    assert (found["backward_steps"], found["repeated_keys"]) == (0, 0)


def test_full_build_is_the_same_in_blocks(spark):
    pdf = pd.concat([triangle(12).assign(league=l, Div=l) for l in ("L1", "L2")])
    frames = spark.createDataFrame(pdf), xg_feed(spark, pdf), crosswalk.curated_crosswalk(spark)
    order = ["match_id", "home_xg_last_5", "away_xg_last_5"]
    plain = features.build_features(*frames).orderBy(*order).toPandas()
    blocks = features.build_features(*frames, hot=True, block_rows=11).orderBy(*order).toPandas()
    pd.testing.assert_frame_equal(plain, blocks)


def test_league_can_join_the_xg_key(spark):
    feats = spark.createDataFrame([(1, "k", "A"), (2, "k", "B")], "match_id int, match_concat string, league string")
    xg = spark.createDataFrame(
        [("2025-08-01", "h", "a", 1.0, 2.0, "A")],
        "date string, home_team_code string, away_team_code string, home_xg double, away_xg double, league string",
    )
    feats = feats.withColumn("match_concat", F.lit("2025-08-01_h_a"))
    assert assemble.join_xg(feats, xg).count() == 2
    assert [r["match_id"] for r in assemble.join_xg(feats, xg, by_league=True).collect()] == [1]


def test_crosswalk_rules(spark):
    seed = spark.createDataFrame([("Otters", "OTT", 3)], "team_name string, team_code string, count bigint")
    curated = spark.createDataFrame(
        [(5, "Otters", "XYZ"), (9, "Badgers", "BGR"), (7, "Badgers", "BAD")],
        "position int, team_name string, team_code string",
    )
    merged = {r["team_name"]: (r["team_code"], r["count"]) for r in crosswalk.merge_crosswalk(seed, curated).collect()}
    assert merged == {"Otters": ("OTT", 3), "Badgers": ("BAD", None)}
    clash = seed.unionAll(spark.createDataFrame([("Otters", "OTR", 1)], seed.schema))
    with pytest.raises(Exception, match="more than one code"):
        crosswalk.merge_crosswalk(clash, curated).collect()


def test_curated_list(spark):
    rows = crosswalk.curated_crosswalk(spark)
    assert rows.count() == rows.select("team_name").distinct().count() == 186


def test_one_to_one_join_rejects_repeats(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "match_id int, l string")
    right = spark.createDataFrame([(1, "x")], "match_id int, r string")
    joined = assemble.join_one_to_one(left, right, "match_id")
    assert sorted(map(tuple, joined.collect())) == [(1, "a", "x"), (2, "b", None)]
    for pair in ((left.unionAll(left), right), (left, right.unionAll(right))):
        with pytest.raises(Exception, match="repeats"):
            assemble.join_one_to_one(*pair, "match_id").collect()


def test_team_view_and_minimum_count(spark):
    pdf = triangle(9)
    matches = enrich.with_market_probs(spark.createDataFrame(pdf)).withColumn(
        "match_id", F.monotonically_increasing_id()
    )
    matches = matches.withColumn("kickoff", F.to_timestamp_ntz(F.col("Date"), F.lit("dd/MM/yyyy")))
    for name in ("home_xg_last_5", "away_xg_last_5", "home_points_home_last_5", "away_points_away_last_5"):
        matches = matches.withColumn(name, F.lit(1.0))
    view = reshape.team_view(matches, "Otters")
    rolled = history.rolling_mean(
        view, ("team",), ("kickoff", "match_id"), {"avg": ("win_prob", 10)}, include_current=True, min_count=3
    ).orderBy("kickoff").collect()
    own = pdf[(pdf["HomeTeam"] == "Otters") | (pdf["AwayTeam"] == "Otters")]
    assert [r["venue"] for r in rolled] == ["home" if h == "Otters" else "away" for h in own["HomeTeam"]]
    assert [r["avg"] is None for r in rolled] == [True, True] + [False] * (len(own) - 2)
    assert rolled[2]["avg"] == pytest.approx(sum(r["win_prob"] for r in rolled[:3]) / 3)


def exchanges_of(plan, column):
    """How many exchanges below ``plan`` have ``column`` in their rows."""
    children = plan.children()
    below = sum(exchanges_of(children.apply(i), column) for i in range(children.size()))
    return below + ("Exchange" in plan.nodeName() and column in plan.output().mkString(" "))


def test_wide_rows_move_once(spark):
    """A match's own columns are shuffled to their league-season and nowhere else, whatever the join of names."""
    pdf = triangle()
    tune(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = features.build_features(
            spark.createDataFrame(pdf), xg_feed(spark, pdf), crosswalk.curated_crosswalk(spark)
        )
        plan = table._jdf.queryExecution().executedPlan().initialPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges_of(plan, "Referee") == 1 and exchanges_of(plan, "carried") == 0
    assert exchanges_of(plan, "home_points_last_5") == 0


def test_match_without_season_stays_without_form(spark):
    pdf = triangle()
    pdf.loc[[7, 8, 9, 10], "season"] = None
    table = features.build_features(
        spark.createDataFrame(pdf), xg_feed(spark, pdf), crosswalk.curated_crosswalk(spark)
    )
    rows = table.orderBy("match_id").toPandas()
    assert list(rows["match_id"]) == list(range(1, 13)) and list(rows["Referee"]) == list(pdf["Referee"])
    lost = rows["season"].isna()
    assert list(lost) == list(pdf["season"].isna()) and rows.loc[lost, "home_points_last_5"].isna().all()
    assert rows.loc[11, "home_points_last_5"] >= 0 and rows.loc[lost, "home_xg_last_5"].notna().all()
