import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchform.functions import scalars as S
from matchform.operators import backtest, scoring
from tests.frames import priced_seasons

PROBS = ["h", "d", "a"]


def probs_frame(spark, rows):
    return spark.createDataFrame(rows, "h double, d double, a double, FTR string")


def market_frame(spark, outcomes):
    return spark.createDataFrame(
        [(i, o, 0.5, 0.25, 0.25) for i, o in enumerate(outcomes)],
        "match_id bigint, FTR string, market_home_prob_fair double, market_draw_prob_fair double, market_away_prob_fair double",
    )


def test_brier_of_perfect_and_uniform(spark):
    perfect = probs_frame(spark, [(1.0, 0.0, 0.0, "H"), (0.0, 1.0, 0.0, "D"), (0.0, 0.0, 1.0, "A")])
    assert scoring.mean_brier(perfect, PROBS).first()[0] == 0.0
    third = 1 / 3
    uniform = probs_frame(spark, [(third, third, third, o) for o in "HDA"])
    assert scoring.mean_brier(uniform, PROBS).first()[0] == pytest.approx(2 / 3)


def test_log_loss_clips_and_renormalises(spark):
    df = probs_frame(spark, [(2.0, 1.0, 1.0, "H"), (1.0, 0.0, 0.0, "A")])
    losses = [r[0] for r in df.select(S.row_log_loss(F.col("h"), F.col("d"), F.col("a"), F.col("FTR"))).collect()]
    assert losses[0] == pytest.approx(math.log(2)) and losses[1] == pytest.approx(-math.log(1e-15))
    assert scoring.mean_log_loss(df.limit(1), PROBS).first()[0] == pytest.approx(math.log(2))


def test_pick_ties_go_in_order(spark):
    df = probs_frame(spark, [(0.4, 0.4, 0.2, "H"), (0.2, 0.4, 0.4, "H"), (0.3, 0.3, 0.4, "H")])
    assert [r[0] for r in df.select(S.pick(F.col("h"), F.col("d"), F.col("a"))).collect()] == ["H", "D", "A"]


def test_market_baseline(spark):
    row = scoring.market_baseline(market_frame(spark, "HDAHHADHAHHDHDA")).first()
    assert row["match_count"] == 3 and row["start_percentile"] == "80%" and row["end_percentile"] == "100%"
    assert row["market_brier_score"] == pytest.approx((0.375 + 0.875 + 0.875) / 3, abs=1e-4)


def test_market_baseline_without_a_class(spark):
    assert scoring.market_baseline(market_frame(spark, "HDAHHADHHA")).first()["match_count"] == 2


def test_calibration_bins_close_like_cut(spark):
    edges = [0.0, 0.1, 0.2, 0.3, 0.6, 0.7, 0.30000000000000004, 0.6000000000000001, 0.7000000000000001, 1.0, 0.55]
    rows = [(p, 0.5, 0.5, 0.5, 0.5, 0.5, "H") for p in edges]
    df = spark.createDataFrame(
        rows, ", ".join(f"{c} double" for c in (*scoring.MODEL_PROBS, *scoring.MARKET_PROBS)) + ", FTR string"
    )
    found = scoring.calibration(df, min_rows=1).filter("source = 'model' and outcome = 'H'")
    ours = {r["bin"]: r["matches"] for r in found.collect()}
    bins = pd.cut(pd.Series(edges), list(np.linspace(0, 1, 11)), include_lowest=True, labels=range(1, 11))
    assert ours == {int(k): v for k, v in bins.value_counts().items() if v}


def test_small_bins_are_left_out(spark):
    df = spark.createDataFrame(
        [(0.5, 0.3, 0.2, 0.5, 0.3, 0.2, "H")] * 9,
        ", ".join(f"{c} double" for c in (*scoring.MODEL_PROBS, *scoring.MARKET_PROBS)) + ", FTR string",
    )
    assert scoring.calibration(df).count() == 0


def test_priors_have_zero_for_an_absent_class(spark):
    row = scoring.class_priors(market_frame(spark, "HHHA")).first()
    assert tuple(row) == (0.75, 0.0, 0.25)


def test_rows_without_a_probability_are_not_scored(spark):
    pdf = priced_seasons(1, 20)
    df = spark.createDataFrame(pdf)
    model = {p: F.when(F.col("match_id") > 4, F.col(m)) for p, m in zip(scoring.MODEL_PROBS, scoring.MARKET_PROBS)}
    scored = scoring.add_scores(df.withColumns(model))
    assert scored.count() == 15
    assert scored.filter("model_log_loss <> market_log_loss or model_pick <> market_pick").count() == 0


def bets_frame(spark):
    # model H, D, A, market H, D, A, odds H, D, A, result
    rows = [
        (1, 1, 0.6, 0.2, 0.2, 0.5, 0.3, 0.2, 2.0, 3.0, 5.0, "H"),
        (2, 2, 0.3, 0.3, 0.4, 0.3, 0.3, 0.4, 2.0, 3.0, 2.0, "H"),
        (3, 2, 0.4, 0.3, 0.3, 0.4, 0.3, 0.3, None, 3.0, 4.0, "H"),
        (4, 3, 0.2, 0.5, 0.3, 0.25, 0.35, 0.4, 3.0, 4.0, 2.0, "A"),
    ]
    names = ["match_id bigint", "day int"]
    names += [f"{c} double" for c in (*scoring.MODEL_PROBS, *scoring.MARKET_PROBS, *backtest.BEST_ODDS)] + ["FTR string"]
    df = spark.createDataFrame(rows, ", ".join(names))
    kickoff = F.make_timestamp_ntz(F.lit(2025), F.lit(1), F.col("day"), F.lit(12), F.lit(0), F.lit(0))
    return df.withColumns(
        {"kickoff": kickoff, "Div": F.lit("E0"), "HomeTeam": F.lit("x"), "AwayTeam": F.lit("y")}
    ).drop("day")


def test_strategies(spark):
    df = bets_frame(spark)
    fav = {r["match_id"]: r["pick"] for r in backtest.place_bets(df, backtest.favourite()).collect()}
    assert fav == {1: "H", 2: "A", 4: "D"}
    edge = {r["match_id"]: r["pick"] for r in backtest.place_bets(df, backtest.value_edge(0.05)).collect()}
    assert edge == {1: "H", 4: "D"}
    ev = {r["match_id"]: r["pick"] for r in backtest.place_bets(df, backtest.positive_ev(0.0)).collect()}
    assert ev == {1: "H", 4: "D"}


@pytest.mark.parametrize("block_rows", [None, 1, 2, 1000])
def test_summary_and_drawdown(spark, block_rows):
    settled = backtest.settled_bets(bets_frame(spark), stake=10.0)
    rows = {r["strategy"]: r for r in backtest.bet_summary(settled, 10.0, block_rows).collect()}
    fav = rows["Model favourite"]
    # +10, -10, -10: the peak of 10 is followed by -10.
    assert (fav["bets"], fav["total_profit"], fav["max_drawdown"]) == (3, -10.0, 20.0)
    assert fav["win_rate"] == pytest.approx(1 / 3) and fav["roi"] == pytest.approx(-1 / 3)
    assert rows["Value edge"]["max_drawdown"] == 10.0


def test_drawdown_by_days_equals_blocks(spark):
    rows = spark.range(3000).select(
        F.element_at(F.array(*map(F.lit, backtest.STRATEGIES)), (F.col("id") % 2 + 1).cast("int")).alias("strategy"),
        F.when(F.col("id") % 41 > 0, F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, cast(xxhash64(id) % 2000 as int))")).alias("kickoff"),
        F.col("id").alias("match_id"), (F.xxhash64(F.col("id") + 7) % 2 == 0).alias("won"), (F.xxhash64("id") % 19).cast("double").alias("profit"),
    )
    by_day, in_blocks = (sorted(map(tuple, backtest.bet_summary(rows, 10.0, n).collect())) for n in (None, 77))
    assert by_day == in_blocks and by_day[0][-1] > 0


def test_drawdown_counts_from_zero(spark):
    settled = backtest.settled_bets(bets_frame(spark).filter("match_id = 4"))
    row = {r["strategy"]: r for r in backtest.bet_summary(settled).collect()}["Model favourite"]
    assert row["max_drawdown"] == 10.0


def test_summary_of_no_bets(spark):
    settled = backtest.settled_bets(bets_frame(spark).filter("match_id < 0"))
    rows = backtest.bet_summary(settled).collect()
    assert len(rows) == 3
    assert all((r["bets"], r["total_profit"], r["win_rate"], r["roi"]) == (0, 0.0, None, None) for r in rows)


def test_gap_closed(spark):
    row = spark.range(1).select(
        scoring.gap_closed(F.lit(1.0727), F.lit(1.0134), F.lit(0.9720)).alias("closed"),
        scoring.gap_closed(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("none"),
    ).first()
    assert row["closed"] == pytest.approx(0.589, abs=5e-4) and row["none"] is None
