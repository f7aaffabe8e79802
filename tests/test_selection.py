import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchform.operators import folds, models, scoring, selection
from matchform.plans.training import train_and_evaluate
from matchform.sources import result_store
from matchform.sources.result_store import load_results
from tests.frames import priced_seasons

FAST = selection.Settings(kind="logistic", max_selected=2)
SMALL_SPACE = {"num_leaves": [7], "max_depth": [3], "min_child_samples": [20], "reg_lambda": [0.0]}
MARKET = ["market_home_prob_fair", "market_away_prob_fair"]


@pytest.fixture(scope="module")
def seasons(spark):
    return spark.createDataFrame(priced_seasons()).cache()


def test_folds():
    labels = ["a", "b", "c", "d", "e"]
    assert folds.outer_folds(labels) == [(["a", "b"], "c"), (["a", "b", "c"], "d")]
    assert folds.inner_folds(labels[:3]) == [(["a"], "b"), (["a", "b"], "c")]
    with pytest.raises(ValueError, match="four seasons"):
        folds.outer_folds(labels[:3])


def test_fold_relation_matches_the_lists(spark, seasons):
    found = {}
    for r in folds.fold_relation(seasons, 2, 1).collect():
        found.setdefault(r["fold"], {}).setdefault(r["role"], []).append(r["season"])
    expected = folds.outer_folds(folds.ordered_seasons(seasons))
    assert [(sorted(found[i + 1]["train"]), found[i + 1]["validation"][0]) for i in range(len(expected))] == expected


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(1e6, 1.0, (500, 3)), columns=list("abc"))
    pdf["d"], pdf["k"] = pdf["a"] * -2 + rng.normal(0, 0.1, 500), 5.3
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::5, "c"] = None
    found = folds.correlation_pairs(spark.createDataFrame(pdf).repartition(6), list("abcdk")).collect()
    expected = pdf.corr().abs()
    for r in found:
        if "k" in (r["left"], r["right"]):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(expected.loc[r["left"], r["right"]], abs=1e-8)
    assert len(found) == 10


def test_an_outlier_without_partner_changes_nothing(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=400)})
    pdf["b"] = pdf["a"] + rng.normal(0, 0.05, 400)
    pdf.loc[400] = [-1e7, np.nan]
    pdf["tiny"], pdf["flat"] = pdf["b"] * 1e-100, 0.1
    found = {(r["left"], r["right"]): r["correlation"] for r in folds.correlation_pairs(spark.createDataFrame(pdf), list(pdf)).collect()}
    assert found["a", "b"] == pytest.approx(pdf["a"].corr(pdf["b"])) and found["a", "b"] > 0.99
    assert found["b", "tiny"] == pytest.approx(1.0) and found["a", "flat"] is None
    assert folds.drop_correlated(spark.createDataFrame(pdf), ["a", "b"], ["a", "b"], 0.9) == ["a"]


def test_a_million_names_are_coded_without_the_driver(spark):
    rows = spark.range(1_000_000).select(F.concat(F.lit("club "), "id").alias("HomeTeam"), F.when(F.col("id") % 2 == 0, "H").otherwise("A").alias("FTR"))
    data = models.encode(rows, ["HomeTeam"])
    rates = models.category_rates(data.rows, "HomeTeam")
    coded = models.with_rates(data.rows.limit(1000), "HomeTeam", rates)
    assert "SinglePartition" not in rates._jdf.queryExecution().executedPlan().toString()
    ends = {(r["FTR"], round(r["__HomeTeam_home"], 6)) for r in coded.collect()}
    assert ends == {("H", round((1 + 10 / 3) / 11, 6)), ("A", round(10 / 3 / 11, 6))}


def test_redundant_candidates_are_dropped(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=200)})
    pdf["b"], pdf["c"], pdf["team"] = pdf["a"] * 3, rng.normal(size=200), "x"
    df = spark.createDataFrame(pdf)
    names = ["team", "a", "b", "c"]
    assert folds.drop_correlated(df, names, ["a", "b", "c"], 0.9) == ["team", "a", "c"]
    assert folds.drop_correlated(df, names, ["a", "b", "c"], None) == names


def test_parameter_sample_is_seeded():
    first = selection.sample_params(count=20)
    assert first == selection.sample_params(count=20) and len(first) == 20
    assert len(selection.sample_params(count=5000)) == 2187


def test_parameters():
    assert models.clean_params({"max_depth": 3.0, "param_id": 7, "subsample": 0.7}) == {"max_depth": 3, "subsample": 0.7}
    with pytest.raises(ValueError):
        models.clean_params({"n_estimators": 10})
    given = {"num_leaves": 7, "max_depth": 6, "learning_rate": 0.05, "colsample_bytree": 1.0}
    assert models.stage_params("forest", given) == {"maxDepth": 3, "featureSubsetStrategy": "all"}
    assert models.boosted_params(given | {"param_id": 3}).depth == 3 and models.boosted_params({}).learning_rate == 0.1


def test_no_features_scores_the_priors(spark, seasons):
    data = selection.prepare(seasons, MARKET, FAST)
    labels = folds.ordered_seasons(seasons)
    found = selection.mean_loss([selection.split_at(data, labels[:1], labels[1], FAST)], [], {}, FAST)
    pdf = seasons.toPandas()
    prior = pdf[pdf["season"] == labels[0]]["FTR"].value_counts(normalize=True)
    expected = np.mean([-math.log(prior[o]) for o in pdf[pdf["season"] == labels[1]]["FTR"]])
    assert found == pytest.approx(expected)


def test_walk_forward(spark, seasons):
    features = ["HomeTeam", "market_home_prob_fair", "market_draw_prob_fair", "market_away_prob_fair"]
    found = selection.walk_forward(seasons, features, FAST, count=1)
    best = found.results[0]
    assert best["cv_fold_count"] == 2 and found.holdout_season == "2023/24"
    assert set(best["last_fold_features"]) <= set(features)
    assert "2023/24" not in {row["validation_season"] for row in found.selections}
    assert {t.feature for t in found.trials if t.fold == 2} == set(best["last_fold_features"])
    # The outcomes follow the market's probabilities, so one of them must be found and beat the priors.
    assert {"market_home_prob_fair", "market_away_prob_fair"} & set(best["last_fold_features"])


def test_walk_forward_side_by_side_equals_one_by_one(spark, seasons):
    """Boosted fits of a step share their jobs; each must be what a fit of its own gives."""
    settings = replace(FAST, kind="boosted", trees=4)
    data = selection.prepare(seasons, ["HomeTeam", *MARKET], settings)
    labels = folds.ordered_seasons(data.rows)
    bench = selection.bench_of(data, labels, ["HomeTeam", *MARKET], settings)
    params = {"max_depth": 3, "num_leaves": 7, "min_child_samples": 10, "learning_rate": 0.2}
    wanted = [(MARKET, labels[:2], labels[2]), (["HomeTeam"], labels[:3], labels[3])]
    together = bench.losses(wanted, params, settings)
    for ask, pair in zip(wanted, together):
        assert bench.losses([ask], params, settings)[0] == pytest.approx(pair)
    alone = selection.losses(selection.split_at(data, labels[:2], labels[2], settings), MARKET, params, settings)
    assert alone[0] == pytest.approx(together[0][0], abs=0.02)
    found = selection.walk_forward(seasons, ["HomeTeam", *MARKET], settings, count=1)
    assert {"market_home_prob_fair", "market_away_prob_fair"} & set(found.results[0]["last_fold_features"])
    assert found.results[0]["mean_log_loss"] < found.trials[0].inner_loss + 0.5


def test_groups_limit_candidates(spark, seasons):
    found = selection.walk_forward(
        seasons, MARKET, FAST, count=1, groups={"one": ["market_home_prob_fair"]}, space=SMALL_SPACE
    )
    assert set(found.results[0]["last_fold_features"]) <= {"market_home_prob_fair"}


@pytest.mark.parametrize("kind", models.KINDS)
def test_every_kind_beats_the_priors(spark, seasons, kind):
    settings = replace(FAST, kind=kind, trees=5)
    params = {"max_depth": 3, "num_leaves": 15, "learning_rate": 0.3, "min_child_samples": 10, "reg_lambda": 1.0}
    done = selection.evaluate_holdout(seasons, ["HomeTeam", *MARKET], params, settings=settings)
    assert (done.metrics["train_matches"], done.metrics["test_matches"]) == (480, 120)
    sums = done.predictions.select(sum(F.col(p) for p in scoring.MODEL_PROBS).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert tuple(sums) == pytest.approx((1.0, 1.0))
    train, test = seasons.filter("match_id < 480"), seasons.filter("match_id >= 480")
    assert done.metrics["holdout_log_loss"] < scoring.prior_baseline(train, test).first()["log_loss"]


def test_final_season(spark, seasons):
    done = selection.evaluate_final_season(seasons, MARKET, {}, FAST)
    assert done.metrics["test_season"] == "2023/24" and len(done.metrics["train_seasons"]) == 4
    assert 0.4 < done.metrics["accuracy"] < 1 and done.predictions.count() == 120


def test_holdout_arguments(spark, seasons):
    with pytest.raises(ValueError):
        selection.evaluate_holdout(seasons, [], {}, settings=FAST)
    with pytest.raises(ValueError):
        selection.evaluate_holdout(seasons, MARKET, {}, 1.0, FAST)


def test_training_round_trip(spark, seasons, tmp_path):
    folder = str(tmp_path / "results")
    assert load_results(spark, folder) is None
    summary, metrics, market = train_and_evaluate(
        seasons, folder, {"market": MARKET}, FAST, count=1, space=SMALL_SPACE
    )
    loaded = load_results(spark, folder)
    assert loaded["predictions"].count() == metrics["test_matches"] == market.first()["match_count"]
    assert loaded["run_info"].first()["best_grouping"] == "market"
    row = loaded["grouping_cv"].first()
    assert len(row["fold_log_losses"]) == 2 and set(row["best_params"]) == set(SMALL_SPACE)
    assert loaded["predictions"].filter("kickoff is null or HomeTeam is null").count() == 0


def test_a_save_that_fails_leaves_the_set_before_it(spark, seasons, tmp_path, monkeypatch):
    folder = str(tmp_path / "results")
    done = selection.evaluate_holdout(seasons, MARKET, {}, settings=FAST)
    row = {"grouping": "first", "feature_count": 2, "best_mean_log_loss": 1.0, "best_mean_brier_score": 0.6, "selected_features": MARKET,
           "validation_seasons": [], "fold_log_losses": [1.0], "best_params": {}}
    result_store.save_results(selection.summary_frame(spark, [row]), done, seasons, folder)
    second = selection.summary_frame(spark, [row | {"grouping": "second"}])

    def lost(*_):
        raise OSError("the disk is gone")

    with monkeypatch.context() as patch:
        patch.setattr(result_store, "join_one_to_one", lost)
        with pytest.raises(OSError):
            result_store.save_results(second, done, seasons, folder)
    kept = load_results(spark, folder)
    assert kept["grouping_cv"].first()["grouping"] == kept["run_info"].first()["best_grouping"] == "first" and kept["predictions"].count() == 120
    result_store.save_results(second, done, seasons, folder)
    assert load_results(spark, folder)["run_info"].first()["best_grouping"] == "second"


def test_a_fit_is_made_once_and_few_go_side_by_side(spark, seasons, monkeypatch):
    """Folds ask for the same inner fits; what goes side by side is bounded, whatever is asked for."""
    settings = replace(FAST, kind="boosted", trees=2)
    data = selection.prepare(seasons, ["HomeTeam", *MARKET], settings)
    labels = folds.ordered_seasons(data.rows)
    bench = selection.bench_of(data, labels, ["HomeTeam", *MARKET], settings)
    params = {"max_depth": 2, "num_leaves": 3, "min_child_samples": 10}
    inner = [split for known, _ in folds.outer_folds(labels) for split in folds.inner_folds(known)]
    wanted = [(features, *split) for split in inner for features in (MARKET, MARKET[:1], ["HomeTeam"])]
    expected, runs, boost = bench.losses(wanted, params, settings), [], selection.boosting.boost

    def counted(data, bins, fits, *others):
        runs.append(fits)
        return boost(data, bins, fits, *others)

    monkeypatch.setattr(selection.boosting, "boost", counted)
    monkeypatch.setattr(selection, "FIT_COLUMNS", 3)
    assert bench.losses(wanted, params, settings) == [pytest.approx(pair) for pair in expected]
    assert sum(map(len, runs)) == len({tuple(learn) for learn, _ in inner}) * 3 < len(wanted)
    assert all(sum(len(fit.features) for fit in run) <= 3 for run in runs)


def test_groups_are_compared_on_a_parquet_table_without_shuffles(spark, seasons, monkeypatch):
    """The search reads a written table, and the shuffles it came from are given up before."""
    steps = []
    monkeypatch.setattr(selection, "release", lambda session: steps.append("released"), raising=False)

    def searched(df, features, *args, **kwargs):
        steps.append(df.inputFiles())
        best = {"mean_log_loss": 1.0, "mean_brier_score": 0.5, "last_fold_features": [], "validation_seasons": [], "fold_log_losses": [], "params": {}}
        assert df.count() == seasons.count()
        return selection.WalkForward([best], [], "", [])

    monkeypatch.setattr(selection, "walk_forward", searched)
    selection.compare_groups(seasons.repartition(3, "match_id"), {"market": MARKET}, FAST)
    assert steps[0] == "released" and steps[1] and all(file.endswith(".parquet") for file in steps[1])
