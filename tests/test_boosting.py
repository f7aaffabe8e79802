import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchform.operators import boosting as bo, models
from tests.frames import priced_seasons

FEATURES = ["HomeTeam", "market_home_prob_fair", "market_away_prob_fair"]


@pytest.fixture(scope="module")
def seasons(spark):
    pdf = priced_seasons()
    pdf["label"], pdf["part"] = pdf["FTR"].map({"H": 0, "D": 1, "A": 2}), pdf["season"].rank(method="dense").astype(int) - 1
    return pdf


def plain_boost(bins, label, key, features, categorical, params, trees, seed, fit=0):
    """The same model for one fit, a node and a bin at a time; returns the margins of the rows it learns from."""
    n = len(label)
    frequency = np.bincount(label, minlength=3)
    margins = np.tile(np.log((frequency + 1e-9) / (frequency + 1e-9).sum()), (n, 1))
    for number in range(trees):
        chance = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        sampled = bo.taken(key, params.subsample, (seed << 20) + number) if params.subsample < 1 else np.ones(n, bool)
        for k in range(3):
            g, h = chance[:, k] - (label == k), 1.5 * chance[:, k] * (1 - chance[:, k])
            allowed = [features[j] for j in bo._columns(len(features), params.colsample_bytree, f"{seed} {fit} {number} {k}")]
            level, leaves, value = [np.ones(n, bool)], 1, np.zeros(n)
            for _ in range(params.depth):
                splits = []
                for place, rows in enumerate(level):
                    used = np.flatnonzero(rows & sampled)
                    best = (0.0, None)
                    for j in allowed:
                        penalty = params.reg_lambda + (10 if categorical[j] else 0)
                        own = sorted(set(bins[used, j]), key=lambda b: (g[used][bins[used, j] == b].sum() / (h[used][bins[used, j] == b].sum() + 10), b) if categorical[j] else (b,))
                        for cut in range(1, len(own)):
                            left = np.isin(bins[used, j], own[:cut])
                            if min(left.sum(), (~left).sum()) < params.min_child_samples:
                                continue
                            gain = round(sum(g[used][s].sum() ** 2 / (h[used][s].sum() + penalty) for s in (left, ~left)) - g[used].sum() ** 2 / (h[used].sum() + params.reg_lambda), 9)
                            if gain > best[0]:
                                best = (gain, (j, own[:cut]))
                    if best[1]:
                        splits.append((-best[0], place, best[1]))
                children = []
                for _, place, (j, left) in sorted(splits, key=lambda s: s[:2]):
                    if leaves >= params.num_leaves:
                        break
                    goes = np.isin(bins[:, j], left) if categorical[j] else bins[:, j] <= max(left)
                    for side in (level[place] & goes, level[place] & ~goes):
                        used = side & sampled
                        value[side] = -params.learning_rate * g[used].sum() / (h[used].sum() + params.reg_lambda)
                        children.append((place, side))
                    leaves += 1
                level = [side for _, side in sorted(children, key=lambda c: c[0])]
            margins[:, k] += value
    return margins


@pytest.mark.parametrize("params", [bo.Params(num_leaves=7, max_depth=3, learning_rate=0.2, min_child_samples=10), bo.Params(num_leaves=5, max_depth=4, learning_rate=0.1, min_child_samples=5, subsample=0.7, colsample_bytree=0.7, reg_lambda=1.0)])
def test_equals_a_plain_version(spark, seasons, params):
    some = seasons.head(240)
    df = spark.createDataFrame(some).repartition(3)
    bins = bo.find_bins(df, FEATURES, ["HomeTeam"])
    data = bo.blocks(df, bins, "label", "part", "match_id")
    fits = [bo.Fit((0, 1, 2), frozenset([0, 1])), bo.Fit((1, 2), frozenset([0, 1])), bo.Fit((0,), frozenset([1]))]
    found, state = bo.boost(data, bins, fits, params, 12, seed=5)
    matrix = bins.matrix({name: some[name].to_list() for name in FEATURES})
    for f, fit in enumerate(fits):
        rows = some["part"].isin(fit.learn).to_numpy()
        expected = plain_boost(matrix[rows], some["label"].to_numpy()[rows], some["match_id"].to_numpy()[rows], list(fit.features), [True, False, False], params, 12, 5, f)
        assert np.allclose(found[f].margins(matrix[rows]), expected, atol=1e-7)
    # The blocks carry the same margins.
    total = sum(b.margins[0].sum(axis=0) for b in state.collect())
    assert np.allclose(total, found[0].margins(matrix).sum(axis=0))


def test_judged_and_probabilities_agree(spark, seasons):
    df = spark.createDataFrame(seasons)
    bins = bo.find_bins(df, FEATURES, ["HomeTeam"])
    fits = [bo.Fit((0, 1, 2), frozenset([0, 1, 2])), bo.Fit((1,), frozenset([9]))]
    found, state = bo.boost(bo.blocks(df, bins, "label", "part", "match_id"), bins, fits, bo.Params(max_depth=3, num_leaves=7), 20)
    (loss, brier), (even, _), (none, _) = bo.judged(state, [4, 4], 1e-15) + bo.judged(state, [77, 4], 1e-15)[:1]
    out = bo.with_probabilities(df.filter("part = 4"), found[0], bins, ["h", "d", "a"]).toPandas()
    chance = out[["h", "d", "a"]].to_numpy()
    assert loss == pytest.approx(-np.log(chance[np.arange(len(out)), out["label"]]).mean())
    assert brier == pytest.approx(((chance - np.eye(3)[out["label"]]) ** 2).sum(axis=1).mean())
    assert even == pytest.approx(math.log(3)) and math.isnan(none) and loss < math.log(3)


def test_rare_and_unknown_categories_share_a_bin(spark):
    df = spark.range(2000).select(F.concat(F.lit("club "), F.when(F.col("id") < 1000, F.col("id") % 200).otherwise(F.col("id"))).alias("c"))
    bins = bo.find_bins(df, ["c"], ["c"])
    assert len(bins.codes["c"]) == bo.CATEGORY_BINS - 1
    assert bins.matrix({"c": ["club 3", "unheard of", None]}).tolist() == [[bins.codes["c"]["club 3"]], [255], [255]]


@pytest.mark.parametrize("kind", models.KINDS)
def test_categories_do_not_carry_their_own_result(spark, kind):
    """Outcomes are random and names almost unique: nothing can be learnt, and training rows must not look as if."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"HomeTeam": [f"club {i}" for i in rng.integers(0, 400, 1200)], "FTR": rng.choice(list("HDA"), 1200), "x": rng.normal(size=1200)})
    data = models.encode(spark.createDataFrame(pdf), ["HomeTeam"])
    model = models.fit_model(data, ["HomeTeam", "x"], {"max_depth": 3, "num_leaves": 7, "min_child_samples": 40, "learning_rate": 0.05, "reg_lambda": 1.0}, kind, trees=10)
    fresh = pdf.assign(FTR=rng.choice(list("HDA"), 1200))
    columns = [F.col(p) for p in models.MODEL_PROBS]
    chosen = F.when(F.col("FTR") == "H", columns[0]).when(F.col("FTR") == "D", columns[1]).otherwise(columns[2])
    (loss,) = model.probabilities(spark.createDataFrame(fresh)).agg(F.avg(-F.ln(F.greatest(chosen, F.lit(1e-12))))).first()
    assert abs(loss - math.log(3)) < 0.06


def test_equal_rows_share_their_margins(spark):
    """Margins are kept for the rows that differ, not for every row; equal rows lie in one block."""
    df = spark.range(200_000).select((F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 5).alias("c"),
                                     F.pmod(F.xxhash64("id"), F.lit(3)).alias("label"), (F.col("id") % 2).alias("part"), "id")
    bins = bo.find_bins(df, ["x", "c"], ["c"])
    data = bo.blocks(df, bins, "label", "part", "id", together=True)
    _, state = bo.boost(data, bins, [bo.Fit((0, 1), frozenset([0]))], bo.Params(subsample=0.7, max_depth=2, num_leaves=4), 3)
    blocks = state.collect()
    assert sum(len(b.label) for b in blocks) == 200_000 and all(len(b.label) <= bo.BLOCK_ROWS for b in blocks)
    # Seven numbers, five categories, three classes and two parts; a cell may be cut by the ends of a block.
    assert sum(len(own) for b in blocks for own in b.scores) <= 210 + 6 * len(blocks)
