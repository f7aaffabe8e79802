"""Three-outcome classifiers.

``boosted`` (the default) is softmax boosting on histograms, one model for all outcomes (``boosting``), with bins
for categories. ``forest`` and ``logistic`` are Spark ML's; parameters keep the names of the published search
space, and those a stage has no counterpart for are left out of it (see ``stage_params``).

For Spark ML's stages a category is replaced by how often its training rows ended in H and in A. The frequencies
are a relation with a row per category that is joined to the rows, so no list of names reaches the driver. A
training row is given the frequencies of the parts of the training rows it is not in, so never its own result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from math import ceil, log2

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from matchform.functions import scalars as S
from matchform.operators import boosting
from matchform.operators.scoring import MODEL_PROBS
from matchform.session import checkpointed

KINDS = ("boosted", "forest", "logistic")
DEFAULT_KIND = "boosted"
INTEGER_PARAMS = ("num_leaves", "max_depth", "min_child_samples")
DEFAULT_TREES = 150
LABEL = "__label"
VECTOR = "__features"


def clean_params(params: Mapping[str, float]) -> dict[str, float]:
    """Integer parameters as integers, without the sample's number.

    The number of trees is fixed by the caller, so naming it here too is an error.
    """
    if "n_estimators" in params:
        raise ValueError("n_estimators is set by the model, not by its parameters")
    return {
        name: int(value) if name in INTEGER_PARAMS and value is not None else value
        for name, value in params.items()
        if name != "param_id"
    }


def stage_params(kind: str, params: Mapping[str, float]) -> dict:
    """Spark settings for the given parameters.

    Trees: depth is limited by ``max_depth`` and by what ``num_leaves`` allows a full tree;
    ``reg_lambda`` and ``learning_rate`` have no counterpart. ``logistic`` has none of the tree parameters.
    """
    cleaned = clean_params(params)
    if kind == "logistic":
        return {}
    settings: dict = {}
    depths = []
    if cleaned.get("max_depth") is not None:
        depths.append(cleaned["max_depth"])
    if cleaned.get("num_leaves") is not None:
        depths.append(ceil(log2(cleaned["num_leaves"])))
    if depths:
        settings["maxDepth"] = min(depths)
    for name, target in (("min_child_samples", "minInstancesPerNode"), ("subsample", "subsamplingRate")):
        if cleaned.get(name) is not None:
            settings[target] = cleaned[name]
    columns = cleaned.get("colsample_bytree")
    if columns is not None:
        settings["featureSubsetStrategy"] = "all" if columns >= 1 else str(columns)
    return settings


def boosted_params(params: Mapping[str, float]) -> boosting.Params:
    """Parameters of ``boosted``: those given, and the learner's defaults."""
    return boosting.Params(**{name: value for name, value in clean_params(params).items() if value is not None})


# So many rows of evenly spread outcomes are added to each category's own.
PRIOR_ROWS = 10
# Parts of the training rows whose frequencies are counted apart.
RATE_PARTS = 5


@dataclass(frozen=True)
class Encoded:
    """Rows with their label, and which of their columns are categories."""

    rows: DataFrame
    categories: tuple[str, ...] = ()

    def only(self, rows: DataFrame) -> Encoded:
        return Encoded(rows, self.categories)


def encode(df: DataFrame, categorical: Sequence[str], result: str = "FTR") -> Encoded:
    """Add the label; nothing runs yet."""
    return Encoded(df.withColumn(LABEL, S.encode_outcome(F.col(result)).cast("double")), tuple(categorical))


def _rates(column: str) -> list[str]:
    return [f"__{column}_home", f"__{column}_away"]


def _part(rows: DataFrame):
    """The part a training row is in, by a hash of its columns."""
    return F.pmod(F.xxhash64(*sorted(c for c in rows.columns if not c.startswith("__"))), F.lit(RATE_PARTS)).cast("int")


def category_rates(train: DataFrame, column: str) -> DataFrame:
    """Per category the smoothed frequencies of H and A in ``train``, and its counts by part; one row each."""
    part, outcomes = _part(train), dict(zip(_rates(column), (0.0, 2.0)))

    def by_part(wanted):
        return F.array(*[F.sum(F.when(wanted & (part == k), 1.0).otherwise(0.0)) for k in range(RATE_PARTS)])

    shares = [
        ((F.sum(F.when(F.col(LABEL) == label, 1.0).otherwise(0.0)) + PRIOR_ROWS / 3) / (F.count("*") + PRIOR_ROWS)).alias(name)
        for name, label in outcomes.items()
    ]
    counts = [by_part(F.col(LABEL) == label).alias(f"{name}_parts") for name, label in outcomes.items()]
    return train.groupBy(F.col(column).alias(f"__{column}")).agg(*shares, *counts, by_part(F.lit(True)).alias(f"__{column}_parts"))


def with_rates(rows: DataFrame, column: str, rates: DataFrame, learning: bool = False) -> DataFrame:
    """Rows with their category's frequencies; a category that training did not have gets a third.

    ``learning`` rows are among those the frequencies were counted on: each is given what the other parts say.
    """
    joined = rows.join(rates, F.col(column).eqNullSafe(F.col(f"__{column}")), "left").drop(f"__{column}")
    temporary = [f"{name}_parts" for name in (*_rates(column), f"__{column}")]

    def others(name: str):
        counts = F.col(f"{name}_parts")
        return F.aggregate(counts, F.lit(0.0), lambda total, n: total + n) - F.get(counts, _part(rows))

    found = {}
    for name in _rates(column):
        rate = (others(name) + PRIOR_ROWS / 3) / (others(f"__{column}") + PRIOR_ROWS) if learning else F.col(name)
        found[name] = F.coalesce(rate, F.lit(1 / 3))
    return joined.withColumns(found).drop(*temporary)


@dataclass(frozen=True)
class OutcomeModel:
    """Fitted stages for one list of features."""

    kind: str
    rates: tuple[tuple[str, DataFrame], ...] = ()
    assemble: VectorAssembler | None = None
    model: Model | None = None
    boosted: tuple[boosting.Ensemble, boosting.Bins] | None = None

    def vectors(self, rows: DataFrame, learning: bool = False) -> DataFrame:
        """Rows with the vector of their features."""
        for column, rates in self.rates:
            rows = with_rates(rows, column, rates, learning)
        return self.assemble.transform(rows).drop(*[name for column, _ in self.rates for name in _rates(column)])

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """Rows with the probabilities of H, D and A."""
        if self.boosted is not None:
            return boosting.with_probabilities(rows, *self.boosted, MODEL_PROBS)
        rows = self.model.transform(self.vectors(rows))
        array = vector_to_array("probability")
        probs = [F.coalesce(F.get(array, F.lit(i)), F.lit(0.0)) for i in range(3)]
        return rows.withColumns(dict(zip(MODEL_PROBS, probs))).drop(VECTOR, "probability", "rawPrediction", "prediction")


def fit_model(
    train: Encoded,
    features: Sequence[str],
    params: Mapping[str, float],
    kind: str = DEFAULT_KIND,
    trees: int = DEFAULT_TREES,
    seed: int = 42,
) -> OutcomeModel:
    """Fit one classifier on encoded rows."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {KINDS}")
    if not features:
        raise ValueError("no features to fit on")
    if kind == "boosted":
        bins = boosting.find_bins(train.rows, features, [f for f in features if f in train.categories])
        keyed = train.rows.withColumns({"__group": F.lit(0), "__key": F.xxhash64(*features)})
        data = boosting.blocks(keyed, bins, LABEL, "__group", "__key", together=True)
        fit = boosting.Fit(tuple(range(len(bins.features))), frozenset([0]))
        fitted, state = boosting.boost(data, bins, [fit], boosted_params(params), trees, seed)
        state.unpersist()
        return OutcomeModel(kind, boosted=(fitted[0], bins))
    rates = tuple((f, checkpointed(category_rates(train.rows, f))) for f in features if f in train.categories)
    coded = dict(rates)
    inputs = [name for f in features for name in (_rates(f) if f in coded else [f])]
    unfitted = OutcomeModel(kind, rates, VectorAssembler(inputCols=inputs, outputCol=VECTOR))
    rows = unfitted.vectors(train.rows, learning=True).select(VECTOR, LABEL)
    common = {"featuresCol": VECTOR, "labelCol": LABEL}
    if kind == "forest":
        stage = RandomForestClassifier(seed=seed, numTrees=trees, **common, **stage_params(kind, params))
    else:
        penalty = params.get("reg_lambda") or 0.0
        strength = penalty / max(rows.count(), 1) if penalty else 0.0
        stage = LogisticRegression(family="multinomial", regParam=strength, **common)
    return replace(unfitted, model=stage.fit(rows))
