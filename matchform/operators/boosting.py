"""Softmax boosting on histograms: one model for all outcomes, many fits side by side.

Rows are binned once into blocks. A round adds one tree per class to every fit; a level of all those trees is one
Spark job, which adds up gradients, hessians and counts by fit, class, node, feature and bin over the blocks. Only
these sums reach the driver: their size depends on the fits and bins, never on the rows. Rows of a block that agree in
a fit's bins, class and group have one margin at all times, so a fit's margins are kept for those cells, and a round's
sample is the number of rows it takes of each. The blocks are checkpointed every few rounds. Categories have bins of
their own, ordered in every node by their gradient ratio, so no row's own result stands in its features.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from matchform.session import checkpointed

CLASSES = 3
# Bins of a number; of a category, whose rarer values share the last one.
NUMBER_BINS, CATEGORY_BINS = 64, 256
# Rows of a block, rounds between checkpoints, partial sums added before they reach the driver.
BLOCK_ROWS, CHECKPOINT_ROUNDS, FAN_IN = 1 << 16, 10, 16
# Rows (times fits) that make a task of its own worth it.
TASK_ROWS = 1 << 15
LEAST_HESSIAN = 1e-3
# Added to a category's hessian where categories are ordered, and to a side's where they are split.
CATEGORY_SMOOTH, CATEGORY_PENALTY = 10.0, 10.0


@dataclass(frozen=True)
class Bins:
    """Edges of numbers and codes of categories."""

    features: tuple[str, ...]
    edges: Mapping[str, np.ndarray]
    codes: Mapping[str, Mapping[str, int]]

    def matrix(self, columns: Mapping[str, Sequence]) -> np.ndarray:
        """A bin for every row and feature."""
        size = len(columns[self.features[0]])
        found = np.empty((size, len(self.features)), np.uint8)
        for j, name in enumerate(self.features):
            if name in self.codes:
                code = self.codes[name]
                found[:, j] = [code.get(v, CATEGORY_BINS - 1) for v in columns[name]]
            else:
                found[:, j] = np.searchsorted(self.edges[name], np.asarray(columns[name], float))
        return found

    @property
    def categorical(self) -> np.ndarray:
        return np.array([name in self.codes for name in self.features])


def find_bins(rows: DataFrame, features: Sequence[str], categories: Sequence[str]) -> Bins:
    """Bins of the features in ``rows``; quantiles of numbers and the most frequent categories reach the driver."""
    numbers = [f for f in features if f not in categories]
    shares = [k / NUMBER_BINS for k in range(1, NUMBER_BINS)]
    found = rows.select(*[F.col(f).cast("double") for f in numbers]).approxQuantile(numbers, shares, 1e-3) if numbers else []
    edges = {name: np.unique(np.array(values, float)) for name, values in zip(numbers, found)}
    codes = {}
    for name in features:
        if name in categories:
            top = rows.groupBy(F.col(name).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(CATEGORY_BINS - 1)
            codes[name] = {r.v: k for k, r in enumerate(top.collect())}
    return Bins(tuple(features), edges, codes)


@dataclass(frozen=True)
class Cells:
    """Rows of a block that agree in some features, class and group: one row of each cell, and the cell of every row."""

    first: np.ndarray
    of_row: np.ndarray

    def counts(self, rows: np.ndarray | None = None) -> np.ndarray:
        """How many rows, or of the given ones, each cell has."""
        return np.bincount(self.of_row if rows is None else self.of_row[rows], minlength=len(self.first))


@dataclass(frozen=True)
class Block:
    """Binned rows with their class, group and key; cells by features, their margins by fit and a round's sample of them."""

    bins: np.ndarray
    label: np.ndarray
    group: np.ndarray
    key: np.ndarray
    cells: Mapping[tuple[int, ...], Cells] | None = None
    scores: Sequence[np.ndarray] | None = None
    sample: Mapping[tuple[int, ...], np.ndarray] | None = None
    used: Sequence[tuple[int, ...]] = ()

    @property
    def margins(self) -> list[np.ndarray]:
        """The margins of every row, by fit."""
        return [own[self.cells[features].of_row] for features, own in zip(self.used, self.scores)]


def cells_of(block: Block, features: Sequence[int]) -> Cells:
    code = block.group.astype(np.int64) * CLASSES + block.label
    for f in features:
        if len(code) and np.abs(code).max() >= 1 << 50:
            code = np.unique(code, return_inverse=True)[1]
        code = code * CATEGORY_BINS + block.bins[:, f]
    _, first, of_row = np.unique(code, return_index=True, return_inverse=True)
    return Cells(first.astype(np.int32), of_row.astype(np.min_scalar_type(max(len(first) - 1, 0))))


def blocks(rows: DataFrame, bins: Bins, label: str, group: str, key: str, together: bool = False) -> RDD:
    """Blocks of ``rows``, written once: ``label`` is 0 to 2, ``group`` a small number, ``key`` tells rows apart.

    ``together`` sorts the rows by their bins first, so that equal ones share a block: worth it where one fit uses all features.
    """
    kinds = {"__label": np.int8, "__group": np.int32, "__key": np.int64}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch[n].to_pylist() if n in bins.codes else batch[n].to_numpy(zero_copy_only=False) for n in bins.features}
            width = pa.binary(len(bins.features))
            found = pa.FixedSizeBinaryArray.from_buffers(width, batch.num_rows, [None, pa.py_buffer(bins.matrix(columns).tobytes())])
            others = [pa.array(batch[n].to_numpy(zero_copy_only=False).astype(t)) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([found.cast(pa.binary()), *others], ["__bins", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            matrix = np.frombuffer(b"".join(table["__bins"].to_pylist()), np.uint8).reshape(table.num_rows, len(bins.features))
            parts = (matrix, *(table[n].to_numpy().astype(t) for n, t in kinds.items()))
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], ["data"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(at, BLOCK_ROWS))
                if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                    yield packed()
                    held = []
        if held:
            yield packed()

    named = [F.col(f).cast("string" if f in bins.codes else "double").alias(f) for f in bins.features]
    source = rows.select(*named, F.col(label).alias("__label"), F.col(group).alias("__group"), F.col(key).cast("long").alias("__key"))
    source = source.mapInArrow(binned, "__bins binary, __label byte, __group int, __key long")
    if together:
        # Twice as many parts as cores; each is read block by block, whatever its size.
        source = source.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "__bins").sortWithinPartitions("__bins")
    return checkpointed(source.mapInArrow(run, "data binary")).rdd.map(lambda row: Block(*pickle.loads(row.data)))


@dataclass(frozen=True)
class Fit:
    """One model to fit: which features it may use and from which groups of rows it learns."""

    features: tuple[int, ...]
    learn: frozenset[int]


@dataclass(frozen=True)
class Params:
    """Parameters of all fits of a call, with the defaults of the published learner."""

    num_leaves: int = 31
    max_depth: int | None = None
    learning_rate: float = 0.1
    min_child_samples: int = 20
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    reg_lambda: float = 0.0

    @property
    def depth(self) -> int:
        """Trees grow level by level: no deeper than ``max_depth``, nor than so many leaves can fill."""
        full = max(1, ceil(np.log2(self.num_leaves)))
        return full if self.max_depth is None or self.max_depth < 1 else min(self.max_depth, full)


@dataclass
class Tree:
    """Nodes in heap order: the feature a node is split by (-1: none), which bins go left, and a leaf's value."""

    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros((size, CATEGORY_BINS), bool), np.zeros(size))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node each row is in after ``depth`` levels."""
        node = np.zeros(len(bins), np.int64)
        row = np.arange(len(bins))
        for _ in range(depth):
            feature = self.feature[node]
            goes = self.left[node, bins[row, np.maximum(feature, 0)]]
            node = np.where(feature >= 0, 2 * node + 2 - goes, node)
        return node


@dataclass
class Ensemble:
    """A fitted model: the margins it starts from, and a tree for each class in every round."""

    start: np.ndarray
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        total = np.tile(self.start, (len(bins), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                total[:, k] += tree.value[tree.nodes(bins, self.depth)]
        return total


def softmax(margins: np.ndarray) -> np.ndarray:
    weights = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return weights / weights.sum(axis=-1, keepdims=True)


def taken(key: np.ndarray, share: float, number: int) -> np.ndarray:
    """The rows a round's sample takes, by a hash of their key and the round's number."""
    x = key.astype(np.uint64) + np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)) / 2.0**53 < share


def _gradients(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chance = softmax(margins)
    return chance - np.eye(CLASSES)[label], chance * (1 - chance) * CLASSES / (CLASSES - 1)


def _width(fit: Fit, bins: Bins) -> int:
    """Bins that the sums of a fit have room for."""
    return CATEGORY_BINS if bins.categorical[list(fit.features)].any() else NUMBER_BINS


def _level_sums(block: Block, fits: Sequence[Fit], trees: Sequence[list[Tree]], level: int, widths: Sequence[int]) -> np.ndarray:
    """Sums of a block, flat: by fit, class, node of the level, feature of the fit and bin; gradient, hessian, count."""
    parts, first, nodes = [], 2**level - 1, 2**level
    for f, (fit, width) in enumerate(zip(fits, widths)):
        row, times = block.cells[fit.features].first, block.sample[fit.features]
        at = np.flatnonzero((times > 0) & np.isin(block.group[row], list(fit.learn)))
        row, times = row[at], times[at].astype(float)
        bins = block.bins[row]
        gradient, hessian = _gradients(block.scores[f][at], block.label[row])
        used = len(fit.features)
        own = bins[:, fit.features].astype(np.int64) + np.arange(used) * width
        for k in range(CLASSES):
            node = trees[f][k].nodes(bins, level) - first
            here = node >= 0
            cell = (node[here, None] * used * width + own[here]).ravel()
            for weight in (gradient[here, k] * times[here], hessian[here, k] * times[here], times[here]):
                parts.append(np.bincount(cell, np.repeat(weight, used), minlength=nodes * used * width))
    return np.concatenate(parts)


def _summed(sums: RDD) -> np.ndarray:
    """Added up in the executors first where there are many partitions."""
    return sums.treeReduce(np.add, depth=2 if sums.getNumPartitions() > FAN_IN else 1)


def best_splits(sums: np.ndarray, features: np.ndarray, categorical: np.ndarray, params: Params) -> tuple[np.ndarray, ...]:
    """For every node the gain, feature and bins that go left of its best split; ``sums`` is (3, node, feature, bin)."""
    gradient, hessian, count = sums
    order = np.tile(np.arange(CATEGORY_BINS), (*gradient.shape[:2], 1))
    if categorical.any():
        # Bins without rows come last and so never part others.
        ratio = np.where(count > 0, gradient / (hessian + CATEGORY_SMOOTH), np.inf)
        order[:, categorical] = np.argsort(ratio, axis=2, kind="stable")[:, categorical]
    left = [np.cumsum(np.take_along_axis(v, order, 2), axis=2) for v in (gradient, hessian, count)]
    total = [v[:, :, -1:] for v in left]
    right = [t - v for t, v in zip(total, left)]
    penalty = params.reg_lambda + CATEGORY_PENALTY * categorical[None, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(side[0] ** 2 / (side[1] + penalty) for side in (left, right)) - total[0] ** 2 / (total[1] + params.reg_lambda)
    # Splits that part the rows alike tie, whatever the order their sums were added in.
    gain = np.round(gain, 9)
    good = np.isfinite(gain) & (gain > 0)
    for side in (left, right):
        good &= (side[2] >= params.min_child_samples) & (side[1] >= LEAST_HESSIAN)
    gain = np.where(good, gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    node = np.arange(len(flat))
    feature, cut = np.divmod(best, CATEGORY_BINS)
    goes = np.zeros((len(flat), CATEGORY_BINS), bool)
    np.put_along_axis(goes, order[node, feature], np.arange(CATEGORY_BINS) <= cut[:, None], 1)
    return flat[node, best], features[feature], goes


def _grow(tree: Tree, sums: np.ndarray, level: int, open_nodes: list[int], fit: Fit, columns: list[int], bins: Bins, params: Params, leaves: int) -> tuple[list[int], int]:
    """Split the nodes of a level, best gains first, while leaves are left; gives the children and the leaves now."""
    first = 2**level - 1
    at = [n - first for n in open_nodes]
    features = np.array(fit.features)[columns]
    picked = sums[:, at][:, :, columns]
    gain, feature, goes = best_splits(picked, features, bins.categorical[features], params)
    children = []
    for i in sorted(range(len(at)), key=lambda i: (-gain[i], at[i])):
        if not np.isfinite(gain[i]) or leaves >= params.num_leaves:
            break
        node = open_nodes[i]
        tree.feature[node], tree.left[node] = feature[i], goes[i]
        column = columns[int(np.flatnonzero(features == feature[i])[0])]
        for child, side in ((2 * node + 1, goes[i]), (2 * node + 2, ~goes[i])):
            gradient, hessian = sums[0, at[i], column][side].sum(), sums[1, at[i], column][side].sum()
            tree.value[child] = -params.learning_rate * gradient / (hessian + params.reg_lambda + 1e-12)
            children.append(child)
        leaves += 1
    return sorted(children), leaves


def _started(block: Block, fits: Sequence[Fit], starts: np.ndarray) -> Block:
    """A block with the cells of every fit, all at the margins they start from."""
    cells = {features: cells_of(block, features) for features in dict.fromkeys(fit.features for fit in fits)}
    scores = [np.tile(start, (len(cells[fit.features].first), 1)) for fit, start in zip(fits, starts)]
    return replace(block, cells=cells, scores=scores, used=[fit.features for fit in fits])


def _sampled(block: Block, share: float, number: int) -> Block:
    """The block with the rows of each cell that the sample of a round takes."""
    rows = np.flatnonzero(taken(block.key, share, number)) if share < 1 else None
    return replace(block, sample={features: cells.counts(rows) for features, cells in block.cells.items()})


def _advanced(block: Block, fits: Sequence[Fit], trees: Sequence[list[Tree]], depth: int) -> Block:
    scores = []
    for fit, own, grown in zip(fits, block.scores, trees):
        bins = block.bins[block.cells[fit.features].first]
        scores.append(own + np.stack([tree.value[tree.nodes(bins, depth)] for tree in grown], axis=1))
    return replace(block, scores=scores)


def boost(data: RDD, bins: Bins, fits: Sequence[Fit], params: Params, trees: int, seed: int = 42) -> tuple[list[Ensemble], RDD]:
    """Fit all ``fits`` side by side; returns their models, and the blocks with the margins of all of them.

    Trees grow level by level with at most ``num_leaves`` leaves. ``subsample`` takes rows by a hash of their key and
    the round, ``colsample_bytree`` a seeded choice of features for every tree. A fit whose rows never split keeps the
    class frequencies it starts from. A fit without rows starts from even ones.
    """
    counted = data.map(lambda b: np.stack([np.stack([((b.label == k) & np.isin(b.group, list(f.learn))).sum() for k in range(CLASSES)]) for f in fits]))
    counts = _summed(counted) + 1e-9
    # Little work goes to few tasks: a round is a handful of jobs, and each of their tasks costs its start.
    work = data.map(lambda b: len(b.label)).sum() * len(fits)
    data = data.coalesce(max(1, min(data.getNumPartitions(), ceil(work / TASK_ROWS))))
    starts = np.log(counts / counts.sum(axis=1, keepdims=True))
    models, widths, share, past = [Ensemble(start, params.depth) for start in starts], [_width(fit, bins) for fit in fits], params.subsample, None
    state = data.map(lambda b: _sampled(_started(b, fits, starts), share, seed << 20)).persist(StorageLevel.MEMORY_AND_DISK)
    for number in range(trees):
        grown = [[Tree.empty(params.depth) for _ in range(CLASSES)] for _ in fits]
        chosen = [[_columns(len(fit.features), params.colsample_bytree, f"{seed} {f} {number} {k}") for k in range(CLASSES)] for f, fit in enumerate(fits)]
        open_nodes = [[[0] for _ in range(CLASSES)] for _ in fits]
        leaves = [[1] * CLASSES for _ in fits]
        for level in range(params.depth):
            if not any(nodes for own in open_nodes for nodes in own):
                break
            flat = _summed(state.map(lambda b, trees=grown, level=level: _level_sums(b, fits, trees, level, widths)))
            if past is not None:
                # The round's first job has moved the margins on; the blocks before are needed no more.
                past.unpersist()
                past = None
            at = 0
            for f, fit in enumerate(fits):
                shape = (3, 2**level, len(fit.features), widths[f])
                for k in range(CLASSES):
                    own = flat[at : at + int(np.prod(shape))].reshape(shape)
                    at += own.size
                    if open_nodes[f][k]:
                        own = np.pad(own, [(0, 0)] * 3 + [(0, CATEGORY_BINS - widths[f])])
                        open_nodes[f][k], leaves[f][k] = _grow(grown[f][k], own, level, open_nodes[f][k], fit, chosen[f][k], bins, params, leaves[f][k])
        for model, own in zip(models, grown):
            model.rounds.append(own)
        past = state
        state = state.map(lambda b, trees=grown, now=(seed << 20) + number + 1: _sampled(_advanced(b, fits, trees, params.depth), share, now)).persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % CHECKPOINT_ROUNDS == 0 or number == trees - 1:
            state.checkpoint()
            state.foreach(lambda _: None)
            past.unpersist()
            past = None
    return models, state


def _columns(count: int, share: float, seed: str) -> list[int]:
    """A tree's choice of features."""
    return list(range(count)) if share >= 1 else sorted(random.Random(seed).sample(range(count), max(1, ceil(share * count))))


def judged(state: RDD, judges: Sequence[int], eps: float) -> list[tuple[float, float]]:
    """Mean log loss and Brier score of every fit on its own group of rows; without rows both are NaN."""

    def sums(block: Block) -> np.ndarray:
        found = np.zeros((len(judges), 3))
        for f, group in enumerate(judges):
            cells = block.cells[block.used[f]]
            at = np.flatnonzero(block.group[cells.first] == group)
            label, times = block.label[cells.first[at]], cells.counts()[at]
            chance = softmax(block.scores[f][at])
            hit = np.clip(chance[np.arange(len(at)), label], eps, 1 - eps)
            found[f] = -(np.log(hit) * times).sum(), (((chance - np.eye(CLASSES)[label]) ** 2).sum(axis=1) * times).sum(), times.sum()
        return found

    total = _summed(state.map(sums))
    with np.errstate(invalid="ignore"):
        return [(float(a / n), float(b / n)) for a, b, n in total]


def with_probabilities(rows: DataFrame, model: Ensemble, bins: Bins, names: Sequence[str]) -> DataFrame:
    """Rows with the model's probabilities as columns ``names``."""
    schema = ", ".join(f"{n} double" for n in names)

    @F.pandas_udf(schema)
    def chances(features: pd.DataFrame) -> pd.DataFrame:
        columns = {f: features[f].to_numpy() for f in bins.features}
        return pd.DataFrame(softmax(model.margins(bins.matrix(columns))), columns=list(names))

    given = F.struct(*[F.col(f).cast("string" if f in bins.codes else "double").alias(f) for f in bins.features])
    return rows.withColumn("__chances", chances(given)).select(*rows.columns, *[F.col(f"__chances.{n}").alias(n) for n in names])
