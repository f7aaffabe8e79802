"""Near duplicates by SimHash: segment popcounts as grid coordinates, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from matchform.llm.components import components, forest
from matchform.llm.texts import NO_ID, column_of, keyed, public_id
from matchform.session import checkpointed

SEED = 42
# Bits are counted in 32 segments of two; the segments lie in this many grid blocks.
BLOCKS = 7
SEGMENT_LOW_BITS = 0x5555555555555555
# Fingerprints of one grid cell that one task compares; larger cells are compared part by part.
PART = 4096


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, lowest first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at : at + (1 << 14)]
        flat = np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little")
        total += np.add.reduce(flat, axis=0, dtype=np.int32)
    return total


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.packbits(2 * _bits(hashes) > len(hashes), bitorder="little")
    return int(ones.view(np.uint64)[0])


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of the lower-cased shingles of a text; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    stops = np.cumsum([len(w) + 1 for w in parts]) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    if len(parts) >= words:
        starts, stops = starts[: len(parts) - words + 1], stops[words - 1 :]
    else:
        starts, stops = starts[:1], stops[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts)
    )
    return majority(hashes)


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id``, ``version`` and ``bits`` (the fingerprint as a signed long) of every ``keyed`` document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_of(batch, "text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, batch.num_rows)
            names = ["doc_id", "version", "bits"]
            yield pa.RecordBatch.from_arrays([*(column_of(batch, n) for n in names[:2]), pa.array(found.view(np.int64))], names)

    return keyed(documents).mapInArrow(run, "doc_id long, version long, bits long")


def cell_masks(distance: int, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of the block sets of which at least one agrees for every pair within ``distance``.

    Each segment whose counts differ adds at least one to the Manhattan distance of two count
    vectors, which is at most the Hamming distance. So at most ``distance`` blocks differ, and the
    counts of ``blocks - distance`` blocks are equal.
    """
    if not 0 <= distance < blocks:
        raise ValueError("distance must be at least 0 and below the number of blocks")
    edges = [64 * i // blocks // 2 * 2 for i in range(blocks)] + [64]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _compare(cells: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints of equal cells within ``distance``; rows are sorted by cell and popcount."""
    weight = np.bitwise_count(bits).astype(np.int16)
    at = np.arange(len(bits) - 1)
    left, right, held, root = [], [], 0, None
    step = 1
    while len(at):
        # A pair's popcounts differ by no more than its distance, so a row's range ends early.
        at = at[at + step < len(bits)]
        at = at[(cells[at] == cells[at + step]) & (weight[at + step] - weight[at] <= distance)]
        near = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= distance]
        left.append(near)
        right.append(near + step)
        held += len(near)
        if held > 1 << 20:
            root = forest(len(bits), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(root != np.arange(len(bits)))
            left, right, held = [moved], [root[moved]], len(moved)
        step += 1
    if not held:
        return at[:0], at[:0]
    root = forest(len(bits), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(root != np.arange(len(bits)))
    return moved, root[moved]


def _in_cells(distance: int, part: int):
    """Links inside whole cells; the rows of a larger cell are passed on in parts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.string()), ("part", pa.int32()), ("bits", pa.list_(pa.int64()))])

    def links(cells, bits):
        u, v = _compare(cells, bits.view(np.uint64), distance)
        nothing = pa.nulls(len(u))
        return pa.RecordBatch.from_arrays(
            [pa.array(bits[u]), pa.array(bits[v]), nothing.cast(pa.string()), nothing.cast(pa.int32()), nothing.cast(schema.field(4).type)],
            schema=schema,
        )

    def parts(keys, number, bits):
        name = [f"{keys[0]}:{keys[1]}"]
        nothing = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays(
            [nothing, nothing, pa.array(name), pa.array([number], pa.int32()), pa.array([bits.tolist()], schema.field(4).type)], schema=schema
        )

    def run(batches):
        combo, cell, bits = (np.empty(0, np.int64) for _ in range(3))
        number = 0
        for batch in batches:
            combo, cell, bits = (
                np.concatenate((old, column_of(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)))
                for old, name in ((combo, "combo"), (cell, "cell"), (bits, "bits"))
            )
            new = np.flatnonzero((combo[1:] != combo[:-1]) | (cell[1:] != cell[:-1])) + 1
            bounds = np.concatenate(([0], new))
            tail = bounds[-1]
            # Cells that began and ended here; the last one may go on.
            if number and len(new):
                yield parts((combo[0], cell[0]), number, bits[: new[0]])
                bounds, number = bounds[1:], 0
            sizes = np.diff(bounds)
            for i in np.flatnonzero(sizes > part):
                for n, at in enumerate(range(bounds[i], bounds[i + 1], part)):
                    yield parts((combo[bounds[i]], cell[bounds[i]]), n, bits[at : min(at + part, bounds[i + 1])])
            if len(sizes):
                small = np.repeat(np.where(sizes <= part, np.arange(len(sizes)), -1), sizes)
                rows = np.flatnonzero(small >= 0)
                yield links(small[rows], bits[bounds[0] : tail][rows])
            combo, cell, bits = combo[tail:], cell[tail:], bits[tail:]
            while len(bits) > 2 * part:
                yield parts((combo[0], cell[0]), number, bits[:part])
                number += 1
                combo, cell, bits = combo[part:], cell[part:], bits[part:]
        if number:
            yield parts((combo[0], cell[0]), number, bits)
        elif len(bits) > part:
            yield parts((combo[0], cell[0]), 0, bits[:part])
            yield parts((combo[0], cell[0]), 1, bits[part:])
        elif len(bits):
            yield links(np.zeros(len(bits)), bits)

    return run


def _across(distance: int):
    """Links of two parts of a cell, or inside one."""

    def run(batches):
        for batch in batches:
            for mine, theirs in zip(column_of(batch, "bits").to_pylist(), column_of(batch, "other").to_pylist()):
                both = np.unique(np.array([*mine, *theirs], np.int64)).view(np.uint64)
                both = both[np.argsort(np.bitwise_count(both), kind="stable")]
                u, v = _compare(np.zeros(len(both)), both, distance)
                yield pa.RecordBatch.from_arrays([pa.array(both[u].view(np.int64)), pa.array(both[v].view(np.int64))], ["a", "b"])

    return run


def links(bits: DataFrame, distance: int = 4, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """Pairs ``a``, ``b`` that connect all distinct ``bits`` within ``distance`` of each other.

    Fingerprints are embedded as bit counts of two-bit segments. Grid cells are the counts of some of
    the blocks, chosen so that every pair within ``distance`` shares a cell; inside a cell the total
    count bounds the range that is compared, and each candidate is verified bit by bit. A cell yields a
    spanning forest of its links, never all pairs. A cell above ``part`` rows is written in parts
    ordered by popcount, and every two parts that can hold a pair are compared in a task of their own.
    """
    # The count of a segment's two bits, again in two bits: their exclusive or, and their conjunction above it.
    low, upper = F.lit(SEGMENT_LOW_BITS), F.shiftrightunsigned("bits", 1)
    embedded = (
        F.col("bits").bitwiseXOR(upper).bitwiseAND(low)
        .bitwiseOR(F.shiftleft(F.col("bits").bitwiseAND(upper).bitwiseAND(low), 1))
    )
    masks = F.array(*[F.lit(m) for m in cell_masks(distance, blocks)])
    grid = (
        bits.select("bits", embedded.alias("counts"))
        .select("bits", "counts", F.posexplode(masks).alias("combo", "mask"))
        .select("combo", F.col("counts").bitwiseAND(F.col("mask")).alias("cell"), "bits")
    )
    tasks = int(bits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grid.repartition(tasks, "combo", "cell").sortWithinPartitions("combo", "cell", F.bit_count("bits"), "bits")
    found = checkpointed(
        dealt.mapInArrow(_in_cells(distance, part), "a long, b long, cell string, part int, bits array<long>")
    )
    parts = found.where("cell is not null").select("cell", "part", "bits").withColumns(
        {"low": F.array_min(F.transform("bits", F.bit_count)), "high": F.array_max(F.transform("bits", F.bit_count))}
    )
    other = parts.select("cell", *[F.col(c).alias(f"{c}_") for c in ("part", "low", "high")], F.col("bits").alias("other"))
    near = (F.col("part") <= F.col("part_")) & (F.col("low_") <= F.col("high") + distance) & (F.col("low") <= F.col("high_") + distance)
    pairs = parts.join(other, "cell").where(near).select("bits", "other")
    pairs = pairs.repartition(tasks, F.xxhash64("bits", "other"))
    return found.where("a is not null").select("a", "b").union(pairs.mapInArrow(_across(distance), "a long, b long"))


def _components(documents: DataFrame, distance: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all documents, and the ``root`` fingerprint and smallest id of every fingerprint."""
    prints = checkpointed(fingerprints(documents, words))
    classes = checkpointed(prints.groupBy("bits").agg(F.min(F.struct("doc_id", "version")).alias("least")))
    roots = components(links(classes.select("bits"), distance))
    joined = classes.join(roots, classes["bits"] == roots["node"], "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    return prints, joined


def near_duplicates(documents: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    Equal fingerprints meet before any comparison, so copies cost nothing. ``component_id`` is the
    smallest id of the component; documents without an id are never the smallest, and a component of
    such documents alone has a null one. A null text has no words and the fingerprint zero. Repeated rows
    stay, ties in the id do not matter, an empty table gives an empty result, and columns other than
    ``doc_id`` and ``text`` are ignored.
    """
    prints, joined = _components(documents, distance, words)
    least = joined.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    named = joined.select("bits", "root").join(least, "root").select("bits", "component_id")
    return public_id(
        prints.join(named, "bits").select(
            "doc_id",
            F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
            F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"),
        )
    )


def first_rows(documents: DataFrame, joined: DataFrame) -> DataFrame:
    """The documents, with all their columns, that come first under a ``root`` (by ``least``): one row of each.

    The first has the smallest id (null last), then the smallest hash of the text; of rows equal in both
    any one stays.
    """
    first = joined.groupBy("root").agg(F.min("least").alias("of")).select(F.col("of.doc_id").alias("own_id"), F.col("of.version").alias("own_version"))
    own_id = F.coalesce(F.col("d.doc_id").cast("long"), F.lit(NO_ID))
    own_version = F.xxhash64(F.coalesce(F.col("d.text").cast("string"), F.lit("")))
    joined = documents.alias("d").join(first.alias("f"), (own_id == F.col("f.own_id")) & (own_version == F.col("f.own_version")))
    place = F.row_number().over(W.partitionBy("f.own_id", "f.own_version").orderBy("f.own_id"))
    numbered = joined.select(F.struct("d.*").alias("row"), place.alias("place"))
    return numbered.where("place = 1").select("row.*")
