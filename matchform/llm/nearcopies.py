"""Near copies by Jaccard similarity of word shingles: SimHash grid, prefixes of a global order, exact verification, components.

SimHash fingerprints of the shingle sets that lie within four bits are found by the grid join of ``simhash`` and
compared exactly; these are most near copies, and all of large groups. What lies further apart is found by prefixes:
Two sets whose similarity is at least t share a member among the first n - ceil(t n) + 1 of each, in any one order
of all shingles. So no pair is missed, whatever the order; shingles that are frequent in a sample come last in it,
which keeps common passages from making candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from matchform.llm.components import components
from matchform.llm.decontaminate import FOLD
from matchform.llm.simhash import SEED, first_rows, links as grid_links, majority
from matchform.llm.texts import RangeHash, blocks, column_of, keyed, release, stored, text_bytes, word_spans
from matchform.session import checkpointed, with_settings

WORDS = 5
SIMILARITY = 0.8
# Distinct texts in which frequent shingles are looked for; they only set the order.
SAMPLE = 4096
# Bits by which the fingerprints of sets that are compared first may differ.
DISTANCE = 4
# Rounds in which a group of texts that share a shingle is compared with one of them, before all that is left.
STARS = 2
# Pairs, and bytes of sets, that are broadcast at most.
SMALL_ROWS, SMALL_BYTES = 1 << 18, 8 << 20
# Rows and bytes of sets that go to Python at once: a batch of pairs carries two sets each.
PAIRS_AT_ONCE = {"spark__sql__execution__arrow__maxRecordsPerBatch": "256", "spark__sql__execution__arrow__maxBytesPerBatch": str(4 << 20)}

# Members of two sets together above which the fixed sketch tells them apart too seldom: a pair of such sets is compared by
# sketches as wide as the sets before the sets themselves move.
LARGE = 1024

# Bits in which a set's members are counted modulo two, as longs: two sets differ in at least as many members as bits.
SKETCH = [f"bits{k}" for k in range(8)]

PRINTS = "doc_id long, version long, print long"
PREFIXES = "print long, prefix array<long>"
PAIRS = "a long, b long, of_a long, of_b long"


def word_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of every row's lower-cased shingles; a shorter text is its own shingle."""
    raw, ends = text_bytes(column)
    raw = FOLD[raw]
    starts, stops, first = word_spans(raw, ends)
    hashes = RangeHash(RangeHash(raw)(starts, stops))
    for a, b in pairwise(first.tolist()):
        width = min(words, b - a)
        at = np.arange(a, b - width + 1) if width else np.empty(0, np.int64)
        yield np.unique(hashes(at, at + width))


def print_of(members: np.ndarray) -> int:
    """One hash of a whole set, as a signed long."""
    value = xxhash.xxh64_intdigest(members.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def prefix(members: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first members, of which a set of at least this similarity shares one; frequent ones are last in the order."""
    if not len(members):
        return members
    rank = np.zeros(len(members), np.int64)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        rank = np.where(frequent[place] == members, counts[place], 0)
    size = len(members) - int(np.ceil(similarity * len(members) - 1e-9)) + 1
    return members[np.lexsort((members, rank))[:size]]


def sketch_of(members: np.ndarray) -> np.ndarray:
    odd = np.bincount((members % np.uint64(64 * len(SKETCH))).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def wide_sketch(members: np.ndarray) -> bytes:
    """The sketch in as many bits as there are members, in a power of two that is 512 at least."""
    size = max(512, 1 << (len(members) - 1).bit_length()) if len(members) else 512
    odd = np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def bits_apart(one: bytes, other: bytes) -> int:
    """Bits in which two wide sketches differ, the wider one folded to the other's width."""
    x, y = sorted((np.frombuffer(v, np.uint64) for v in (one, other)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _prints(documents: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = [print_of(s) for s in word_sets(column_of(batch, "text"), words)]
            names = ["doc_id", "version", "print"]
            yield pa.RecordBatch.from_arrays([*(column_of(batch, n) for n in names[:2]), pa.array(found, pa.int64())], names)

    return keyed(documents).mapInArrow(run, PRINTS)


def _frequent(documents: DataFrame, share: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in two or more of the sampled sets, one in ``share`` of all, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            for members in word_sets(column_of(batch, "text"), words):
                own = print_of(members)
                if own % share == 0 and len(members):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), own)), pa.array(members.view(np.int64))], ["print", "hash"])

    sets = keyed(documents).select("text").mapInArrow(run, "print long, hash long").distinct()
    rows = sets.groupBy("hash").count().where("count > 1").toArrow()
    hashes = rows["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["count"].to_numpy()[order]


def _prefixes(documents: DataFrame, frequent: np.ndarray, counts: np.ndarray, words: int, similarity: float) -> DataFrame:
    """For every set its print and prefix."""
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = list(word_sets(column_of(batch, "text"), words))
            first = [prefix(s, frequent, counts, similarity).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([print_of(s) for s in sets], pa.int64()), pa.array(first, lists)], ["print", "prefix"])

    return keyed(documents).select("text").mapInArrow(run, PREFIXES).dropDuplicates(["print"])


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Whole groups of equal ``hash``: the places where they begin (and the end), and the columns."""
    held = [np.empty(0, np.int64) for _ in names]
    for batch in batches:
        held = [np.concatenate((old, column_of(batch, n).to_numpy(zero_copy_only=False).astype(np.int64))) for old, n in zip(held, names)]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(held[0])) + 1))
        if len(starts) > 1:
            yield starts, [c[: starts[-1]] for c in held]
            held = [c[starts[-1] :] for c in held]
    if len(held[0]):
        yield np.concatenate(([0], np.flatnonzero(np.diff(held[0])) + 1, [len(held[0])])), held


def _several(starts: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Where groups begin and end that have several roots."""
    mixed = np.maximum.reduceat(root, starts[:-1]) != np.minimum.reduceat(root, starts[:-1])
    return list(zip(starts[:-1][mixed].tolist(), starts[1:][mixed].tolist()))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose shingle stands in the prefixes of two or more sets."""
    names = ["hash", "print"]
    for starts, columns in _groups(batches, names):
        sizes = np.diff(starts)
        keep = np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names)


def _candidates(turn: int | None, similarity: float):
    """Pairs of prints in groups with several roots: of one member (``a``) with all others, or (None) all that have different roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (_, own, size, root, *bits) in _groups(batches, ["hash", "print", "size", "root", *SKETCH]):
            bits = np.stack(bits).view(np.uint64)
            for a, b in _several(starts, root):
                roots, group, members = np.unique(root[a:b], return_inverse=True, return_counts=True)
                largest = int(np.argmax(members))
                if turn is None:
                    # A pair of other roots is met from both sides, the largest root's members from one.
                    centres = np.flatnonzero(group != largest)
                else:
                    inside = np.flatnonzero(group == largest)
                    centres = inside[[len(inside) * (2 * turn + 1) // (2 * STARS)]]
                for c in centres.tolist():
                    near = (root[a:b] != root[a + c]) & (size[a:b] >= similarity * size[a + c] - 1e-9) & (similarity * size[a:b] <= size[a + c] + 1e-9)
                    apart = np.bitwise_count(bits[:, a:b] ^ bits[:, a + c, None]).sum(axis=0, dtype=np.int64)
                    near &= (1 + similarity) * apart <= (1 - similarity) * (size[a:b] + size[a + c]) + 1e-6
                    if turn is None:
                        near &= (group == largest) | (own[a:b] > own[a + c])
                    other = own[a:b][near]
                    if len(other):
                        here, mine = (np.full(len(other), of[a + c]) for of in (own, size))
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (here, other, mine, size[a:b][near])], ["a", "b", "of_a", "of_b"])

    return run


def _sets(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``print``, ``size``, ``members``, ``wide`` sketch, ``simhash`` and sketch of the texts whose ``doc_id``, ``version`` and ``print`` are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = list(word_sets(column_of(batch, "text"), words))
            bits = np.array([sketch_of(s) for s in sets]).T
            members = pa.array([s.tobytes() for s in sets], pa.binary())
            wide = pa.array([wide_sketch(s) for s in sets], pa.binary())
            simhash = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([column_of(batch, "print"), pa.array([len(s) for s in sets], pa.int64()), members, wide, simhash, *map(pa.array, bits)], ["print", "size", "members", "wide", "simhash", *SKETCH])

    texts = keyed(documents).join(wanted, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]).select("print", "text")
    return texts.mapInArrow(run, ", ".join(["print long, size long, members binary, wide binary, simhash long", *(f"{name} long" for name in SKETCH)]))


def _small(frame: DataFrame, rows: int) -> DataFrame:
    """Broadcast where it has at most so many rows of a known width, else joined by a shuffle."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def _likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` with their sizes, which are looked up if missing, without those of large sets that wide sketches rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = column_of(batch, "of_a").to_numpy() + column_of(batch, "of_b").to_numpy()
            sketches = zip(column_of(batch, "wide_a").to_pylist(), column_of(batch, "wide_b").to_pylist())
            apart = np.array([bits_apart(x, y) for x, y in sketches], np.int64)
            near = (1 + similarity) * apart <= (1 - similarity) * size + 1e-6
            yield batch.select(["a", "b", "of_a", "of_b"]).filter(pa.array(near))

    if "of_a" not in pairs.columns:
        of = {side: sets.select(F.col("print").alias(side), F.col("size").alias(f"of_{side}")) for side in ("a", "b")}
        pairs = pairs.join(of["a"], "a").join(of["b"], "b").select("a", "b", "of_a", "of_b")
    sized = checkpointed(pairs)
    large = F.col("of_a") + F.col("of_b") > LARGE
    looked = sized.where(large)
    if looked.isEmpty():
        return sized
    for side in ("a", "b"):
        looked = looked.join(sets.select(F.col("print").alias(side), F.col("wide").alias(f"wide_{side}")), side)
    kept = looked.select("a", "b", "of_a", "of_b", "wide_a", "wide_b").mapInArrow(run, sized.schema)
    return sized.where(~large).union(kept)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, small: bool = False) -> DataFrame:
    """The pairs whose sets have at least this similarity.

    The sets of ``b`` are read where they lie. Those of ``a``, of which there are few (one for a group, mostly), come to
    them: broadcast where they and the pairs are known to be ``small`` or a check says so, else by a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (mine, theirs) in enumerate(zip(column_of(batch, "mine"), column_of(batch, "theirs"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (mine, theirs))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    centres = pairs.select(F.col("a").alias("print")).distinct()
    centres = F.broadcast(centres) if small else _small(centres, SMALL_ROWS)
    mine = sets.select("print", "members", "size").join(centres, "print").select(F.col("print").alias("a"), F.col("members").alias("mine"), "size")
    if small or (mine.agg(F.sum("size")).first()[0] or 0) * 8 <= SMALL_BYTES:
        mine = F.broadcast(mine)
    theirs = sets.select(F.col("print").alias("b"), F.col("members").alias("theirs")).join(F.broadcast(pairs) if small else _small(pairs, SMALL_ROWS), "b")
    return theirs.join(mine.drop("size"), "a").select("a", "b", "mine", "theirs").mapInArrow(run, "a long, b long")


def _extent(pairs: DataFrame) -> tuple[int, int, int]:
    """How many pairs there are, and the members of the sets of all their ``a``, and of both sides of all pairs."""
    centres = pairs.groupBy("a").agg(F.max("of_a").alias("size"), F.count(F.lit(1)).alias("pairs"), F.sum(F.col("of_a") + F.col("of_b")).alias("moved"))
    row = centres.agg(F.sum("pairs"), F.sum("size"), F.sum("moved")).first()
    return tuple(n or 0 for n in row)


def simhash_pairs(sets: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a``, ``b`` that connect all sets whose fingerprints lie within ``distance``: by the grid, equal ones by their first."""
    heads = checkpointed(sets.groupBy("simhash").agg(F.min("print").alias("head")))
    equal = sets.select("simhash", "print").join(heads, "simhash").where("print != head").select(F.col("head").alias("a"), F.col("print").alias("b"))
    near = checkpointed(grid_links(heads.select(F.col("simhash").alias("bits")), distance))
    for side in ("a", "b"):
        near = near.join(heads.select(F.col("simhash").alias(side), F.col("head").alias(f"{side}_head")), side)
    return equal.union(near.select(F.col("a_head").alias("a"), F.col("b_head").alias("b")))


def groups(documents: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``print``, ``least`` (first ``doc_id`` and ``version``) and ``root`` of every distinct set of shingles.

    Sets are linked where their Jaccard similarity is at least ``similarity``; texts with equal sets meet before any
    comparison. Sets whose SimHash fingerprints are near are compared first; then a group of sets that share a shingle
    is compared with one of its members, a few times over, so that a large group of near copies becomes one component by
    as many pairs as it has members; then all pairs that are still in different components are compared, so none is
    missed. Pairs whose sizes or sketches rule the similarity out are left out.
    """
    spark = documents.sparkSession
    classes = checkpointed(_prints(documents, words).groupBy("print").agg(F.min(F.struct("doc_id", "version")).alias("least")))
    frequent, counts = _frequent(documents, max(1, classes.count() // SAMPLE), words)
    # Rows of two longs: this is the largest shuffle, one row for every fifth word.
    rows = _prefixes(documents, frequent, counts, words, similarity).select(F.explode("prefix").alias("hash"), "print")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(frame: DataFrame, *order: str) -> DataFrame:
        return frame.repartition(tasks, "hash").sortWithinPartitions("hash", *order, "print")

    release(spark)
    shared = checkpointed(dealt(rows).mapInArrow(_shared, "hash long, print long"))
    release(spark)
    wanted = classes.join(shared.select("print").distinct(), "print").select("least.*", "print")
    sets = stored(_sets(documents, wanted, words))
    all_sizes = sets.agg(F.sum("size")).first()[0] or 0
    release(spark)
    shared = stored(shared.join(sets.drop("members", "wide", "simhash"), "print"))
    release(spark)
    roots = None
    for turn in ["grid", *range(STARS), None]:
        if turn == "grid":
            pairs = simhash_pairs(sets)
        elif roots is None:
            pairs = dealt(shared.withColumn("root", F.col("print")), "size").mapInArrow(_candidates(turn, similarity), PAIRS).distinct()
        else:
            placed = shared.join(roots, shared["print"] == roots["node"], "left").select(*shared.columns, F.coalesce("root", "print").alias("root"))
            pairs = dealt(placed, "size").mapInArrow(_candidates(turn, similarity), PAIRS).distinct()
        pairs = checkpointed(_likely(pairs, sets, similarity))
        release(spark)
        count, centres, moved = _extent(pairs)
        small = count <= SMALL_ROWS and 8 * centres <= SMALL_BYTES
        # Broadcast pairs and centres leave the sets where they lie. Else pairs whose sets are larger than half of all sets
        # together are compared in several rounds, each of which lets its shuffle go.
        # Roots stand for all links so far; a turn that adds none leaves them as they are.
        rounds, links = min(count, 1) if small else ceil(2 * 8 * moved / max(8 * all_sizes, SMALL_BYTES)), []
        for number in range(rounds):
            part = pairs.select("a", "b").where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == number)
            with with_settings(spark, **PAIRS_AT_ONCE):
                new = checkpointed(_verified(part, sets, similarity, small))
            if not new.isEmpty():
                links.append(new)
            release(spark)
        if links:
            known = [] if roots is None else [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
            roots = components(reduce(DataFrame.union, [*known, *links]))
            release(spark)
    if roots is None:
        return classes.select("print", "least", F.col("print").alias("root"))
    return classes.join(roots, classes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))


def representatives(documents: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with all their columns, that come first in their group of near copies: one row of each."""
    return first_rows(documents, groups(documents, words, similarity))
