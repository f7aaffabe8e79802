"""Repeated windows of documents: every window of a fixed number of symbols that stands in more than one place.

A symbol is a word or a byte. The windows of a document are split into *segments*: runs of windows that share an
anchor, the least of the short grams inside a window. Equal windows have equal anchors, so only segments whose
anchor occurs more than once are looked at further; they are counted by hash before any text moves, and equal
segments are one class. The texts of the classes are dealt out by anchor and searched group by group by the
structure an operator brings (subtrees, suffix arrays). A group that outgrows a task's memory has its key
lengthened to the whole window, and those windows are aggregated by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from matchform.llm.texts import BLOCK_BYTES, RangeHash, blocks, column_of, keyed, release, stored, text_bytes, word_spans
from matchform.session import checkpointed

SECOND_BASE = 0x2545F4914F6CDD1D
PLACE_BITS = 34
# Symbols that are searched together, and the most that one anchor may have before its key is lengthened.
GROUP_SYMBOLS = 1 << 18
ANCHOR_SYMBOLS = 1 << 20

# Gets symbols, where each segment begins (and the end), and its number of windows; gives a class for each window.
Classify = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Windows:
    """Windows of ``length`` symbols with anchors of ``gram`` symbols."""

    length: int
    gram: int
    words: bool

    def symbols(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of a block, where each row begins (and the end), and the bytes each symbol begins and stops at."""
        if not self.words:
            places = np.arange(len(raw) + 1)
            return raw, ends, places[:-1], places[1:]
        starts, stops, first = word_spans(raw, ends)
        return RangeHash(raw)(starts, stops), first, starts, stops

    @property
    def block(self) -> int:
        """Bytes of text handled at once: several numbers are held for every symbol of it."""
        return BLOCK_BYTES if self.words else BLOCK_BYTES // 4

    def slices(self, raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """A block as it is, or one long text of bytes in slices: every window lies whole in one, the first number is its place."""
        if self.words or len(ends) != 2 or len(raw) <= self.block + self.length:
            yield 0, raw, ends
            return
        for at in range(0, len(raw) - self.length + 1, self.block):
            part = raw[at : at + self.block + self.length - 1]
            yield at, part, np.array([0, len(part)])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive keys."""
    least, span = keys, 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def segments(kind: Windows, raw: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of a block: row, first window, number of windows, bytes from and to, hashes of anchor and content."""
    symbols, bounds, begin, stop = kind.symbols(raw, ends)
    count = len(symbols) - kind.length + 1
    if count < 1:
        return {}
    row = np.repeat(np.arange(len(ends) - 1), np.diff(bounds))
    whole = row[:count] == row[kind.length - 1 :]
    grams = RangeHash(symbols).sliding(kind.gram)
    # The leftmost of the least grams: hash above, place below.
    keys = grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    least = window_minima(keys, kind.length - kind.gram + 1)
    anchor = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return {}
    windows = np.add.reduceat(whole, first).astype(np.int64)
    after = first + windows - 1 + kind.length
    owner = row[first]
    return {
        "row": owner,
        "start": first - bounds[owner],
        "windows": windows,
        "begin": begin[first] - ends[owner],
        "stop": stop[after - 1] - ends[owner],
        "anchor": grams[anchor[first]].view(np.int64),
        "content": RangeHash(symbols, SECOND_BASE)(first, after).view(np.int64),
    }


CLASS = ("anchor", "content", "windows")
PLACE = ("doc_id", "version", "start")
HEAD = (*PLACE, "begin", "stop")
OTHERS = "array<struct<doc_id: long, version: long, start: long>>"
# Places of a class that travel in one row.
PLACES = 64


def gathered(columns: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows in order of their class, where each bundle of at most ``PLACES`` of one class begins, and each row's number in its class."""
    order = np.lexsort([columns[n] for n in reversed((*CLASS, *(n for n in HEAD if n in columns)))])
    columns = {n: c[order] for n, c in columns.items()}
    new = np.ones(len(order), bool)
    new[1:] = np.any([columns[n][1:] != columns[n][:-1] for n in CLASS], axis=0)
    head = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return columns, np.flatnonzero(nth % PLACES == 0), nth


def _places(columns: dict[str, np.ndarray], rows: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(columns[n][rows]) for n in PLACE], list(PLACE))


def occurrences(documents: DataFrame, kind: Windows) -> DataFrame:
    """The segments of every document, without their texts: a row for each class in a block and its first place, with the others.

    A passage that many documents share is thus a few rows of every block, not a row for each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=kind.block):
            for at, raw, ends in kind.slices(*text_bytes(column_of(batch, "text"))):
                found = segments(kind, raw, ends)
                if found:
                    for name in ("start", "begin", "stop"):
                        found[name] = found[name] + at
                    rows = found.pop("row")
                    found |= {name: column_of(batch, name).to_numpy()[rows] for name in ("doc_id", "version")}
                    found, head, nth = gathered(found)
                    rest = np.flatnonzero(nth % PLACES)
                    ends_of = np.searchsorted(rest, np.append(head, len(nth))).astype(np.int32)
                    others = pa.ListArray.from_arrays(pa.array(ends_of), _places(found, rest), mask=pa.array(np.diff(ends_of) == 0))
                    yield pa.RecordBatch.from_arrays([*(pa.array(found[n][head]) for n in (*HEAD, *CLASS)), others], [*HEAD, *CLASS, "others"])

    return documents.mapInArrow(run, ", ".join(f"{n} long" for n in (*HEAD, *CLASS)) + f", others {OTHERS}")


def copies() -> Column:
    """The places in rows of ``occurrences``."""
    return F.sum(1 + F.coalesce(F.size("others"), F.lit(0)))


RUN = "struct<first: long, length: long, least: long>"
# A class with its runs of repeated windows; or, where the key is lengthened, one window of a class and its two hashes.
RUNS = f"anchor long, content long, windows long, runs array<{RUN}>, one long, two long, copies long"


class Groups:
    """Searches the class texts of whole anchors and yields runs of windows that stand in more than one place."""

    def __init__(self, kind: Windows, classify: Classify, group: int = GROUP_SYMBOLS, most: int = ANCHOR_SYMBOLS):
        self.kind, self.classify, self.group, self.most = kind, classify, group, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = long_anchor = None
        for batch in blocks(batches, limit=self.most):
            batch, last = self._distinct(batch, last)
            if long_anchor is not None:
                rest = int((column_of(batch, "anchor").to_numpy() == long_anchor).sum())
                if rest:
                    yield self._lengthened(batch.slice(0, rest))
                batch = batch.slice(rest)
            if not batch.num_rows:
                continue
            long_anchor = None
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            _, ends = text_bytes(column_of(rows, "text"))
            anchors = column_of(rows, "anchor").to_numpy()
            # Where anchors begin; the last one may go on in the next batch.
            begin = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
            at = 0
            while (k := int(np.searchsorted(ends[begin], ends[at] + self.group))) < len(begin):
                yield self._searched(rows.slice(at, begin[k] - at))
                at = int(begin[k])
            own, held = int(begin[-1]), rows.slice(at)
            if ends[-1] - ends[own] > self.most:
                if own > at:
                    yield self._searched(rows.slice(at, own - at))
                yield self._lengthened(rows.slice(own))
                held, long_anchor = None, anchors[own]
        if held is not None:
            yield self._searched(held)

    @staticmethod
    def _distinct(batch: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple | None]:
        """Without rows that repeat the class before them, which repeated documents bring."""
        if not batch.num_rows:
            return batch, last
        keys = [column_of(batch, n).to_numpy() for n in ("anchor", "content", "windows")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        new[0] = last != tuple(k[0] for k in keys)
        return batch.filter(pa.array(new)), tuple(k[-1] for k in keys)

    def _read(self, held: pa.RecordBatch):
        symbols, bounds, _, _ = self.kind.symbols(*text_bytes(column_of(held, "text")))
        columns = {n: column_of(held, n).to_numpy() for n in ("anchor", "content", "windows", "copies", "least")}
        windows = columns["windows"]
        owner = np.repeat(np.arange(len(windows)), windows)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        return symbols, bounds, columns, owner, offset

    def _searched(self, held: pa.RecordBatch) -> pa.RecordBatch:
        symbols, bounds, columns, owner, offset = self._read(held)
        found = self.classify(symbols, bounds, columns["windows"])
        total = np.bincount(found, columns["copies"][owner])[found]
        least = np.full(found.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, found, columns["least"][owner])
        least = least[found]
        more = total >= 2
        new = more.copy()
        new[1:] &= ~more[:-1] | (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return self._batch({n: first for n in CLASS} | {"runs": self._runs(first, first, first, first)})
        # A run ends where the next begins, even if no gap lies between.
        length = np.minimum(np.add.reduceat(more, first), np.diff(np.append(first, len(more))))
        per_class = np.bincount(owner[first], minlength=len(columns["windows"]))
        kept = np.flatnonzero(per_class)
        runs = self._runs(per_class[kept], offset[first], length, least[first])
        return self._batch({n: columns[n][kept] for n in CLASS} | {"runs": runs})

    @staticmethod
    def _runs(counts: np.ndarray, first: np.ndarray, length: np.ndarray, least: np.ndarray) -> pa.ListArray:
        """Lists of so many runs each."""
        parts = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in (first, length, least)], ["first", "length", "least"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), parts)

    def _lengthened(self, held: pa.RecordBatch) -> pa.RecordBatch:
        symbols, bounds, columns, owner, offset = self._read(held)
        at = bounds[owner] + offset
        rows = {n: columns[n][owner] for n in (*CLASS, "copies")}
        one = np.ones(len(offset), np.int64)
        rows["runs"] = self._runs(one, offset, one, columns["least"][owner])
        rows |= {n: RangeHash(symbols, base)(at, at + self.kind.length).view(np.int64) for n, base in (("one", SECOND_BASE), ("two", SECOND_BASE * 3 % 2**64))}
        return self._batch(rows)

    @staticmethod
    def _batch(rows: dict) -> pa.RecordBatch:
        names, count = [*CLASS, "runs", "one", "two", "copies"], len(rows["anchor"])
        columns = [rows["runs"] if n == "runs" else pa.array(rows[n].astype(np.int64)) if n in rows else pa.nulls(count, pa.int64()) for n in names]
        return pa.RecordBatch.from_arrays(columns, names)


def _shared(texts: DataFrame, kind: Windows) -> DataFrame:
    """Segments whose anchor occurs more than once; the anchors are distinct, so a row stays one or goes."""
    found = occurrences(texts, kind)
    times = found.groupBy("anchor").agg(copies().alias("times"))
    # Written first, so that the join reads two plain shuffles and an anchor that many segments have can be split.
    shared = checkpointed(times.where("times > 1").select("anchor"))
    return stored(found.join(shared, "anchor", "left_semi"))


def _bundled(found: DataFrame) -> DataFrame:
    """Places of equal classes in lists of bounded length, made where the rows lie: a class with many places joins as few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = column_of(batch, "others")
            flat = others.flatten()
            row = np.concatenate((np.arange(batch.num_rows), np.repeat(np.arange(batch.num_rows), np.diff(_list_ends(others)))))
            columns = {n: column_of(batch, n).to_numpy()[row] for n in CLASS}
            columns |= {n: np.concatenate((column_of(batch, n).to_numpy(), flat.field(n).to_numpy())) for n in PLACE}
            columns, head, _ = gathered(columns)
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), _places(columns, slice(None)))
            yield pa.RecordBatch.from_arrays([*(pa.array(columns[n][head]) for n in CLASS), lists], [*CLASS, "places"])

    kinds = ", ".join(f"{n} long" for n in CLASS) + f", places {OTHERS}"
    return found.select(*CLASS, *PLACE, "others").mapInArrow(run, kinds)


def _runs(texts: DataFrame, found: DataFrame, groups: Groups) -> DataFrame:
    """Runs of repeated windows in the classes of segments, and single windows of lengthened keys."""
    classes = found.groupBy("anchor", "content", "windows").agg(
        copies().alias("copies"), F.min(F.struct("doc_id", "version", "begin", "stop")).alias("of")
    )
    wanted = classes.groupBy(F.col("of.doc_id").alias("doc_id"), F.col("of.version").alias("version")).agg(
        F.collect_list(F.struct("anchor", "content", "windows", "copies", "of.begin", "of.stop")).alias("classes")
    )
    # A class's text is cut out of the first document it stands in.
    cut = texts.join(wanted, ["doc_id", "version"]).select("doc_id", F.col("text").cast("binary").alias("text"), F.explode("classes").alias("c"))
    cut = cut.select(
        "c.anchor", "c.content", "c.windows", "c.copies", F.col("doc_id").alias("least"),
        F.expr("substring(text, cast(c.begin as int) + 1, cast(c.stop - c.begin as int))").alias("text"),
    )
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartition(tasks, "anchor").sortWithinPartitions("anchor", "content", "windows")
    return stored(dealt.mapInArrow(groups, RUNS))


def repeated(documents: DataFrame, kind: Windows, groups: Groups, elsewhere: bool) -> DataFrame:
    """``keyed`` documents with ``spans``: (start, length) in symbols of what repeated windows cover.

    A window counts if it also stands in a document with a smaller id, or with ``elsewhere`` in any
    other place. Documents without such a window have null spans.
    """
    spark, texts = documents.sparkSession, keyed(documents)
    found = _shared(texts, kind)
    release(spark)
    runs = _runs(texts, found, groups)
    release(spark)
    single = F.col("runs")[0]
    long_runs = runs.where("one is not null").select(*CLASS, "one", "two", "copies", single.alias("run"))
    totals = long_runs.groupBy("one", "two").agg(F.sum("copies").alias("total"), F.min("run.least").alias("lowest")).where("total > 1")
    long_runs = long_runs.join(totals, ["one", "two"]).groupBy(*CLASS).agg(
        F.collect_list(F.struct("run.first", "run.length", F.col("lowest").alias("least"))).alias("runs")
    )
    runs = runs.where("one is null").select(*CLASS, "runs").union(long_runs)
    # Bundles of places are dealt out evenly before each place gets its spans.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _bundled(found).join(runs, list(CLASS)).select("places", "runs").repartition(tasks, F.xxhash64("places"))
    placed = placed.select("runs", F.explode("places").alias("at")).select("runs", "at.*")
    counted = F.col("runs") if elsewhere else F.filter("runs", lambda run: run["least"] < F.col("doc_id"))
    own = F.transform(counted, lambda run: F.struct((F.col("start") + run["first"]).alias("start"), (run["length"] + (kind.length - 1)).alias("length")))
    spans = placed.select("doc_id", "version", own.alias("spans")).where(F.size("spans") > 0)
    # Rows that repeat an id and text have the same spans, which are collected once.
    spans = spans.groupBy("doc_id", "version").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return texts.join(spans, ["doc_id", "version"], "left")


def covered(spans: pa.Array, bounds: np.ndarray, length: int) -> np.ndarray:
    """Which of ``length`` symbols of a block the spans of its rows cover."""
    change = np.zeros(length + 1, np.int64)
    if len(spans.flatten()):
        row = np.repeat(np.arange(len(spans)), np.diff(_list_ends(spans)))
        flat = spans.flatten()
        start = bounds[row] + flat.field("start").to_numpy()
        np.add.at(change, start, 1)
        np.subtract.at(change, start + flat.field("length").to_numpy(), 1)
    return np.cumsum(change[:-1]) > 0


def _list_ends(spans: pa.ListArray) -> np.ndarray:
    """Ends of the rows of a list column; a null row is empty."""
    sizes = spans.value_lengths().fill_null(0).to_numpy()
    return np.concatenate(([0], np.cumsum(sizes)))
