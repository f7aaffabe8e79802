"""Text columns of Arrow batches as flat byte arrays, and hashes of any range of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchform.session import release, stored  # noqa: F401  (the operators take them from here)

# A null id sorts behind every real one.
NO_ID = 2**63 - 1
# Text handled at once by the array code; a longer document is handled alone.
BLOCK_BYTES = 1 << 20
# Bytes that separate words: space and the five ASCII controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULTIPLIERS = {}


def keyed(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` (null: behind all), ``text`` (null: empty) and ``version``, a hash of the text.

    Rows that repeat an id with another text differ in ``version``; equal rows stay equal.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return documents.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("version"),
    )


def public_id(df: DataFrame) -> DataFrame:
    """Give null ids back."""
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("table-"):
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the places where its rows begin and end."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(places, np.int64 if wide else np.int32)
    ends = ends[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text each, or of one row."""
    for batch in batches:
        _, ends = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _MULTIPLIERS.get(base)
    if have is None or len(have[0]) < count:
        size = max(1 << (count - 1).bit_length(), 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _MULTIPLIERS[base] = have = (pair[0], pair[1])
    return have


class RangeHash:
    """Polynomial hash of any range of a symbol array; equal ranges hash equally wherever they stand."""

    def __init__(self, symbols: np.ndarray, base: int = 0x5851F42D4C957F2D):
        self.up, self.down = _powers(base, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self.up[: len(symbols)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stops] - self.sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))

    def sliding(self, width: int) -> np.ndarray:
        """The hash of every ``width`` consecutive symbols."""
        count = max(0, len(self.sums) - width)
        return mixed((self.sums[width:] - self.sums[:count]) * self.down[:count])


def word_spans(raw: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a block begin and stop, and the number of the first word of every row (and one more)."""
    gap = np.ones(len(raw) + 1, bool)
    gap[:-1] = space[raw]
    word = ~gap[:-1]
    first = word.copy()
    first[1:] &= gap[:-2]
    inner = ends[1:-1]
    inner = inner[inner < len(raw)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= gap[1:-1]
    cut = inner[inner > 0]
    last[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)
