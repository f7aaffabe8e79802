"""Arrays that travel through a shuffle as compressed bundles, and sets of hashes as bits of a fixed number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from matchform.llm.texts import column_of, mixed

# A set of hashes has 2**26 bits (8 MB), however many members; a full one lets more strangers through, never fewer members.
BITS = 26
# Most frequent words that are sent as their rank, whatever the size of the corpus; others are sent as hashes.
RANKED = 49_152


def packed(arrays: Sequence[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *(v for a in arrays for v in (ord(a.dtype.char), len(a)))], np.int64)
    return zstandard.compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(-1, 2)
    at, arrays = 8 + 16 * count, []
    for kind, length in head.tolist():
        arrays.append(np.frombuffer(raw, np.dtype(chr(kind)), length, at))
        at += arrays[-1].nbytes
    return arrays


def small(values: np.ndarray) -> np.ndarray:
    """Numbers from zero on in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def planes(ascending: np.ndarray) -> np.ndarray:
    """Ascending hashes as the bytes of their distances, all first bytes, then all second ones: their upper ones are zero."""
    return np.diff(ascending, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.reshape(-1)


def from_planes(data: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    return mixed(first * np.uint64(0xA24BAED4963EE407) + second)


def heads(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def cut_out(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Ranges of bytes as strings."""
    sizes = stops - starts
    ends = np.append(0, np.cumsum(sizes))
    at = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[at])])


class HashBits:
    """A set of hashes: what it does not have is not in it, what it has is in it but for a small share."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - BITS)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1

    @classmethod
    def of(cls, frame: DataFrame, column: str) -> HashBits:
        """The hashes of a column. What reaches the driver are at most 2**20 pairs of numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.unique(cls._place(column_of(batch, column).to_numpy().view(np.uint64)))
                if len(place):
                    first = heads(place >> 6)
                    bits = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first)
                    yield pa.RecordBatch.from_arrays([pa.array(place[first] >> 6), pa.array(bits.view(np.int64))], ["word", "bits"])

        rows = frame.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << (BITS - 6), np.uint64)
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return cls(words)


class Ranks:
    """Codes of words: zero for none, then the ranks of the most frequent, then places in a bundle's own list of others."""

    def __init__(self, hashes: np.ndarray):
        """``hashes`` in the order of their frequency."""
        self.hashes = np.append(np.uint64(0), hashes)
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Codes of ranked words; -1 for others."""
        place = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[place] == words, self.order[place], -1)

    def bundle(self, words: np.ndarray, codes: np.ndarray, times: np.ndarray) -> bytes:
        other = codes < 0
        own, number = np.unique(words[other], return_inverse=True)
        codes = codes.copy()
        codes[other] = len(self.hashes) + number
        return packed([own, small(codes.reshape(-1)), small(times)])

    def words(self, data: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
        own, codes, times = unpacked(data)
        return np.concatenate((self.hashes, own))[codes].reshape(rows, -1), times.astype(np.int64)

    @classmethod
    def of(cls, counts: DataFrame, word: str, times: str) -> Ranks:
        """The most frequent words of a table of counts."""
        top = counts.orderBy(F.desc(times), word).limit(RANKED).select(word).toArrow()
        return cls(top[word].to_numpy().view(np.uint64))
