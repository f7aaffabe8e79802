"""Suffix-array dedup: repeated byte sequences from suffix arrays of shards.

A shard's suffixes are sorted by Larsson and Sadakane's refinement: first by a few bytes, then again and again by the
rank of what follows, twice as far each time, and only where suffixes are still tied. Common prefixes follow from
Kasai's observation: where a suffix and its neighbour both lose their first byte and stay neighbours, their common
prefix is one shorter; only the other pairs are compared byte by byte. Neighbours that share a window's length have
one window. A group of segments that needs more than one shard is merged: each shard's distinct windows are looked
up in those of the shards before it by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchform.llm.repeats import GROUP_SYMBOLS, Groups, Windows, covered, repeated
from matchform.llm.texts import blocks, column_of, public_id, text_bytes

BYTES = 200
GRAM = 64
FIRST_BYTES = 4
PLACE = 20  # bits of a place; a shard has at most 2**20 symbols


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of small numbers (below 512, 0 past the end), sorted by at least ``depth`` symbols."""
    count = len(symbols)
    if count > 1 << PLACE:
        raise ValueError("a shard has at most 2**20 symbols")
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(FIRST_BYTES, np.uint64)))
    key = np.zeros(count, np.uint64)
    for k in range(FIRST_BYTES):
        key = key << np.uint64(9) | padded[k : k + count]
    place = np.uint64((1 << PLACE) - 1)
    ordered = np.sort(key << np.uint64(PLACE) | np.arange(count, dtype=np.uint64))
    array = (ordered & place).astype(np.int64)
    head = np.append(True, (ordered[1:] ^ ordered[:-1]) >> np.uint64(PLACE) != 0)[:count]
    # A suffix's rank is the place of the first of those it is tied with; 0 stands for what lies past the end.
    rank = np.zeros(count + 1, np.uint64)
    rank[array] = np.maximum.accumulate(np.where(head, np.arange(count), 0)) + 1
    reach = FIRST_BYTES
    while reach < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        own = array[slots]
        following = np.minimum(own + reach, count)
        packed = rank[own] << np.uint64(2 * PLACE + 1) | rank[following] << np.uint64(PLACE) | own.astype(np.uint64)
        packed = np.sort(packed)
        own = (packed & place).astype(np.int64)
        array[slots] = own
        differs = np.append(True, (packed[1:] ^ packed[:-1]) >> np.uint64(PLACE) != 0)
        head[slots] = differs
        new = np.maximum.accumulate(np.where(differs, slots, 0)).astype(np.uint64) + np.uint64(1)
        rank[own] = new
        reach *= 2
    return array


def common_prefixes(symbols: np.ndarray, array: np.ndarray) -> np.ndarray:
    """How many bytes each suffix shares with the one before it in the array."""
    count = len(array)
    before = np.full(count, -1)
    before[array[1:]] = array[:-1]
    reducible = np.zeros(count, bool)
    reducible[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    own = np.flatnonzero(~reducible & (before >= 0))
    limit = count - np.maximum(own, before[own])
    words = np.zeros(count + 8, np.uint64)
    padded = np.concatenate((symbols, np.zeros(16, symbols.dtype))).astype(np.uint64)
    for k in range(8):
        words |= padded[k : k + count + 8] << np.uint64(8 * k)
    same = np.zeros(len(own), np.int64)
    live = np.arange(len(own))
    while len(live):
        at = same[live]
        unlike = words[own[live] + at] ^ words[before[own[live]] + at]
        # The lowest byte that differs.
        low = np.bitwise_count((unlike & (~unlike + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        same[live] = np.minimum(at + low, limit[live])
        live = live[(unlike == 0) & (at + 8 < limit[live])]
    shared = np.zeros(count, np.int64)
    shared[own] = same
    first = np.maximum.accumulate(np.where(reducible, 0, np.arange(count)))
    shared = np.maximum(shared[first] - (np.arange(count) - first), 0)
    shared[before < 0] = 0
    return shared[array]


def shard_classes(raw: np.ndarray, bounds: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A class for every window of the shard in the order of its array, and the place of one window of each class."""
    # Suffixes run on into the next segment; a window never does, so its class depends on its own bytes alone.
    array = suffix_array(raw.astype(np.uint16) + 1, length)
    shared = common_prefixes(raw, array)
    number = np.cumsum(shared < length) - 1
    of = np.empty(len(raw), np.int64)
    of[array] = number
    starts = np.repeat(bounds[:-1] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    kinds, found = np.unique(of[starts], return_inverse=True)
    some = np.zeros(len(kinds), np.int64)
    some[found] = starts
    return found, some


def arrays(length: int, shard: int = GROUP_SYMBOLS):
    """Classes of windows from suffix arrays of shards of at most about ``shard`` bytes, merged by binary search."""

    def classify(symbols: np.ndarray, bounds: np.ndarray, windows: np.ndarray) -> np.ndarray:
        cuts = [0]
        for i in range(1, len(windows) + 1):
            if i == len(windows) or bounds[i + 1] - bounds[cuts[-1]] > shard:
                cuts.append(i)
        found, merged, names = [], None, None
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = symbols[bounds[a] : bounds[b]]
            own, some = shard_classes(part, bounds[a : b + 1] - bounds[a], windows[a:b], length)
            if len(cuts) == 2:
                return own
            # All windows are equally long, so strings compare as their bytes do.
            text = np.ascontiguousarray(part[some[:, None] + np.arange(length)]).view(f"S{length}").ravel() if len(some) else np.empty(0, f"S{length}")
            if merged is None:
                merged, names = text, np.arange(len(text))
                found.append(own)
                continue
            at = np.searchsorted(merged, text)
            known = (at < len(merged)) & (merged[np.minimum(at, len(merged) - 1)] == text)
            name = np.where(known, names[np.minimum(at, len(merged) - 1)], len(merged) - known.cumsum() + np.arange(len(text)) + known)
            found.append(name[own])
            merged, names = np.insert(merged, at[~known], text[~known]), np.insert(names, at[~known], name[~known])
        return np.concatenate(found)

    return classify


def removed_bytes(documents: DataFrame, length: int = BYTES, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every document.

    A byte goes if a string of ``length`` bytes that covers it also begins in any other place, in the
    same document or another. A null text is empty; repeated rows are other places of each other; null
    ids stay null; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are
    ignored.
    """
    kind = Windows(length, min(gram, length), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            raw, ends = text_bytes(column_of(batch, "text"))
            gone = covered(column_of(batch, "spans"), ends, len(raw))
            lost, spans, digests = [], [], []
            for a, b in zip(ends[:-1], ends[1:]):
                own = gone[a:b]
                lost.append(int(own.sum()))
                spans.append(int((own[1:] & ~own[:-1]).sum()) + int(own[:1].sum()))
                digests.append(hashlib.sha256(raw[a:b][~own].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), pa.array(np.diff(ends)), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    found = repeated(documents, kind, Groups(kind, arrays(length)), elsewhere=True)
    return public_id(found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
