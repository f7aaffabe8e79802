"""Benchmark decontamination: a BM25 index of test items, block-max WAND over training passages, verification.

Every passage of every document is a query. A score is divided by the item's own (the item as its query), so one
threshold fits items of all lengths. Terms carry their largest share over all items and over each block of items;
a passage goes on only with the blocks in which the sum of those bounds reaches the threshold, and only there are
postings read. The bounds are never too small, so all items above the threshold are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchform.llm.texts import RangeHash, blocks, column_of, text_bytes, word_spans

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
# Test items in one index; a longer table is indexed and searched part by part.
INDEX_ITEMS = 1024

# Letters and digits of ASCII in lower case and all bytes above it make up words.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a block, and the number of the first word of every row (and one more)."""
    raw = FOLD[raw]
    starts, stops, first = word_spans(raw, ends, BREAK)
    return RangeHash(raw)(starts, stops), first


def shingles(words: np.ndarray) -> tuple[int, np.ndarray]:
    """The width and the distinct hashes of the shingles of a word sequence; a shorter one is its own shingle."""
    width = min(SHINGLE, len(words))
    return width, np.unique(RangeHash(words).sliding(width)) if width else np.empty(0, np.uint64)


def share(part: tuple[int, np.ndarray], words: np.ndarray) -> float:
    """The share of shingles that stand among the words; 1 of none."""
    width, wanted = part
    return float(np.isin(wanted, RangeHash(words).sliding(width)).mean()) if width else 1.0


def aligned(item: np.ndarray, words: np.ndarray) -> float:
    """One less the share of an item's words that must be changed, left out or added to make a stretch of the words."""
    steps = np.arange(len(words) + 1)
    cost = np.zeros(len(words) + 1, np.int64)
    for word in item:
        new = cost + 1
        new[1:] = np.minimum(new[1:], cost[:-1] + (words != word))
        cost = np.minimum.accumulate(new - steps) + steps
    return 1 - int(cost.min()) / len(item)


@dataclass
class Index:
    """Postings of a set of items by term, their bounds, and what verification needs."""

    item_ids: np.ndarray
    terms: np.ndarray  # sorted word hashes
    first: np.ndarray  # first posting of every term
    items: np.ndarray
    impacts: np.ndarray  # BM25 shares of the item's own score
    term_bound: np.ndarray
    block_bound: np.ndarray  # (terms, blocks)
    question: list[tuple[int, np.ndarray]]
    answer: list[tuple[int, np.ndarray]]
    longest: int
    whole: list[np.ndarray]  # all words of every item


def build_index(ids: list[int], texts: list[str], answers: list[str | None] | None = None) -> Index | None:
    """Index items; without answers, the last third of an item's words is the answer and the rest the question."""
    kept, words, question, answer = [], [], [], []
    for i, text in enumerate(texts):
        own = np.frombuffer((text or "").encode(), np.uint8)
        found, _ = word_hashes(own, np.array([0, len(own)]))
        cut = len(found) - len(found) // 3
        tail = found[cut:]
        if answers is not None:
            own = np.frombuffer((answers[i] or "").encode(), np.uint8)
            tail, cut = word_hashes(own, np.array([0, len(own)]))[0], len(found)
            found = np.concatenate((found, tail))
        if len(found):
            kept.append(ids[i])
            words.append(found)
            question.append(shingles(found[:cut]))
            answer.append(shingles(tail))
    if not kept:
        return None
    lengths = np.array([len(w) for w in words])
    flat, item = np.concatenate(words), np.repeat(np.arange(len(words)), lengths)
    terms, term = np.unique(flat, return_inverse=True)
    pairs, counts = np.unique(term * len(words) + item, return_counts=True)
    term, item = np.divmod(pairs, len(words))
    seen = np.bincount(term, minlength=len(terms))
    idf = np.log1p((len(words) - seen + 0.5) / (seen + 0.5))
    impact = idf[term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[item] / lengths.mean()))
    impact /= np.bincount(item, impact)[item]
    bound = np.zeros((len(terms), -(-len(words) // BLOCK_ITEMS)), np.float32)
    np.maximum.at(bound, (term, item // BLOCK_ITEMS), impact)
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    return Index(np.array(kept), terms, first, item, impact, bound.max(axis=1), bound, question, answer, int(lengths.max()), words)


def _distinct_terms(index: Index, words: np.ndarray, first: np.ndarray):
    """Passages of two strides that overlap by one, and the distinct index terms of each: (passage, term) sorted."""
    stride = index.longest
    count = np.maximum(1, -(-np.diff(first) // stride) - 1)
    base = np.concatenate(([0], np.cumsum(count)))
    place = np.searchsorted(index.terms, words)
    place[place == len(index.terms)] = 0
    hit = np.flatnonzero(index.terms[place] == words)
    row = np.searchsorted(first, hit, side="right") - 1
    step = (hit - first[row]) // stride
    keys = []
    for back in (0, 1):
        at = step - back
        good = (at >= 0) & (at < count[row])
        keys.append((base[row[good]] + at[good]) * len(index.terms) + place[hit[good]])
    passage, term = np.divmod(np.unique(np.concatenate(keys)), len(index.terms))
    return base, passage, term


def search(index: Index, words: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """All (row, first word of the passage in its row, item, score) with a score of at least ``threshold``."""
    base, passage, term = _distinct_terms(index, words, first)
    if not len(passage):
        return
    # A sum of rounded bounds may fall short of the exact score by a little.
    floor = threshold - 1e-4
    for low in range(0, len(passage), 1 << 16):
        # Whole passages only: begin and end at the first row of one.
        a = low if low == 0 or passage[low] != passage[low - 1] else int(np.searchsorted(passage, passage[low], side="right"))
        high = min(low + (1 << 16), len(passage))
        b = high if high == len(passage) or passage[high] != passage[high - 1] else int(np.searchsorted(passage, passage[high], side="right"))
        if a >= b:
            continue
        begin = a + np.concatenate(([0], np.flatnonzero(np.diff(passage[a:b])) + 1))
        reach = np.add.reduceat(index.term_bound[term[a:b]], begin - a) >= floor
        if not reach.any():
            continue
        size = np.diff(np.append(begin, b))
        rows = np.flatnonzero(np.repeat(reach, size)) + a
        bounds = np.add.reduceat(index.block_bound[term[rows]], np.concatenate(([0], np.cumsum(size[reach])[:-1])), axis=0)
        for at, block in zip(*np.nonzero(bounds >= floor)):
            start, length = begin[reach][at], size[reach][at]
            scores = {}
            for t in term[start : start + length]:
                own = slice(*index.first[t : t + 2])
                mine = index.items[own]
                for k in np.flatnonzero(mine // BLOCK_ITEMS == block):
                    scores[int(mine[k])] = scores.get(int(mine[k]), 0.0) + float(index.impacts[own][k])
            row = int(np.searchsorted(base, passage[start], side="right")) - 1
            for item, score in scores.items():
                if score >= threshold - 1e-9:
                    yield row, int(passage[start] - base[row]) * index.longest, item, score


def matches(index: Index, words: np.ndarray, first: np.ndarray, threshold: float, overlap: float, whole: bool = False) -> list[tuple]:
    """Verified (row, item, score, question overlap, answer overlap, first word); of an item's passages in a row the best.

    ``whole``: an item is also found where its words, aligned as one, have the overlap.
    """
    best: dict[tuple[int, int], tuple] = {}
    for row, start, item, score in search(index, words, first, threshold):
        text = words[first[row] + start : min(first[row] + start + 2 * index.longest, first[row + 1])]
        shares = [share(part, text) for part in (index.question[item], index.answer[item])]
        if min(shares) >= overlap or whole and aligned(index.whole[item], text) >= overlap - 1e-9:
            found = (row, item, score, *shares, start)
            best[row, item] = max(best.get((row, item), found), found, key=lambda f: (f[2], -f[5]))
    return list(best.values())


def indexes(benchmark: DataFrame, size: int = INDEX_ITEMS) -> Iterator[Index]:
    """Indexes over at most ``size`` items each, in the order of the ids; items without words are left out."""
    columns = [F.col("item_id").cast("long"), F.col("text").cast("string")]
    answered = "answer" in benchmark.columns
    rows, ids, texts, answers = benchmark.select(*columns, *(["answer"] if answered else [])).orderBy("item_id", "text"), [], [], []

    def built():
        return build_index(ids, texts, answers if answered else None)

    for r in rows.toLocalIterator():
        ids.append(-1 if r.item_id is None else r.item_id)
        texts.append(r.text)
        answers.append(r.answer if answered else None)
        if len(ids) == size:
            if index := built():
                yield index
            ids, texts, answers = [], [], []
    if ids and (index := built()):
        yield index


def contaminated(
    documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, whole: bool = False
) -> DataFrame:
    """One row for each document and test item it contains: ``doc_id``, ``item_id``, scores and place.

    Passages are twice as long as the longest item and overlap by its length, so an item lies whole in
    one of them. A hit has a BM25 share of at least ``threshold``, and at least ``overlap`` of the
    five-word shingles of the question and of the answer lie in the passage. With ``whole``, an item without
    a given answer is also found where at most 1 - ``overlap`` of its words are changed, left out or added;
    the two overlaps remain those of its parts. Null and empty texts have
    no rows, repeated documents have a row each, a null item id is shown as -1, items without words are
    never found, and other columns are ignored. Items are broadcast in indexes of bounded size; a longer
    test set takes several passes.
    """
    whole = whole and "answer" not in benchmark.columns
    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def over(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                words, first = word_hashes(*text_bytes(column_of(batch, "text")))
                found = matches(index, words, first, threshold, overlap, whole)
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [column_of(batch, "doc_id").take(rows), pa.array([int(index.item_ids[f[1]]) for f in found], pa.int64())]
                    + [pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4)]
                    + [pa.array([f[5] for f in found], pa.int64())],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                )

        return source.mapInArrow(run, SCHEMA)

    found = None
    for index in indexes(benchmark):
        found = over(index) if found is None else found.union(over(index))
    return found if found is not None else documents.sparkSession.createDataFrame([], SCHEMA)


def clean(
    documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, whole: bool = False
) -> DataFrame:
    """The documents, with all their columns, that contain no test item."""
    whole = whole and "answer" not in benchmark.columns
    at, schema = documents.columns.index("text"), documents.schema

    def without(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                words, first = word_hashes(*text_bytes(batch.column(at)))
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in matches(index, words, first, threshold, overlap, whole)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for index in indexes(benchmark):
        documents = documents.mapInArrow(without(index), schema)
    return documents
