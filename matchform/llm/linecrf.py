"""Quality rules: a linear-chain conditional random field labels lines, and the share of content decides.

Lines with a word are labelled content or boilerplate by Viterbi decoding. Features come from each line's bytes and
words; their weights and the transitions between neighbouring lines are fitted by maximum likelihood on documents of
known quality, all of whose lines take the document's label (a weak label: noise in single lines averages out).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchform.llm.texts import RangeHash, blocks, column_of, mixed, text_bytes, word_spans

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
# Fitting uses at most this many labelled documents, and sequences of at most so many lines of them.
SAMPLE = 1500
SEQUENCE = 64
CONTENT_SHARE = 0.5

FEATURES = ("bias", "symbols", "bars", "bangs", "capitals", "digits", "echoes", "repeats", "copy", "brief", "length", "closed", "first", "last")


@dataclass
class Lines:
    """Lines with a word of a block: row, number of words, features; and the base counts of every row."""

    row: np.ndarray
    words: np.ndarray
    features: np.ndarray
    counts: dict[str, np.ndarray]


def _in_ranges(flags: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[stops] - sums[starts]


def read_lines(raw: np.ndarray, ends: np.ndarray) -> Lines:
    rows = len(ends) - 1
    starts, stops, first = word_spans(raw, ends)
    owner = np.repeat(np.arange(rows), np.diff(first))
    hashes = RangeHash(raw)
    word = hashes(starts, stops)
    n_words = np.diff(first)
    # Three-word windows that occur again in their document, and the words they cover.
    again = np.zeros(len(word) + 1, np.int64)
    if len(word) >= 3:
        at = np.flatnonzero(owner[:-2] == owner[2:])
        key = mixed(RangeHash(word).sliding(3)[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, kind, count = np.unique(key, return_inverse=True, return_counts=True)
        at = at[count[kind] > 1]
        np.add.at(again, at, 1)
        np.subtract.at(again, at + 3, 1)
    again = np.cumsum(again[:-1]) > 0
    # Lines end at a line feed or with their document.
    feeds = np.flatnonzero(raw == 10)
    line_row = np.concatenate((np.searchsorted(ends[1:], feeds, side="right"), np.arange(rows)))
    order = np.lexsort((np.concatenate((feeds, ends[1:])), line_row))
    stop, line_row = np.concatenate((feeds, ends[1:]))[order], line_row[order]
    head = np.ones(len(stop), bool)
    head[1:] = line_row[1:] != line_row[:-1]
    start = np.where(head, ends[line_row], np.concatenate(([0], stop[:-1] + 1)))
    low, high = np.searchsorted(starts, start), np.searchsorted(starts, stop)
    full = high > low
    start, stop, line_row, low, high = start[full], stop[full], line_row[full], low[full], high[full]
    key = mixed(hashes(start, stop) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, earliest, kind = np.unique(key, return_index=True, return_inverse=True)
    copy = earliest[kind] != np.arange(len(key))
    size, words = np.maximum(stop - start, 1), high - low
    upper, letter = (raw >= 65) & (raw <= 90), ((raw | 32) >= 97) & ((raw | 32) <= 122)
    echo = np.zeros(len(word), bool)
    echo[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    ending = raw[stops[high - 1] - 1] if len(high) else np.empty(0, np.uint8)
    edge = np.ones(len(line_row) + 1, bool)
    edge[1:-1] = line_row[1:] != line_row[:-1]
    columns = (
        np.ones(len(size)),
        _in_ranges(SYMBOLS[raw] & (raw != 124), start, stop) / size,
        np.minimum(_in_ranges(raw == 124, start, stop) / words, 1),
        np.minimum(_in_ranges(raw == 33, start, stop) / words, 1),
        _in_ranges(upper, start, stop) / np.maximum(_in_ranges(letter, start, stop), 1),
        _in_ranges((raw >= 48) & (raw <= 57), start, stop) / size,
        _in_ranges(echo, low, high) / words,
        _in_ranges(again, low, high) / words,
        copy,
        words < 3,
        np.minimum(np.log1p(words) / 5, 1),
        np.isin(ending, np.frombuffer(b".?!:", np.uint8)),
        edge[:-1],
        edge[1:],
    )
    inside = _in_ranges((raw & 0xC0) != 0x80, starts, stops)
    counts = {
        "n_words": n_words,
        "word_chars": np.bincount(owner, inside, rows).astype(np.int64),
        "n_symbols": _in_ranges(SYMBOLS[raw], ends[:-1], ends[1:]),
        "n_dup_lines": np.bincount(line_row[copy], minlength=rows),
        "n_repeat_words": np.bincount(owner[again], minlength=rows),
    }
    return Lines(line_row, words, np.stack(columns, axis=1).astype(float), counts)


@dataclass
class Field:
    """Weights of the features for boilerplate (content has none) and scores of (from, to) labels: 0 content, 1 boilerplate."""

    weights: np.ndarray
    transitions: np.ndarray


def blank_field() -> Field:
    return Field(np.zeros(len(FEATURES)), np.zeros((2, 2)))


def _steps(row: np.ndarray) -> list[np.ndarray]:
    """The lines that come first in their sequence, second, and so on; longer sequences stand first."""
    if not len(row):
        return []
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(head, len(row)))
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    return [head[: np.searchsorted(-size, -t)] + t for t in range(size[0])]


def viterbi(field: Field, features: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The likeliest labels of the lines of every sequence; content wins ties."""
    emission = features @ field.weights
    steps, back = _steps(row), np.zeros((len(row), 2), np.int8)
    labels = np.zeros(len(row), np.int8)
    for t, at in enumerate(steps):
        if t == 0:
            score = np.stack((np.zeros(len(at)), emission[at]), axis=1)
            last, final = at.copy(), score.copy()
            continue
        via = score[: len(at), :, None] + field.transitions
        back[at] = via.argmax(axis=1)
        score = via.max(axis=1)
        score[:, 1] += emission[at]
        last[: len(at)], final[: len(at)] = at, score
    if not steps:
        return labels
    labels[last] = final.argmax(axis=1)
    for at in reversed(steps[1:]):
        labels[at - 1] = back[at, labels[at]]
    return labels


def likelihood(field: Field, features: np.ndarray, row: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the labels, and its slopes by weights and transitions, from forward and backward passes."""
    emission = np.stack((np.zeros(len(row)), features @ field.weights), axis=1)
    steps = _steps(row)
    forward, backward = np.zeros((len(row), 2)), np.zeros((len(row), 2))
    total = 0.0
    for t, at in enumerate(steps):
        forward[at] = emission[at] if t == 0 else emission[at] + np.logaddexp.reduce(forward[at - 1][:, :, None] + field.transitions, axis=1)
    for at in reversed(steps[1:]):
        backward[at - 1] = np.logaddexp.reduce(field.transitions + (emission[at] + backward[at])[:, None, :], axis=2)
    norm = np.empty(len(row))
    norm[:] = np.logaddexp(*(forward + backward).T)
    if steps:
        total -= norm[steps[0]].sum()
    chance = np.exp(forward + backward - norm[:, None])
    by_weights = features.T @ (labels - chance[:, 1])
    by_transitions = np.zeros((2, 2))
    total += float((emission[np.arange(len(row)), labels]).sum())
    for at in steps[1:]:
        pair = forward[at - 1][:, :, None] + field.transitions + (emission[at] + backward[at])[:, None, :] - norm[at][:, None, None]
        by_transitions -= np.exp(pair).sum(axis=0)
        np.add.at(by_transitions, (labels[at - 1], labels[at]), 1)
        total += field.transitions[labels[at - 1], labels[at]].sum()
    return total, by_weights, by_transitions


def fit(features: np.ndarray, row: np.ndarray, labels: np.ndarray, rounds: int = 400, rate: float = 0.3, decay: float = 1e-5) -> Field:
    """Maximum likelihood with a small quadratic penalty, by Adam over all sequences."""
    field = blank_field()
    if not len(row):
        return field
    parts = [field.weights, field.transitions]
    first, second = [np.zeros(p.shape) for p in parts], [np.zeros(p.shape) for p in parts]
    for step in range(1, rounds + 1):
        _, *slopes = likelihood(field, features, row, labels)
        for p, g, m, v in zip(parts, slopes, first, second):
            g = g / len(row) - decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return field


def fit_on(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` labelled documents, chosen by a hash of the id, in sequences of at most ``SEQUENCE`` lines.

    Rows without an id, text or label are not used. Without any, all lines are content.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    )
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    # The chosen labels are at most ``sample`` rows of two numbers.
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "quality", "text").limit(sample).collect()
    texts, quality = [r.text.encode() for r in rows], np.array([r.quality for r in rows], int)
    lines = read_lines(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))
    head = np.flatnonzero(np.append(True, lines.row[1:] != lines.row[:-1]))[: len(lines.row)] if len(lines.row) else np.empty(0, int)
    nth = np.arange(len(lines.row)) - np.repeat(head, np.diff(np.append(head, len(lines.row))))
    part = lines.row * (len(lines.row) + 1) + nth // SEQUENCE
    return fit(lines.features, part, 1 - quality[lines.row] if len(rows) else np.empty(0, int))


def judged(documents: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """Base counts and verdict of every document, from its whole text.

    ``kept`` is false where the base rules fail (under 50 words, or more than half of the words in
    repeated three-word windows); else it says whether at least ``share`` of the words stand in content
    lines (``content_share``; 1 without words). A null text has no words; repeated rows stay; an empty
    table gives an empty result; other columns are ignored.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            lines = read_lines(*text_bytes(column_of(batch, "text")))
            label = viterbi(field, lines.features, lines.row)
            content = np.bincount(lines.row, lines.words * (label == 0), batch.num_rows)
            n, repeat = lines.counts["n_words"], lines.counts["n_repeat_words"]
            content = np.where(n > 0, content / np.maximum(n, 1), 1.0)
            failed = (n < 50) | (100 * repeat > 50 * n)
            columns = [pa.array(lines.counts[c].astype(np.int64)) for c in names]
            columns += [pa.array(failed), pa.array(~failed & (content >= share)), pa.array(content)]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), *columns], ["doc_id", *names, "base_failed", "kept", "content_share"])

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, content_share double")
