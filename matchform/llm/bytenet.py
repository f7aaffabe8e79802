"""Quality classifier: a byte-level convolutional network in numpy, trained here, applied to whole texts.

Filters slide over every byte of a text. Their rectified answers are max-pooled over chunks of ``CHUNK``
positions that overlap by half and together cover the whole text. A hidden layer reads each chunk's pooled
answers and how full the chunk is, so it sees both what a chunk contains (a strong answer) and what it lacks
(weak answers, as in text that repeats one word). The hidden units are max-pooled over all chunks and combined
into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchform.llm.texts import blocks, column_of, text_bytes

WIDTH = 8
HOP = 128
CHUNK = 2 * HOP
PAD = 256
SLAB = 1 << 14
# At most this many labelled documents are collected for fitting.
SAMPLE = 4000
THRESHOLD = 0.7


@dataclass
class Network:
    """Filters (taps, symbols, filters), their offsets, the hidden layer and the output layer."""

    filters: np.ndarray
    offset: np.ndarray
    hidden: np.ndarray
    hidden_offset: np.ndarray
    output: np.ndarray
    output_offset: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.offset, self.hidden, self.hidden_offset, self.output, self.output_offset]


def untrained(filters: int = 16, hidden: int = 16, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        draw(WIDTH, PAD + 1, filters, scale=0.15),
        np.zeros(filters, np.float32),
        draw(filters + 1, hidden, scale=0.4),
        np.full(hidden, 0.1, np.float32),
        draw(hidden, scale=0.3),
        np.zeros(1, np.float32),
    )


@dataclass
class Layout:
    """Texts of a block laid end to end with padding, and the hops and chunks over them."""

    symbols: np.ndarray  # with WIDTH - 1 padding symbols behind every text
    padding: np.ndarray  # positions at which no text byte begins
    hops: np.ndarray  # first position of every hop
    left: np.ndarray  # first hop of every chunk
    right: np.ndarray  # last hop of every chunk
    fill: np.ndarray  # share of a chunk's positions that the text has
    chunk_start: np.ndarray
    chunk_stop: np.ndarray
    first_chunk: np.ndarray  # of every text


def lay_out(raw: np.ndarray, ends: np.ndarray) -> Layout:
    sizes = np.diff(ends)
    room = np.maximum(sizes, 1)  # an empty text has one position of padding
    begin = np.concatenate(([0], np.cumsum(room + WIDTH - 1)))
    symbols = np.full(begin[-1], PAD, np.uint16)
    symbols[np.arange(len(raw)) + np.repeat(begin[:-1] - ends[:-1], sizes)] = raw
    padding = (begin[:-1] + room)[:, None] + np.arange(WIDTH - 1)
    hop_count = -(-room // HOP)
    first_hop = np.concatenate(([0], np.cumsum(hop_count)))
    inside = np.arange(first_hop[-1]) - np.repeat(first_hop[:-1], hop_count)
    hops = np.repeat(begin[:-1], hop_count) + HOP * inside
    chunk_count = np.maximum(hop_count - 1, 1)
    first_chunk = np.concatenate(([0], np.cumsum(chunk_count)))
    nth = np.arange(first_chunk[-1]) - np.repeat(first_chunk[:-1], chunk_count)
    left = np.repeat(first_hop[:-1], chunk_count) + nth
    right = np.minimum(left + 1, np.repeat(first_hop[1:], chunk_count) - 1)
    start = hops[left]
    stop = np.minimum(start + CHUNK, np.repeat(begin[:-1] + room, chunk_count))
    fill = ((stop - start) / CHUNK).astype(np.float32)
    return Layout(symbols, padding.ravel(), hops, left, right, fill, start, stop, first_chunk[:-1])


def answers(net: Network, symbols: np.ndarray) -> np.ndarray:
    """The filters' rectified answers at every position; past the end of the block all is padding."""
    reach = np.concatenate((symbols, np.full(WIDTH - 1, PAD, np.uint16)))
    out = np.empty((len(symbols), net.filters.shape[2]), np.float32)
    buffer = np.empty((min(SLAB, len(symbols)), out.shape[1]), np.float32)
    for at in range(0, len(symbols), SLAB):
        part = out[at : at + SLAB]
        part[:] = net.offset
        for tap in range(WIDTH):
            some = buffer[: len(part)]
            np.take(net.filters[tap], reach[at + tap : at + tap + len(part)], axis=0, out=some, mode="clip")
            part += some
        np.maximum(part, 0, out=part)
    return out


def forward(net: Network, laid: Layout) -> tuple[np.ndarray, ...]:
    found = answers(net, laid.symbols)
    found[laid.padding] = 0
    pooled_hops = np.maximum.reduceat(found, laid.hops, axis=0)
    pooled = np.maximum(pooled_hops[laid.left], pooled_hops[laid.right])
    features = np.concatenate((pooled, laid.fill[:, None]), axis=1)
    hidden = np.maximum(features @ net.hidden + net.hidden_offset, 0)
    document = np.maximum.reduceat(hidden, laid.first_chunk, axis=0)
    return found, features, hidden, document, document @ net.output + net.output_offset[0]


def probabilities(net: Network, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(ends) == 1:
        return np.empty(0)
    logit = forward(net, lay_out(raw, ends))[-1].astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    laid = lay_out(np.frombuffer(b"".join(texts), np.uint8), ends)
    found, features, hidden, document, logit = forward(net, laid)
    slope = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels).astype(np.float32) / len(texts)
    by_output, by_output_offset = document.T @ slope, slope.sum(keepdims=True)
    back = np.zeros_like(hidden)
    last = np.concatenate((laid.first_chunk[1:], [len(hidden)]))
    units = np.arange(hidden.shape[1])
    for row, (a, b) in enumerate(zip(laid.first_chunk, last)):
        best = a + hidden[a:b].argmax(axis=0)
        live = hidden[best, units] > 0
        back[best[live], units[live]] = slope[row] * net.output[live]
    by_hidden, by_hidden_offset = features.T @ back, back.sum(axis=0)
    by_pooled = back @ net.hidden[:-1].T
    by_filters, by_offset = np.zeros(net.filters.size), np.zeros_like(net.offset)
    count = net.filters.shape[2]
    units, taps = np.arange(count), np.arange(WIDTH)
    reach = np.concatenate((laid.symbols, np.full(WIDTH - 1, PAD, np.uint16)))
    places, weights = [], []
    for c in np.flatnonzero(back.any(axis=1)):
        best = laid.chunk_start[c] + found[laid.chunk_start[c] : laid.chunk_stop[c]].argmax(axis=0)
        live = found[best, units] > 0
        best, unit, flow = best[live], units[live], by_pooled[c, live]
        by_offset[unit] += flow
        places.append(((taps * (PAD + 1) + reach[best[:, None] + taps]) * count + unit[:, None]).ravel())
        weights.append(np.repeat(flow, WIDTH))
    if places:
        by_filters = np.bincount(np.concatenate(places), np.concatenate(weights), net.filters.size)
    return [by_filters.reshape(net.filters.shape), by_offset, by_hidden, by_hidden_offset, by_output, by_output_offset]


def _short_piece(text: bytes, rng: np.random.Generator) -> bytes:
    """Up to a dozen neighbouring words."""
    words = text.split(b" ")
    at = rng.integers(len(words))
    return b" ".join(words[at : at + rng.integers(1, 13)])


def fit(
    texts: list[bytes], labels: list[int], steps: int = 700, size: int = 48, pieces: int = 8, rate: float = 0.01, seed: int = 7
) -> Network:
    """Train on labelled texts (1: keep) by Adam; each step draws as many texts of one label as of the other.

    Few good texts are very short, so every step adds ``pieces`` of a few words each, cut from good ones.
    """
    net, rng = untrained(seed=seed), np.random.default_rng(seed)
    labels = np.asarray(labels)
    sides = [np.flatnonzero(labels == side) for side in (0, 1)]
    sides = [side for side in sides if len(side)]
    if not sides:
        return net
    first = [np.zeros(p.shape) for p in net.parts()]
    second = [np.zeros(p.shape) for p in net.parts()]
    for step in range(1, steps + 1):
        drawn = np.concatenate([rng.choice(side, size // len(sides)) for side in sides])
        pace = rate * min(1, 2 * (1 - step / (steps + 1)))
        batch, marks = [texts[i] for i in drawn], labels[drawn]
        good = drawn[marks == 1][:pieces]
        batch += [_short_piece(texts[i], rng) for i in good]
        marks = np.concatenate((marks, np.ones(len(good), marks.dtype)))
        for p, g, m, v in zip(net.parts(), _gradients(net, batch, marks), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from training; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_on(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on at most ``sample`` labelled documents that are not held out, chosen by a hash of the id.

    Rows without an id, text or label are not used; of repeated ids any row may be.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    )
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    # The chosen labels are at most ``sample`` rows of two numbers.
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "quality", "text").limit(sample).collect()
    return fit([r.text.encode() for r in rows], [r.quality for r in rows])


def scores(documents: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document, from all bytes of its text.

    A null text is empty and is scored like one; repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            score = probabilities(net, *text_bytes(column_of(batch, "text")))
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), column_of(batch, "held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(documents: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score at least ``threshold``."""
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield batch.filter(pa.array(probabilities(net, *text_bytes(batch.column(at))) >= threshold))

    return documents.mapInArrow(run, documents.schema)
