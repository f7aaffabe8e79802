"""Substring dedup: repeated word sequences from prefix-partitioned suffix trees.

The suffixes that begin a window are split into groups by the words they all run into first (see ``repeats``), a key
that is lengthened to the whole window where a group outgrows memory. A group's suffixes form a subtree that is built
from the top: every step reads some more words of the suffixes of each open node and splits it by them. A node with
one suffix is closed, for nothing below it repeats. The nodes still open at the depth of a window are the deep
internal nodes: the suffixes below one share that many words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchform.llm.repeats import Groups, Windows, covered, repeated
from matchform.llm.texts import RangeHash, blocks, column_of, mixed, public_id, text_bytes, word_spans

WORDS = 50
GRAM = 8


def deep_nodes(symbols: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The node at ``depth`` of the suffixes that begin at ``starts``; -1 for a suffix that stands alone."""
    edge = RangeHash(symbols)
    node = np.zeros(len(starts), np.int64)
    open_, at, step = np.arange(len(starts)), 0, 1
    while at < depth and len(open_):
        step = min(step, depth - at)
        begin = starts[open_] + at
        label = mixed(edge(begin, begin + step) + node[open_].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, child, below = np.unique(label, return_inverse=True, return_counts=True)
        node[open_] = np.where(below[child] > 1, child, -1)
        open_ = open_[below[child] > 1]
        at, step = at + step, at + step
    return node


def subtrees(depth: int):
    """Classes of windows by deep node; a suffix that stands alone has a class of its own."""

    def classify(symbols: np.ndarray, bounds: np.ndarray, windows: np.ndarray) -> np.ndarray:
        starts = np.repeat(bounds[:-1] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        node = deep_nodes(symbols, starts, depth)
        alone = np.flatnonzero(node < 0)
        node[alone] = node.max(initial=-1) + 1 + np.arange(len(alone))
        return node

    return classify


def _with_spans(documents: DataFrame, words: int, gram: int) -> DataFrame:
    kind = Windows(words, min(gram, words), True)
    return repeated(documents, kind, Groups(kind, subtrees(words)), elsewhere=False)


def removed_words(documents: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every document.

    A word goes if a window of ``words`` words that covers it also stands in a document with a smaller
    id. A null text has no words; a null id counts as larger than all and is given back as null; rows
    that repeat an id never remove each other's words; an empty table gives an empty result; columns
    other than ``doc_id`` and ``text`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            raw, ends = text_bytes(column_of(batch, "text"))
            starts, stops, first = word_spans(raw, ends)
            gone = covered(column_of(batch, "spans"), first, len(starts))
            digests, lost = [], []
            for row in range(batch.num_rows):
                a, b = first[row], first[row + 1]
                own = gone[a:b]
                lost.append(int(own.sum()))
                kept = raw[ends[row] : ends[row + 1]].tobytes().split()
                if lost[-1]:
                    kept = [w for w, out in zip(kept, own.tolist()) if not out]
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), pa.array(np.diff(first)), pa.array(lost, pa.int64()), pa.array(digests)],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    found = _with_spans(documents, words, gram)
    return public_id(found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def without_repeats(documents: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """The documents without such words: text is cut from a removed word to the next kept one.

    A document that loses all its words goes; one that had none stays. All columns stay, and an
    ``n_chars`` column is counted anew for the texts that change.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            raw, ends = text_bytes(column_of(batch, "text"))
            starts, _, first = word_spans(raw, ends)
            gone = covered(column_of(batch, "spans"), first, len(starts))
            texts = column_of(batch, "text").to_pylist()
            for row in range(batch.num_rows):
                own = gone[first[row] : first[row + 1]]
                if not own.any():
                    continue
                if own.all():
                    texts[row] = None
                    continue
                cut = np.append(starts[first[row] : first[row + 1]], ends[row + 1])
                lead = [] if own[0] else [raw[ends[row] : cut[0]].tobytes()]
                kept = [raw[a:b].tobytes() for a, b in zip(cut[np.flatnonzero(~own)], cut[np.flatnonzero(~own) + 1])]
                texts[row] = b"".join(lead + kept).decode().rstrip()
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), column_of(batch, "version"), pa.array(texts, pa.string())], ["doc_id", "version", "cut"])

    found = _with_spans(documents, words, gram).where("spans is not null").select("doc_id", "version", "text", "spans")
    changed = found.mapInArrow(run, "doc_id long, version long, cut string").dropDuplicates(["doc_id", "version"])
    key = (F.coalesce(F.col("d.doc_id").cast("long"), F.lit(2**63 - 1)) == F.col("c.doc_id")) & (
        F.xxhash64(F.coalesce(F.col("d.text").cast("string"), F.lit(""))) == F.col("c.version")
    )
    joined = documents.alias("d").join(changed.alias("c"), key, "left").where("c.doc_id is null or c.cut is not null")
    columns = {n: F.col(f"d.`{n}`") for n in documents.columns}
    columns["text"] = F.coalesce("c.cut", "d.text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("c.cut").isNotNull(), F.length("c.cut").cast(documents.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return joined.select(*[c.alias(n) for n, c in columns.items()])
