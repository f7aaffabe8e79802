"""Token pieces of documents, packed into sequences by vector bin packing."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from matchform.llm.texts import blocks, column_of

CAPACITY = 1024
SEGMENTS = 64
# Pieces that are packed together; a partition is worked off in runs of this many.
RUN = 1 << 15
# Bytes of words a worker remembers with their ids.
REMEMBERED = 48 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long"


# Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# A space between other white space: the space may belong to the token before it.
BETWEEN = re.compile(r"[^\S ] \s")


def merge_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a byte-level BPE file as bytes; an id is also the rank of the merge that makes its token.

    The file writes each byte as a character: a visible one of Latin-1 as itself, the others in order from 256 on.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model["added_tokens"]}
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in model["model"]["vocab"].items() if token not in special}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    In byte-level BPE a space before a word always begins a token, so a text without two spaces in a row
    may be encoded word by word, each with the space before it, and a word met before is looked up. All
    new words of a call are merged in one go, as one text, by the same file's merges read as ranks, and
    their ids are told apart by the bytes they stand for. Texts where other white space stands on both
    sides of a space, or two spaces in a row, go to the tokenizer itself.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        ranks = merge_ranks(path)
        self.merge = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.limit, self.held, self.words = remembered, 0, {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, word: str) -> bytes:
        return np.array(self.merge(word), "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words, each with the space before it; none is empty or begins with white space."""
        if not words:
            return
        text = " ".join(["", *words])
        ids = np.array(self.merge(text), "<u4")
        sizes = map(len, words) if text.isascii() else (len(w.encode()) for w in words)
        bounds = np.append(0, np.cumsum(np.fromiter(sizes, np.int64, len(words)) + 1))
        ends = np.append(0, np.cumsum(self.sizes[ids]))
        at = np.searchsorted(ends, bounds)
        if (ends[at] != bounds).any():
            raise ValueError("a token spans two words")
        raw, at = ids.tobytes(), (4 * at).tolist()
        self.words.update(zip(words, [raw[a:b] for a, b in pairwise(at)]))
        self.held += len(raw) + 250 * len(words)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; what is remembered is dropped when it grows over the limit, and learnt again."""
        if self.held > self.limit:
            self.words, self.held = {}, 0
        whole = [t for t in texts if "  " in t or BETWEEN.search(t)]
        done = dict(zip(whole, self._raw(whole)))
        split = [None if t in done else t.split(" ") for t in texts]
        new = set().union(*[words[1:] for words in split if words]).difference(self.words, [""])
        self._learn([w for w in new if not w[0].isspace()])
        # A text that ends in a space has an empty last word.
        self.words |= {w: self._alone(" " + w) for w in ("", *(w for w in new if w[0].isspace()))}
        first = {w: self._alone(w) for w in {words[0] for words in split if words}}
        find = self.words.__getitem__
        return [done[t] if words is None else first[words[0]] + b"".join(map(find, words[1:])) for t, words in zip(texts, split)]


@cache
def encoder_of(path: str) -> Encoder:
    """A worker reads the vocabulary once and goes on with the words it remembers."""
    return Encoder(path)


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """The pieces of every document: its ids and a closing id ``end``, cut after every ``capacity`` ids.

    A null text is empty and has the closing id alone; repeated rows have pieces of their own; other
    columns are ignored. The closing id bears no loss. A null ``doc_id`` stays null.
    """
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in blocks(batches):
            row, start, length, crc, total = [], [], [], [], []
            texts = [t or "" for t in column_of(batch, "text").to_pylist()]
            for i, ids in enumerate(encoder.encode(texts)):
                ids += closing
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            start, length, total = (np.array(v, np.int64) for v in (start, length, total))
            columns = [column_of(batch, "doc_id").take(pa.array(row, pa.int64())), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total)]
            columns.append(pa.array(length - (start + length == total)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens"])

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, PIECES)


def fill_bins(length: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of every item under limits on tokens, items and loss-bearing tokens.

    A bin takes, of the items that still fit, one whose demand has the largest dot product with what is
    left of the limits, both as shares of them, until none fits. Items of equal demand are alike, so the
    product is taken once for each kind. An item that exceeds a limit by itself, or has as many tokens as
    a bin may hold, gets a bin of its own.
    """
    full = length >= limits[0]
    if full.any():
        bins, offsets = np.empty(len(length), np.int64), np.zeros(len(length), np.int64)
        bins[full] = np.arange(full.sum())
        rest, offsets[~full] = fill_bins(length[~full], loss[~full], limits)
        bins[~full] = rest + full.sum()
        return bins, offsets
    kinds, kind, count = np.unique(np.stack((length, loss), axis=1), axis=0, return_inverse=True, return_counts=True)
    kind = kind.reshape(-1)
    order = np.argsort(kind, kind="stable")
    following = np.concatenate(([0], np.cumsum(count)[:-1]))
    demand = np.stack((kinds[:, 0], np.ones(len(kinds)), kinds[:, 1])) / np.array(limits, float)[:, None]
    bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    # Kinds lie in the order of their tokens; one that is used up demands more than any bin has.
    (tokens, one, bearing), ladder = demand, kinds[:, 0].copy()
    sizes, following, stock, left_over = kinds[:, 0].tolist(), following.tolist(), count.tolist(), len(length)
    bin_number = 0
    while left_over:
        room_t, room_n, room_l, offset, filled = 1.0, 1.0, 1.0, 0, 0
        while left_over:
            top = int(np.searchsorted(ladder, limits[0] - offset, side="right"))
            product = tokens[:top] * room_t + one[:top] * room_n + bearing[:top] * room_l
            product[(tokens[:top] > room_t + 1e-9) | (bearing[:top] > room_l + 1e-9)] = -1.0
            best = int(product.argmax()) if top and room_n + 1e-9 >= one[0] else -1
            if best < 0 or product[best] < 0:
                if filled:
                    break
                best = next(k for k, c in enumerate(stock) if c)
            item = order[following[best]]
            following[best] += 1
            stock[best] -= 1
            left_over -= 1
            bins[item], offsets[item] = bin_number, offset
            offset += sizes[best]
            filled += 1
            room_t, room_n, room_l = room_t - sizes[best] / limits[0], room_n - one[best], room_l - kinds[best, 1] / limits[2]
            if not stock[best]:
                tokens[best] = bearing[best] = 1e9
        bin_number += 1
    return bins, offsets


def pack(found: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = CAPACITY) -> DataFrame:
    """``found`` (pieces with ``length`` and ``loss_tokens``) with ``sequence_id`` and ``offset``.

    Pieces are dealt over the tasks by a hash of all they carry and packed in runs of bounded size, so
    no key decides where they go. Sequence numbers are unique over all tasks and a repeated task gives
    the same ones. An empty table gives an empty result.
    """
    names = [c for c in found.columns if c not in ("sequence_id", "offset")]
    found = found.select(*names)
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = F.xxhash64(*names)

    def packed(rows: pa.Table, number: int) -> pa.RecordBatch:
        demand = [rows[name].to_numpy().astype(np.int64) for name in ("length", "loss_tokens")]
        bins, offsets = fill_bins(*demand, (capacity, segments, loss))
        first = (TaskContext.get().partitionId() << 40) + number * RUN
        rows = rows.append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))
        return rows.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= RUN:
                rows = pa.Table.from_batches(held)
                yield packed(rows.slice(0, RUN), number)
                held, number = rows.slice(RUN).to_batches(), number + 1
        held = [b for b in held if b.num_rows]
        if held:
            yield packed(pa.Table.from_batches(held), number)

    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = found.withColumn("mark", mark).repartition(tasks, "mark").sortWithinPartitions("mark", *names).drop("mark")
    return dealt.mapInArrow(run, schema)
