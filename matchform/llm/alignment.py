"""Alignment of two tokenizers: groups of tokens that end together, and how often two ids lie over each other.

Both tokenizers always begin a token at a single space between two characters that are not white space, so a text
is cut there and every piece of it is encoded and aligned once per task; new pieces are joined again and encoded in one
go. What is found is written in bundles. Pair counts are summed as dense vectors indexed by a minimal perfect hash of
the distinct pairs; a second pass reads the bundles and looks the pairs up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from matchform.llm.bundles import packed, small, unpacked
from matchform.llm.packing import PATTERN, merge_ranks
from matchform.llm.texts import blocks, column_of, discard, mixed, release, stored
from matchform.session import checkpointed

# A single space between two characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
# A space beside other white space.
AFTER, BEFORE = re.compile(r" \s"), re.compile(r"\s ")
# Longer pieces go to the tokenizer itself, whose time does not grow with the square of the length.
LONG_PIECE = 200
# Pieces a task remembers with their alignment, and their characters.
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 1 << 24
# Pieces that sentencepiece gets as one text, and fewest pieces that are tried together once one of them has failed.
SENTENCE, FEWEST = 32, 64
# Text that is worked off at once, and pairs of several blocks that are added up together.
BLOCK, SUMMED = 1 << 21, 1 << 21
# Pairs of one hash function; bits of a level for each key in it; partial vectors added at once; bytes of pair tables in a worker.
SHARD_PAIRS, LOAD, FAN_IN, TABLE_BYTES = 1 << 16, 2, 16, 128 << 20

COUNTS = "pair long, spread long, source long, times long"
FUNCTION = "shard long, sizes binary, bits binary, keys binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def cut(text: str) -> list[str]:
    """The pieces of a text; most texts have no space beside other white space, and every space cuts them."""
    if text[0] == " " or text[-1] == " " or AFTER.search(text) or BEFORE.search(text):
        return CUT.split(text)
    return text.split(" ")


@dataclass(frozen=True)
class Aligned:
    """Alignments of several pieces of text: a row for each, and the linked pairs of all of them in order."""

    pieces: list[str]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    exact: np.ndarray
    pairs: np.ndarray
    groups: list[bytes]


class Aligner:
    """Encodes pieces with both tokenizers and aligns their tokens by the bytes they stand for."""

    def __init__(self, a_path: str, b_path: str):
        ranks = merge_ranks(a_path)
        self.merge = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(a_path)
        self.whole.encode_special_tokens = True
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(t) for t in tokens]) for tokens in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = list(map(str, range(len(self.a_bytes)))), [f"|{i}" for i in range(len(self.b_bytes))]

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _a_ids(self, piece: str) -> list[int]:
        return self.merge(piece) if len(piece) <= LONG_PIECE else self.whole.encode(piece, add_special_tokens=False).ids

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of both kinds, how many of them each piece has, and whether their bytes give it back: one by one."""
        a_ids, b_ids = [self._a_ids(" " + p) for p in pieces], self.b.encode(pieces, num_threads=1)
        exact = np.ones(len(pieces), bool)
        for all_ids, tokens in ((a_ids, self.a_bytes), (b_ids, self.b_bytes)):
            exact &= np.array([b"".join(map(tokens.__getitem__, ids)) == b" " + p.encode() for ids, p in zip(all_ids, pieces)], bool)
        a, b = (np.array([*chain.from_iterable(all_ids)], np.int64) for all_ids in (a_ids, b_ids))
        return a, b, *(np.array([len(ids) for ids in all_ids], np.int64) for all_ids in (a_ids, b_ids)), exact

    def _together(self, pieces: list[str]) -> list[tuple[np.ndarray, ...]]:
        """The same of pieces that neither begin nor end with white space, encoded as one text; parts of them where that fails."""
        if not pieces:
            return []
        whole = " ".join(["", *pieces])
        raw = whole.encode()
        sizes = map(len, pieces) if len(raw) == len(whole) else (len(p.encode()) for p in pieces)
        bounds = np.cumsum(np.fromiter(sizes, np.int64, len(pieces)) + 1)
        sentences = [" ".join(pieces[at : at + SENTENCE]) for at in range(0, len(pieces), SENTENCE)]
        a_ids, b_ids = self.merge(whole), [*chain.from_iterable(self.b.encode(sentences, num_threads=1))]
        found, counts = [], []
        for ids, tokens, size in ((a_ids, self.a_bytes, self.a_size), (b_ids, self.b_bytes, self.b_size)):
            found.append(np.array(ids, np.int64))
            ends = np.cumsum(size[found[-1]])
            at = np.searchsorted(ends, bounds)
            if not len(ends) or ends[-1] != len(raw) or (ends[at] != bounds).any() or b"".join(map(tokens.__getitem__, ids)) != raw:
                if len(pieces) <= FEWEST:
                    return [self._alone(pieces)]
                middle = len(pieces) // 2
                return self._together(pieces[:middle]) + self._together(pieces[middle:])
            counts.append(np.diff(at, prepend=-1))
        return [(*found, *counts, np.ones(len(pieces), bool))]

    def align(self, pieces: list[str], texts: bool = True) -> Aligned:
        """Alignments of pieces, each with a space ahead of it, in an order of its own; ``texts`` also writes the groups."""
        plain = [len(p) <= LONG_PIECE and not (p[0].isspace() or p[-1].isspace()) for p in pieces]
        joined, others = ([p for p, own in zip(pieces, plain) if own is side] for side in (True, False))
        parts = [*self._together(joined), *([self._alone(others)] if others else [])]
        pieces = joined + others
        a, b, n_a, n_b, exact = (np.concatenate(columns) for columns in zip(*parts))
        if not exact.all():
            a, b = a[np.repeat(exact, n_a)], b[np.repeat(exact, n_b)]
            n_a, n_b = n_a * exact, n_b * exact
        # Between two ends of either kind lie the bytes of one token of each.
        marks, before = [], []
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        for stops in (a_ends, b_ends):
            marks.append(np.zeros(int(stops[-1]) + 1 if len(stops) else 1, bool))
            marks[-1][stops] = True
            before.append(np.cumsum(marks[-1]) - marks[-1])
        ends = np.flatnonzero(marks[0] | marks[1])
        at_a, at_b = (v[ends] for v in before)
        owner = np.repeat(np.arange(len(pieces)), n_a)[at_a]
        both = np.flatnonzero(marks[0][ends] & marks[1][ends])
        n_groups = np.bincount(owner[both], minlength=len(pieces))
        groups = self._written(a, b, at_a[both] + 1, at_b[both] + 1, n_groups) if texts else []
        return Aligned(pieces, n_a, n_b, n_groups, np.bincount(owner, minlength=len(pieces)), exact, a[at_a] << 32 | b[at_b], groups)

    def _written(self, a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray, n_groups: np.ndarray) -> list[bytes]:
        x, y = list(map(self.a_text.__getitem__, a.tolist())), list(map(self.b_text.__getitem__, b.tolist()))
        since_a, since_b, found = 0, 0, []
        for stop_a, stop_b in zip(a_stops.tolist(), b_stops.tolist()):
            if stop_a - since_a == 1 == stop_b - since_b:
                found.append(x[since_a] + y[since_b])
            else:
                found.append(f"{','.join(x[since_a:stop_a])}{y[since_b]}{''.join(y[since_b + 1 : stop_b]).replace('|', ',')}")
            since_a, since_b = stop_a, stop_b
        stops = np.cumsum(n_groups).tolist()
        return [";".join(found[i:j]).encode() for i, j in zip([0, *stops], stops)]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """A worker reads the vocabularies once."""
    return Aligner(a_path, b_path)


class Remembered:
    """Pieces met so far, numbered, with arrays of what is known of each; forgotten when they are too many."""

    def __init__(self, own: Aligner, texts: bool):
        self.own, self.texts = own, texts
        self.forget()

    def forget(self) -> None:
        self.number, self.groups, self.chars = {}, [], 0
        self.known = {n: np.empty(0, bool if n == "exact" else np.int64) for n in ("n_a", "n_b", "n_groups", "n_links", "exact", "pairs")}

    def full(self) -> bool:
        return len(self.number) > REMEMBERED or self.chars > REMEMBERED_CHARS

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of the pieces of every text; a text without characters has none."""
        words = [cut(t) if t else [] for t in texts]
        new = list(set().union(*words) - self.number.keys())
        if new:
            found = self.own.align(new, self.texts)
            self.known = {n: np.concatenate((v, getattr(found, n))) for n, v in self.known.items()}
            self.groups += found.groups
            self.number.update(zip(found.pieces, range(len(self.number), len(self.number) + len(new))))
            self.chars += sum(map(len, new))
        find = self.number.__getitem__
        return [np.fromiter(map(find, own), np.int64, len(own)) for own in words]


def spread_of(pairs: np.ndarray) -> np.ndarray:
    """What deals pairs over shards."""
    return (mixed(pairs) >> np.uint64(33)).astype(np.int64)


def _source(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, so many at a time."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(sizes, dtype=np.int64))])


# The arrays of a bundle: its documents' ids, which of them are null, their sums and digests, how many pieces each has and
# which, how many links a piece has and where their pairs stand, the distinct pairs, and how many links of the documents hold each.
BUNDLE = ("ids", "null", "n_a", "n_b", "n_groups", "n_links", "digests", "sizes", "pieces", "links", "place", "pairs", "times")


def _bundle(ids: pa.Array, found: list[np.ndarray], memory: Remembered) -> bytes:
    """What the second pass needs of a block of documents, whose pieces have these numbers."""
    known = memory.known
    used = [own if known["exact"][own].all() else own[:0] for own in found]
    sizes, flat = np.array([len(own) for own in used], np.int64), np.concatenate(used)
    digests = [hashlib.sha256(b";".join(map(memory.groups.__getitem__, own.tolist()))).digest() if len(own) else bytes(32) for own in used]
    seen = np.zeros(len(memory.number), bool)
    seen[flat] = True
    own, pieces = np.flatnonzero(seen), (np.cumsum(seen) - 1)[flat]
    links, first = known["n_links"][own], (np.cumsum(known["n_links"]) - known["n_links"])[own]
    at = np.arange(links.sum()) + np.repeat(first - (np.cumsum(links) - links), links)
    pairs, place = np.unique(known["pairs"][at], return_inverse=True)
    times = np.bincount(place, np.repeat(np.bincount(pieces, minlength=len(own)), links), len(pairs)).astype(np.int64)
    sums = [small(_sums(known[n][flat], sizes)) for n in BUNDLE[2:6]]
    null = ids.is_null().to_numpy(zero_copy_only=False)
    return packed([ids.fill_null(0).to_numpy(), null, *sums, np.frombuffer(b"".join(digests), np.uint8), small(sizes), small(pieces), small(links), small(place), pairs, small(times)])


def _opened(data: bytes) -> dict[str, np.ndarray]:
    return dict(zip(BUNDLE, unpacked(data)))


def bundles(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``data``, a row for every block of documents: see ``BUNDLE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Remembered(aligner(a_path, b_path), True)
        for batch in blocks(batches, limit=BLOCK):
            found = memory.numbers(column_of(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([_bundle(column_of(batch, "doc_id"), found, memory)], pa.binary())], ["data"])
            if memory.full():
                memory.forget()

    return _source(documents).mapInArrow(run, "data binary")


def partial_counts(written: DataFrame) -> DataFrame:
    """For every task the pairs ``a << 32 | b`` of its bundles and how many links hold each."""

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        total = np.bincount(place, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)
        source = np.full(len(pairs), TaskContext.get().partitionId())
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (pairs, spread_of(pairs), source, total)], ["pair", "spread", "source", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for data in column_of(batch, "data"):
                own = _opened(data.as_py())
                held.append((own["pairs"], own["times"]))
                if sum(len(p) for p, _ in held) >= SUMMED:
                    yield added(held)
                    held = []
        if held:
            yield added(held)

    return written.mapInArrow(run, COUNTS)


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mixed(keys.astype(np.uint64) ^ np.uint64((0x9E6C63D0876A9A47 * (level + 1)) % 2**64))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes in bits, the bits of all levels as 64-bit words, and the keys in the order of their slots.

    In a level a key that shares its bit with no other sets it; the others go on to the next. A key's slot is the
    number of set bits before its own.
    """
    sizes, bits, placed, level = [], [], [], 0
    while len(keys):
        size = -(-max(64, LOAD * len(keys)) // 64) * 64
        place = (_level_hash(keys, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        mine = alone[place]
        placed.append(keys[mine][np.argsort(place[mine])])
        bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        keys, level = keys[~mine], level + 1
    none = np.empty(0, np.int64)
    return np.array(sizes, np.int64), np.concatenate([np.empty(0, np.uint64), *bits]), np.concatenate([none, *placed])


class PairTable:
    """Dense vectors of several shards behind their hash functions; what is looked up is verified by its key."""

    def __init__(self, shards: int, rows: list[dict]):
        """``rows`` have ``shard``, ``sizes``, ``bits``, ``keys`` and perhaps ``counts`` as bytes."""
        sizes = [np.frombuffer(r["sizes"], np.int64) for r in rows]
        self.words = np.concatenate([np.frombuffer(r["bits"], np.uint64) for r in rows])
        self.keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
        self.counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]) if "counts" in rows[0] else None
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.levels = max(map(len, sizes))
        self.size = np.array([[*s, *[0] * (self.levels - len(s))] for s in sizes], np.int64)
        flat = self.size.reshape(-1)
        self.start = (np.cumsum(flat) - flat).reshape(self.size.shape)
        self.own = np.full(shards, -1)
        self.own[[r["shard"] for r in rows]] = np.arange(len(rows))

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        """Slots of pairs; -1 for pairs of other shards."""
        own = self.own[spread_of(pairs) % len(self.own)]
        slot, todo = np.full(len(pairs), -1), np.flatnonzero(own >= 0)
        for level in range(self.levels):
            row = own[todo]
            size = np.maximum(self.size[row, level], 1)
            place = self.start[row, level] + (_level_hash(pairs[todo], level) % size.astype(np.uint64)).astype(np.int64)
            word = self.words[np.minimum(place >> 6, len(self.words) - 1)]
            bit = (place & 63).astype(np.uint64)
            hit = (self.size[row, level] > 0) & ((word >> bit) & np.uint64(1) == 1)
            inside = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[todo[hit]] = self.before[place[hit] >> 6] + inside[hit]
            todo = todo[~hit]
        seen = slot >= 0
        if len(todo) or not np.array_equal(self.keys[slot[seen]], pairs[seen]):
            raise KeyError("a pair that was never counted")
        return slot


def _function(rows: pa.Table) -> pa.Table:
    """The hash function of a shard's pairs."""
    parts = [v.tobytes() for v in perfect_hash(np.sort(rows["pair"].to_numpy()))]
    return pa.table({"shard": rows["shard"].slice(0, 1), **{n: pa.array([v], pa.binary()) for n, v in zip(("sizes", "bits", "keys"), parts)}})


def _vector(shards: int):
    """The dense vector of a part of the counts, by its shard's function."""

    def run(function: pa.Table, counts: pa.Table) -> pa.Table:
        rows = function.select(["shard", "sizes", "bits", "keys"]).to_pylist()
        table = PairTable(shards, rows)
        vector = np.zeros(len(table.keys), np.int64)
        if counts.num_rows:
            np.add.at(vector, table.slots(counts["pair"].to_numpy()), counts["times"].to_numpy())
        return pa.table({"shard": function["shard"], "part": function["part"], "counts": pa.array([vector.tobytes()], pa.binary())})

    return run


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer(), np.int64) for v in rows["counts"])
    return pa.table({"shard": rows["shard"].slice(0, 1), "part": rows["next"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def pair_tables(counts: DataFrame) -> tuple[DataFrame, int]:
    """The written tables of all shards (``shard``, ``sizes``, ``bits``, ``keys``, ``counts``), and how many shards there are.

    A shard has about 65,536 pairs. Its counts are added up in parts of about as many rows as 16 tasks send it, and
    the parts' vectors sixteen at a time.
    """
    distinct = checkpointed(counts.select("pair", "spread").distinct())
    pairs = distinct.count()
    shards = max(1, ceil(pairs / SHARD_PAIRS))
    shard = (F.col("spread") % shards).alias("shard")
    functions = checkpointed(distinct.select("pair", shard).groupBy("shard").applyInArrow(_function, FUNCTION))
    parts = max(1, ceil(counts.count() / max(1, pairs) / FAN_IN))
    spread_parts = functions.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    given = counts.select("pair", "times", shard, (F.col("source") % parts).alias("part"))
    vectors = spread_parts.groupBy("shard", "part").cogroup(given.groupBy("shard", "part")).applyInArrow(_vector(shards), "shard long, part long, counts binary")
    while parts > 1:
        vectors = vectors.withColumn("next", F.floor(F.col("part") / FAN_IN)).groupBy("shard", "next").applyInArrow(_added, "shard long, part long, counts binary")
        parts = ceil(parts / FAN_IN)
    return checkpointed(functions.join(vectors.drop("part"), "shard")), shards


def best_counts(tables: DataFrame) -> DataFrame:
    """``b`` and its ``best``: the highest count of a pair with this id; a row for each id that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(column_of(batch, "keys"), column_of(batch, "counts")):
                b = np.frombuffer(keys.as_buffer(), np.int64) & 0xFFFFFFFF
                own, place = np.unique(b, return_inverse=True)
                best = np.zeros(len(own), np.int64)
                np.maximum.at(best, place, np.frombuffer(counts.as_buffer(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(best)], ["b", "best"])

    return tables.select("keys", "counts").mapInArrow(run, "b long, best long").groupBy("b").agg(F.max("best").alias("best"))


def _looked_up(written: DataFrame, extra, last: bool) -> DataFrame:
    """A pass that adds what one table knows of every document's links; the last one returns the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best = extra.value
        for batch in batches:
            for data, sums in zip(column_of(batch, "data"), column_of(batch, "sums")):
                own = _opened(data.as_py())
                slot = table.slots(own["pairs"])
                inside = slot >= 0
                counts = np.where(inside, table.counts[slot], 0) if len(table.counts) else np.zeros(len(slot), np.int64)
                highest = inside & (counts == best[own["pairs"] & 0xFFFFFFFF])
                # From pairs to links, to pieces, to documents.
                found = [_sums(_sums(v.astype(np.int64)[own["place"]], own["links"])[own["pieces"]], own["sizes"]) for v in (highest, counts)]
                found = np.stack(found) + (np.frombuffer(sums.as_py(), np.int64).reshape(2, -1) if len(sums.as_py()) else 0)
                if last:
                    raw = own["digests"].tobytes()
                    digests = [raw[32 * k : 32 * k + 32].hex() if size else "" for k, size in enumerate(own["sizes"].tolist())]
                    counted = [own[n].astype(np.int64) for n in BUNDLE[2:6]]
                    names = [part.split()[0] for part in RESULT.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(own["ids"], mask=own["null"]), *map(pa.array, (*counted, *found)), pa.array(digests, pa.string())], names)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (data.as_py(), found.tobytes())], ["data", "sums"])

    return written.mapInArrow(run, RESULT if last else "data binary, sums binary")


def aligned(documents: DataFrame, a_path: str, b_path: str, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Token counts, groups and pair statistics of every document: see ``RESULT`` for the columns.

    ``a_path`` names a byte-level BPE file, ``b_path`` a sentencepiece model; A reads a space and the text, B the text,
    to which it adds the space. A null or empty text, and one whose tokens do not give back its bytes, has no tokens:
    zeros, an empty digest, and no part in the counts. Repeated rows count and are returned as often as they occur, a
    null ``doc_id`` stays null, an empty table gives an empty result, and other columns are ignored.

    The documents are aligned once. Pair tables go to the workers in parts of at most ``table_bytes`` (of whole
    shards); where they are larger, the bundles are read once for each part.
    """
    spark = documents.sparkSession
    written = stored(bundles(documents, a_path, b_path))
    tables, shards = pair_tables(checkpointed(partial_counts(written)))
    release(spark)
    found = best_counts(tables).toArrow()
    best = np.zeros(aligner(a_path, b_path).b.get_piece_size(), np.int64)
    best[found["b"].to_numpy()] = found["best"].to_numpy()
    sizes = tables.select("shard", (F.length("bits") + F.length("keys") + F.length("counts")).cast("long").alias("bytes"))
    parts, room = [[]], table_bytes
    for row in sizes.orderBy("shard").toLocalIterator():
        if row.bytes > room and parts[-1]:
            parts.append([])
            room = table_bytes
        parts[-1].append(row.shard)
        room -= row.bytes
    frame = written.withColumn("sums", F.lit(b""))
    for k, members in enumerate(parts):
        rows = tables.where(F.col("shard").between(members[0], members[-1])).toArrow().to_pylist() if members else []
        table = PairTable(shards, rows or [{"shard": 0, "sizes": b"", "bits": bytes(8), "keys": b"", "counts": b""}])
        frame = _looked_up(frame, spark.sparkContext.broadcast((table, best)), k == len(parts) - 1)
        if k < len(parts) - 1:
            frame = stored(frame)
            discard(written)
            written = frame
    return frame


def pair_counts(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a``, ``b`` and ``links``: every pair of ids that lie over each other in the documents, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(column_of(batch, "keys"), column_of(batch, "counts")):
                pairs = np.frombuffer(keys.as_buffer(), np.int64)
                columns = (pairs >> 32, pairs & 0xFFFFFFFF, np.frombuffer(counts.as_buffer(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "links"])

    tables, _ = pair_tables(checkpointed(partial_counts(bundles(documents, a_path, b_path))))
    return tables.select("keys", "counts").mapInArrow(run, "a long, b long, links long")
