"""Phrases whose words keep together, by sorting suffix pointers.

A suffix pointer is a place in a piece of text, seen as its next four words. Pointers are dealt out by their leading
words and sorted by multikey three-way quicksort: a partition whose members agree in their first words is a phrase,
and its size the phrase's count. Partitions that cannot hold a frequent phrase are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from matchform.llm.bundles import HashBits, Ranks, cut_out, heads, joined
from matchform.llm.decontaminate import FOLD
from matchform.llm.texts import RangeHash, blocks, column_of, mixed, release, text_bytes, word_spans
from matchform.session import checkpointed

# Bytes that end a piece, and those that separate its words.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
BETWEEN = PIECE_END.copy()
BETWEEN[[0x20, 0x09]] = True

LONGEST, LEAST, SHARE, SCALE, TOP = 4, 30, 80, 2_000_000, 2000
NO_LANG = "und"
# Words whose pointers are summed before they are sent, pointers of a bucket, the most leading phrases dealt out further.
RUN, BUCKET, HOT = 1 << 20, 1 << 19, 1 << 16
# Parts in which a language's best are found before all of them are ranked.
PARTS = 64
WORDS = "lang string, word string, hash long, leading int, times long"
PHRASES = "words array<long>, times long"


class Words:
    """Words of several texts: their hashes by language, the number of their piece, and where they stand."""

    def __init__(self, batch: pa.RecordBatch):
        raw, ends = text_bytes(column_of(batch, "text"))
        self.raw = FOLD[raw]
        self.starts, self.stops, first = word_spans(self.raw, ends, BETWEEN)
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        lang = column_of(batch, "lang").dictionary_encode()
        self.names = lang.dictionary.to_pylist()
        seeds = np.array([xxhash.xxh64_intdigest(name.encode()) for name in self.names], np.uint64)
        self.lang = lang.indices.to_numpy()[row]
        hashes = mixed(RangeHash(self.raw)(self.starts, self.stops) ^ seeds[self.lang]) if len(row) else np.empty(0, np.uint64)
        self.hashes = np.maximum(hashes, np.uint64(1))  # zero says that a piece has ended
        self.pieces = np.cumsum(PIECE_END[self.raw])[self.starts] + row if len(row) else row


def _source(documents: DataFrame) -> DataFrame:
    """Texts (null: empty) with their language (null: ``und``)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    return documents.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[Words]]:
    """Words of consecutive blocks, about ``limit`` at a time."""
    held, size = [], 0
    for batch in blocks(batches):
        held.append(Words(batch))
        size += len(held[-1].hashes)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _leading(run: list[Words]) -> Iterator[tuple[int, np.ndarray]]:
    """For two and three words the hash of every phrase of that length."""
    two, three = [], []
    for own in run:
        same = own.pieces[1:] == own.pieces[:-1]
        pair = joined(own.hashes[:-1], own.hashes[1:])
        two.append(pair[same])
        three.append(joined(pair[:-1], own.hashes[2:])[same[:-1] & same[1:]])
    yield 2, np.concatenate(two)
    yield 3, np.concatenate(three)


def word_counts(documents: DataFrame, limit: int = RUN) -> DataFrame:
    """Counts from each run of texts: of every word; of all words of a language (null ``word``); of frequent leading phrases."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, limit):
            totals = {}
            for own in run:
                for k, n in enumerate(np.bincount(own.lang, minlength=len(own.names)).tolist()):
                    totals[own.names[k]] = totals.get(own.names[k], 0) + n
            names = list(totals)
            yield _counts(pa.array(names, pa.string()), pa.nulls(len(names), pa.string()), np.zeros(len(names), np.int64), 0, np.array(list(totals.values()), np.int64))
            hashes = np.concatenate([own.hashes for own in run])
            found, first, times = np.unique(hashes, return_index=True, return_counts=True)
            shift = np.cumsum([0, *(len(own.raw) for own in run)])
            starts, stops = (np.concatenate([getattr(own, n) + s for own, s in zip(run, shift)])[first] for n in ("starts", "stops"))
            number = {name: k for k, name in enumerate(names)}
            lang = np.concatenate([np.array([number[n] for n in own.names], np.int64)[own.lang] for own in run])[first]
            raw = np.concatenate([own.raw for own in run])
            yield _counts(pa.array(names, pa.string()).take(pa.array(lang)), cut_out(raw, starts, stops).cast(pa.string()), found.view(np.int64), 1, times)
            for size, phrases in _leading(run):
                found, times = np.unique(phrases, return_counts=True)
                often = times > len(phrases) / (4 * HOT)
                none = pa.nulls(int(often.sum()), pa.string())
                yield _counts(none, none, found[often].view(np.int64), size, times[often])

    return _source(documents).mapInArrow(counted, WORDS)


def _counts(lang: pa.Array, word: pa.Array, hashes: np.ndarray, leading: int, times: np.ndarray) -> pa.RecordBatch:
    columns = [lang, word, pa.array(hashes), pa.array(np.full(len(hashes), leading, np.int32)), pa.array(times.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "word", "hash", "leading", "times"])


class Routes:
    """Where a pointer goes: by its two leading words, or by three or four where those lead too many pointers."""

    def __init__(self, two: np.ndarray, three: np.ndarray, buckets: int):
        self.two, self.three, self.bits = np.sort(two), np.sort(three), int(log2(buckets))

    @staticmethod
    def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        """The route of every pointer; its upper bits are the bucket."""
        two = joined(words[0], words[1])
        three = joined(two, words[2])
        split = self.among(two, self.two)
        further = split & self.among(three, self.three) & (words[2] != 0)
        return np.where(further, joined(three, words[3]), np.where(split, three, two))

    def bucket(self, routes: np.ndarray) -> np.ndarray:
        return (routes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(routes), np.int64)


def pointers(own: Words, frequent: HashBits) -> np.ndarray:
    """The next words of every place, four rows, with zeros from the end of the piece or the first rare word on; at least two words."""
    good = frequent.has(own.hashes)
    goes_on = np.zeros(len(good) + LONGEST, bool)
    goes_on[: max(len(good) - 1, 0)] = (own.pieces[1:] == own.pieces[:-1]) & good[1:] & good[:-1]
    at = np.flatnonzero(goes_on)
    words, reach = np.zeros((LONGEST, len(at)), np.uint64), np.ones(len(at), bool)
    words[0] = own.hashes[at]
    for k in range(1, LONGEST):
        reach &= goes_on[at + k - 1]
        words[k, reach] = own.hashes[at[reach] + k]
    return words


def _bundles(documents: DataFrame, frequent, routes: Routes, ranks, limit: int) -> DataFrame:
    """Pointers with their counts, summed in each run of texts and bundled by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, limit):
            words = np.concatenate([pointers(own, frequent.value) for own in part], axis=1)
            route = routes(words)
            order = np.lexsort((joined(joined(joined(words[0], words[1]), words[2]), words[3]), route))
            words, route = words[:, order], route[order]
            first = np.ones(len(order), bool)
            first[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
            first = np.flatnonzero(first)
            times = np.diff(np.append(first, len(order)))
            words, bucket = words[:, first], routes.bucket(route[first])
            codes, begin = ranks.value.codes(words), heads(bucket)
            stops = [*begin[1:].tolist(), len(first)] if len(first) else []
            rows = [ranks.value.bundle(words[:, a:b], codes[:, a:b], times[a:b]) for a, b in zip(begin.tolist(), stops)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(rows, pa.binary())], ["bucket", "data"])

    return _source(documents).mapInArrow(run, "bucket long, data binary")


def _middle(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))


def partitions(words: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of pointers (a row of ``words`` for each depth), all open partitions at once.

    For every partition of pointers that agree in their first words and weigh at least ``least``: one pointer of it,
    the number of those words, and the weight. In each round every open partition is divided by a word at its depth into
    less, equal and greater; the equal one has one more word in common. Parts below ``least`` are abandoned.
    """
    found = []
    held, start, depth = np.arange(len(times)), np.zeros(min(len(times), 1), np.int64), np.zeros(min(len(times), 1), np.int64)
    while len(start):
        size = np.diff(np.append(start, len(held)))
        part = np.repeat(np.arange(len(start)), size)
        key = words[depth[part], held]
        pivot = _middle(key[start], key[start + size // 2], key[start + size - 1])
        side = (key > pivot[part]).astype(np.int64) + (key >= pivot[part])
        own = 3 * part + side
        counts, weights = np.bincount(own, minlength=3 * len(start)), np.bincount(own, times[held], minlength=3 * len(start))
        # Members move to their part, in their order.
        place = np.empty(len(held), np.int64)
        into = np.cumsum(counts) - counts
        for k in range(3):
            mine = np.flatnonzero(side == k)
            group = part[mine]
            before = np.cumsum(counts[k::3]) - counts[k::3]
            place[mine] = into[k::3][group] + np.arange(len(mine)) - before[group]
        moved = np.empty(len(held), np.int64)
        moved[place] = held
        equal = np.arange(3 * len(start)) % 3 == 1
        deeper = np.repeat(depth, 3) + equal
        heavy = (weights >= least) & (counts > 0)
        ended = equal & (np.repeat(pivot, 3) == 0)
        done = heavy & equal & ~ended
        found.append((moved[into[done]], deeper[done], weights[done].astype(np.int64)))
        go_on = heavy & ~ended & (deeper < len(words))
        held = moved[np.repeat(go_on, counts)]
        depth = deeper[go_on]
        start = np.cumsum(counts[go_on]) - counts[go_on]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))


def _frequent(words: np.ndarray, times: np.ndarray, routes: Routes, least: int) -> pa.RecordBatch:
    """Phrases of a bucket's pointers with their counts; of phrases that are dealt over buckets, this one's part."""
    at, depth, weight = partitions(words, times, least)
    keep = depth >= 2
    at, depth, weight = at[keep], depth[keep], weight[keep]
    rows = []
    two = joined(words[0], words[1])
    for size, known, keys in ((2, routes.two, two), (3, routes.three, joined(two, words[2]))):
        shared = (depth == size) & routes.among(keys[at], known)
        at, depth, weight = at[~shared], depth[~shared], weight[~shared]
        mine = np.flatnonzero(routes.among(keys, known) & (words[size - 1] != 0))
        if len(mine):
            _, first, group = np.unique(keys[mine], return_index=True, return_inverse=True)
            total = np.bincount(group, times[mine]).astype(np.int64)
            rows += [(words[:size, mine[i]].view(np.int64).tolist(), n) for i, n in zip(first.tolist(), total.tolist())]
    phrases = words[:, at].T.copy().view(np.int64).tolist()
    rows += [(p[:size], n) for p, size, n in zip(phrases, depth.tolist(), weight.tolist())]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.int64())], ["words", "times"])


def phrase_counts(bundles: DataFrame, routes: Routes, ranks, least: int) -> DataFrame:
    """``words`` (hashes) and ``times`` of all phrases of two to four words that occur at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for bucket, data in zip(column_of(batch, "bucket").to_pylist(), column_of(batch, "data")):
                if held and bucket != last:
                    yield searched(held)
                    held = []
                held.append(data.as_py())
                last = bucket
        if held:
            yield searched(held)

    def searched(data: list[bytes]) -> pa.RecordBatch:
        parts = [ranks.value.words(d, LONGEST) for d in data]
        words, times = (np.concatenate(columns, axis=-1) for columns in zip(*parts))
        return _frequent(words, times, routes, least)

    tasks = int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = bundles.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, PHRASES)
    return found.groupBy("words").agg(F.sum("times").alias("times")).where(F.col("times") >= least)


def _scored(phrases: DataFrame, single: DataFrame, scale: int) -> DataFrame:
    """The lowest-scoring cut of every phrase: ``words``, ``a``, ``l``, ``r``, ``score``."""
    counts = phrases.select("words", "times").union(single.select(F.array("hash"), "times"))
    cuts = phrases.select("words", F.col("times").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select(F.col("words").alias(side), F.col("times").alias(name)), side)
    wide = {n: F.col(n).cast("decimal(19,0)") for n in ("a", "l", "r")}
    exact = cuts.withColumns({"over": F.lit(scale).cast("decimal(10,0)") * wide["a"], "under": wide["l"] + wide["r"]})
    exact = exact.withColumn("score", F.expr("over div under").cast("long"))
    best = exact.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("words", "a", "cut.l", "cut.r", "cut.score")


def _inside(phrases: DataFrame) -> DataFrame:
    """``words`` of phrases inside longer ones, with the highest count of such a longer phrase."""
    longer = phrases.where(F.size("words") > 2)
    sizes = F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size")
    parts = longer.select("words", "times", sizes).select(
        "words", "times", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at")
    )
    parts = parts.select(F.slice("words", F.col("at"), F.col("size")).alias("words"), "times")
    return parts.groupBy("words").agg(F.max("times").alias("around"))


def phrases(documents: DataFrame, least: int = LEAST, share: int = SHARE, scale: int = SCALE, top: int = TOP, run: int = RUN, bucket: int = BUCKET) -> DataFrame:
    """Each language's ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and then into words. A phrase of two to
    four words in one piece that occurs ``least`` times or more is cut where its score, ``scale * a / (l + r)`` rounded
    down, is lowest, and dropped if its words lie inside a longer one that occurs at least ``share`` hundredths as often.
    Ties rank by ``a``, then by the phrase's bytes. A null text is empty, a null ``lang`` counts as ``und``, repeated
    rows count as often as they occur, an empty table gives an empty result, and columns other than ``text`` and
    ``lang`` are ignored. Words are told apart by 64-bit hashes once they are counted.
    """
    spark = documents.sparkSession
    counted = word_counts(documents, run).groupBy("lang", "word", "hash", "leading").agg(F.sum("times").alias("times"))
    # At most 4 * HOT leading phrases of a run are sent, and a phrase with a share of 1 / HOT is among them in most of its runs.
    counted = checkpointed(counted.where((F.col("leading") != 1) | (F.col("times") >= least)))
    release(spark)
    total = counted.where("leading = 0").agg(F.sum("times")).first()[0] or 0
    # ``run`` and ``bucket`` bound what a task holds; they do not change the result.
    buckets = 1 << ceil(log2(max(1, total / bucket)))
    often = counted.where((F.col("leading") > 1) & (F.col("times") >= max(bucket, total / HOT) / 2)).select("leading", "hash").toArrow()
    known = {k: often["hash"].to_numpy()[often["leading"].to_numpy() == k].view(np.uint64) for k in (2, 3)}
    routes = Routes(known[2], known[3], buckets)
    single = counted.where("leading = 1")
    frequent = spark.sparkContext.broadcast(HashBits.of(single, "hash"))
    ranks = spark.sparkContext.broadcast(Ranks.of(single, "hash", "times"))
    found = checkpointed(phrase_counts(_bundles(documents, frequent, routes, ranks, run), routes, ranks, least))
    release(spark)
    judged = _scored(found, single, scale).join(_inside(found), "words", "left")
    free = F.coalesce(F.col("around").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * share, F.lit(True))
    kept = judged.where(free).drop("around")
    spelled = kept.select("words", "a", "l", "r", "score", F.posexplode("words").alias("at", "hash")).join(single.select("hash", "lang", "word"), "hash")
    spelled = spelled.groupBy("words", "a", "l", "r", "score").agg(
        F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelled")
    )
    named = spelled.withColumn("phrase", F.array_join(F.transform("spelled", lambda s: s["word"]), " "))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("words"), F.lit(PARTS))
    best = named.withColumn("place", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counted.where("leading = 0").select("lang", F.col("times").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
