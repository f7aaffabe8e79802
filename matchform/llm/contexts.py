"""Language-model scores by a probabilistic suffix tree over words.

A node is a context: the last one, two or three words. Its next-word distribution keeps the counts of words that
followed it often enough; the rest of its mass goes to the node without the oldest word, down to smoothed word
frequencies. A context stays in the tree if its distribution diverges enough from its parent's, or if a longer context
that ends in it stays. A word is scored by the longest context of the tree that ends before it.

The logarithm of such a probability is a sum over the word's phrases: for each length, what the context before it takes
off, and what the word gets back there if it is one of the kept ones. So the tree is a table of a number for each
phrase, and a text's score is the sum of its phrases' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from matchform.llm.bundles import HashBits, Ranks, from_planes, heads, joined, packed, planes, small, unpacked
from matchform.llm.decontaminate import FOLD
from matchform.llm.texts import NO_ID, RangeHash, blocks, column_of, discard, public_id, release, stored, text_bytes, word_spans
from matchform.session import TEXT_SETTINGS, with_settings

# The longest context, how often contexts and their kept next words occur at least, the least gain in nats, the discount.
DEPTH, CONTEXT, FOLLOWER, GAIN, DISCOUNT = 3, 32, 4, 8.0, 0.75
# Tokens worked off together, and phrases of a bucket: both bound what a task holds.
RUN, BUCKET = 1 << 20, 1 << 21
# Shares of the texts that ask the tree one after the other: the exchange lies on disk for one of them.
ROUNDS = 3
# What stands for the end of a text.
END = np.uint64(1)

FOLLOWERS = "phrase long, context long, parent long, below long, times long"
RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


class Tokens:
    """Tokens of several texts: their hashes, the row of each, and how many stand before it in its row."""

    def __init__(self, batch: pa.RecordBatch):
        raw, ends = text_bytes(column_of(batch, "text"))
        raw = FOLD[raw]
        starts, stops, first = word_spans(raw, ends)
        words = np.diff(first)
        bounds = np.append(0, np.cumsum(words + 1))
        self.row = np.repeat(np.arange(batch.num_rows), words + 1)
        self.before = np.arange(bounds[-1]) - bounds[self.row]
        self.hashes = np.full(bounds[-1], END)
        if len(starts):
            self.hashes[self.before < words[self.row]] = np.maximum(RangeHash(raw)(starts, stops), np.uint64(2))
        self.sizes = words + 1


def phrases(hashes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For every length up to ``longest`` the hash of the phrase that ends at each token (one that begins too early is wrong)."""
    found = [hashes]
    for _ in range(1, longest):
        shifted = np.zeros(len(hashes), np.uint64)
        shifted[1:] = found[-1][:-1]
        found.append(joined(shifted, hashes))
    return found


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.RecordBatch], list[Tokens]]]:
    """Hashes, rows and places of about ``limit`` tokens at a time, with their batches."""
    held, tokens = [], []

    def together():
        shift = np.cumsum([0, *(b.num_rows for b in held)])
        row = np.concatenate([t.row + s for t, s in zip(tokens, shift)])
        return np.concatenate([t.hashes for t in tokens]), row, np.concatenate([t.before for t in tokens]), held, tokens

    for batch in blocks(batches):
        held.append(batch)
        tokens.append(Tokens(batch))
        if sum(len(t.hashes) for t in tokens) >= limit:
            yield together()
            held, tokens = [], []
    if held:
        yield together()


def _texts(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"))


def token_counts(texts: DataFrame, run: int = RUN) -> DataFrame:
    """``phrase`` (a token's hash) and how often it occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, *_ in _runs(batches, run):
            found, times = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["phrase", "times"])

    return texts.select("text").mapInArrow(counted, "phrase long, times long").groupBy("phrase").agg(F.sum("times").alias("times"))


def bucket_count(spark: SparkSession, tokens: int, bucket: int) -> int:
    """As many buckets as there are tasks, or more where they would be larger than ``bucket``; a power of two."""
    return 1 << ceil(log2(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), tokens / bucket)))


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    bits = int(log2(buckets))
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def followers(texts: DataFrame, depth: int, frequent, ranks, least: int, buckets: int, run: int = RUN) -> DataFrame:
    """What follows contexts of ``depth`` words at least ``least`` times: see ``FOLLOWERS``.

    ``phrase`` is the context with the word, ``parent`` the context without its oldest word (zero: none), ``below`` the
    phrase without its oldest word. Counts are summed in each run of texts and dealt out by phrase.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _, before, *_ in _runs(batches, run):
            ending = phrases(hashes, depth)[-1]
            at = np.flatnonzero(before >= depth)
            at = at[frequent.value.has(ending[at - 1])]
            phrase = joined(ending[at - 1], hashes[at])
            order = np.argsort(phrase, kind="stable")
            first = heads(phrase[order])
            times, at = np.diff(np.append(first, len(order))), at[order[first]]
            bucket = _buckets(phrase[order[first]], buckets)
            # Sent as its words, of which the frequent ones are short numbers, in their order within a bundle.
            words = np.stack([hashes[at - k] for k in range(depth, -1, -1)])
            codes = ranks.value.codes(words)
            order = np.lexsort((codes[1], codes[0], bucket))
            words, codes, times, bucket = words[:, order], codes[:, order], times[order], bucket[order]
            begin = heads(bucket)
            stops = [*begin[1:].tolist(), len(at)] if len(at) else []
            rows = [ranks.value.bundle(words[:, a:b], codes[:, a:b], times[a:b]) for a, b in zip(begin.tolist(), stops)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(rows, pa.binary())], ["bucket", "data"])

    def summed(data: list[bytes]) -> pa.RecordBatch:
        words, times = (np.concatenate(columns, axis=-1) for columns in zip(*(ranks.value.words(d, depth + 1) for d in data)))
        phrase = reduce(joined, words)
        order = np.argsort(phrase, kind="stable")
        first = heads(phrase[order])
        total = np.add.reduceat(times[order], first)
        kept = order[first[total >= least]]
        own = words[:, kept]
        none = np.zeros(len(kept), np.uint64)
        parent = reduce(joined, own[1:-1]) if depth > 1 else none
        columns = [phrase[kept], reduce(joined, own[:-1]), parent, reduce(joined, own[1:])]
        return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(total[total >= least])], [c.split()[0] for c in FOLLOWERS.split(", ")])

    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("text").mapInArrow(sent, "bucket long, data binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_by_bucket(summed), FOLLOWERS)


def _by_bucket(work):
    """Apply ``work`` to the bundles of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for bucket, data in zip(column_of(batch, "bucket").to_pylist(), column_of(batch, "data")):
                if held and bucket != last:
                    yield work(held)
                    held = []
                held.append(data.as_py())
                last = bucket
        if held:
            yield work(held)

    return run


@dataclass(frozen=True)
class Tree:
    """A fitted tree: ``values`` has for each ``phrase`` its ``value``, and its ``base`` score if it is a token."""

    values: DataFrame
    tokens: int
    kinds: int
    contexts: DataFrame

    @property
    def unknown(self) -> float:
        """The score of a token that was never seen."""
        return -log10(self.tokens + self.kinds + 1)


def _distributions(found: DataFrame, occurs: DataFrame, below: DataFrame, discount: float) -> tuple[DataFrame, DataFrame]:
    """Probabilities of kept next words, and for every context its ``rest`` (the share left to its parent) and ``gain``."""
    kept = found.groupBy("context", "parent").agg(F.sum("times").alias("kept"), F.count(F.lit(1)).alias("kinds"))
    contexts = kept.join(occurs.select(F.col("phrase").alias("context"), F.col("times").alias("occurs")), "context")
    contexts = contexts.withColumn("rest", (F.col("occurs") - F.col("kept") + discount * F.col("kinds")) / F.col("occurs"))
    shares = found.drop("parent").join(contexts, "context").join(below.select(F.col("phrase").alias("below"), F.col("p").alias("p_below")), "below")
    shares = shares.withColumn("p", (F.col("times") - discount) / F.col("occurs") + F.col("rest") * F.col("p_below"))
    shares = stored(shares.select("phrase", "context", "parent", "times", "occurs", "kept", "rest", "p", "p_below"))
    gained = F.sum(F.col("times") * F.ln(F.col("p") / F.col("p_below")))
    gain = shares.groupBy("context", "parent", "rest").agg((gained + F.first(F.col("occurs") - F.col("kept")) * F.ln("rest")).alias("gain"))
    return shares, gain


def learn(
    documents: DataFrame, depth: int = DEPTH, context: int = CONTEXT, follower: int = FOLLOWER, gain: float = GAIN,
    discount: float = DISCOUNT, run: int = RUN, bucket: int = BUCKET,
) -> Tree:
    """The tree of all documents given.

    Contexts that occur at least ``context`` times are looked at, one more word in each pass; of their next words
    those seen at least ``follower`` times are kept, each ``discount`` short of its count. A context stays if using its
    distribution in place of its parent's gains ``gain`` nats or more over all its occurrences. Null texts are empty,
    repeated rows count as often as they occur, and columns other than ``doc_id`` and ``text`` are ignored.
    """
    spark, texts = documents.sparkSession, _texts(documents)
    single = stored(token_counts(texts, run))
    tokens, kinds = single.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = bucket_count(spark, tokens, bucket)
    base = single.select("phrase", "times", ((F.col("times") + 1) / (tokens + kinds + 1)).alias("p"))
    ranks = spark.sparkContext.broadcast(Ranks.of(single, "phrase", "times"))
    occurs, below, levels = single, base, []
    for length in range(1, depth + 1):
        occurs = occurs.where(F.col("times") >= context)
        frequent = spark.sparkContext.broadcast(HashBits.of(occurs, "phrase"))
        found = stored(followers(texts, length, frequent, ranks, follower, buckets, run))
        release(spark)
        shares, gains = _distributions(found, occurs, below, discount)
        levels.append((shares, stored(gains)))
        # Contexts that a set of bits let through by mistake are not among the shares; they are too rare to be asked for again.
        discard(found)
        occurs, below = shares.select("phrase", "times"), shares.select("phrase", "p")
    values, stay, kept = base.select("phrase", F.log10("p").alias("value"), F.log10("p").alias("base")), None, None
    none = F.lit(None).cast("double").alias("base")
    for length, (shares, gains) in reversed(list(enumerate(levels, 1))):
        own = gains.where(F.col("gain") >= gain).select("context")
        staying = own if stay is None else own.union(stay.select(F.col("parent").alias("context"))).distinct()
        stay = stored(gains.join(staying, "context").select("context", "parent", "rest"))
        taken = stay.select(F.col("context").alias("phrase"), F.log10("rest").alias("value"), none)
        back = shares.join(stay.select("context"), "context").select("phrase", F.log10(F.col("p") / F.col("p_below") / F.col("rest")).alias("value"), none)
        values = values.union(taken).union(back)
        nodes = stay.select(F.lit(length).alias("length"), "context", "rest")
        kept = nodes if kept is None else nodes.union(kept)
    values = stored(values.groupBy("phrase").agg(F.sum("value").alias("value"), F.max("base").alias("base")))
    discard(single, *(frame for level in levels for frame in level))
    release(spark)
    return Tree(values, tokens, kinds, kept)


# Rows of the exchange between texts and tree: the tree's table, what runs of texts ask of it, the runs' documents, answers.
TABLE, ASKED, OWNERS, ANSWER = range(4)
EXCHANGE = "run long, kind int, bucket long, data binary"


def _rows(runs: np.ndarray, kinds: np.ndarray, buckets: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(runs), pa.array(kinds.astype(np.int32)), pa.array(buckets), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["run", "kind", "bucket", "data"])


def _asked(texts: DataFrame, known, depth: int, buckets: int, run: int) -> DataFrame:
    """For each run of texts a row with its documents, and a row for each bucket with phrases and the documents they stand in."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (hashes, row, before, held, tokens) in enumerate(_runs(batches, run)):
            name = (TaskContext.get().partitionId() << 32) + number
            ids = np.concatenate([column_of(b, "doc_id").to_numpy() for b in held])
            rows = [packed([ids, np.concatenate([t.sizes for t in tokens])])]
            asked, owner, row = [hashes], [small(row)], small(row)
            for length, ending in enumerate(phrases(hashes, depth + 1)[1:], 2):
                at = np.flatnonzero(before >= length - 1)
                at = at[known.value.has(ending[at])]
                asked.append(ending[at])
                owner.append(row[at])
            asked, owner = np.concatenate(asked), np.concatenate(owner)
            order = np.argsort(asked, kind="stable")
            asked, owner = asked[order], owner[order]
            first = heads(asked)
            times = np.diff(np.append(first, len(asked)))
            bucket = _buckets(asked[first], buckets)
            begin = heads(bucket)
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(first)]):
                stop = first[b] if b < len(first) else len(asked)
                rows.append(packed([planes(asked[first[a:b]]), small(times[a:b]), owner[first[a] : stop]]))
            kinds = np.append(OWNERS, np.full(len(begin), ASKED))
            yield _rows(np.full(len(rows), name), kinds, np.append(name % buckets, bucket[begin]), rows)

    return texts.mapInArrow(sent, EXCHANGE)


def _given(values: DataFrame, buckets: int) -> DataFrame:
    """The tree's table in bundles."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrase = column_of(batch, "phrase").to_numpy().view(np.uint64)
            order = np.argsort(phrase)
            phrase = phrase[order]
            value, base = (column_of(batch, n).to_numpy(zero_copy_only=False).astype(float)[order] for n in ("value", "base"))
            bucket = _buckets(phrase, buckets)
            begin = heads(bucket)
            rows = [packed([phrase[a:b], value[a:b], base[a:b]]) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(phrase)] if len(phrase) else [])]
            none = np.zeros(len(rows), np.int64)
            yield _rows(none, none + TABLE, bucket[begin], rows)

    return values.mapInArrow(sent, EXCHANGE)


# Documents whose sums a task holds before it sends them.
HELD_DOCUMENTS = 1 << 20


class Sums:
    """Sums of each run's documents over the buckets of a task."""

    def __init__(self):
        self.runs, self.size = {}, 0

    def add(self, run: int, docs: np.ndarray, parts: list[np.ndarray]) -> None:
        """``parts`` are values to add for each of ``docs``."""
        size = int(docs.max()) + 1
        held = self.runs.get(run)
        if held is None or held.shape[1] < size:
            more = np.zeros((len(parts), size))
            if held is not None:
                more[:, : held.shape[1]] = held
                self.size -= held.shape[1]
            self.runs[run], self.size = more, self.size + size
        for total, part in zip(self.runs[run], parts):
            total[:size] += np.bincount(docs, part, minlength=size)

    def rows(self, bucket: int) -> pa.RecordBatch:
        data = [packed(list(total)) for total in self.runs.values()]
        names = np.array(list(self.runs), np.int64)
        self.runs, self.size = {}, 0
        return _rows(names, np.full(len(data), ANSWER), np.full(len(data), bucket), data)


def _looked_up(asked: np.ndarray, table: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and base scores of phrases (zero: none), and which of them are known tokens."""
    phrase, *columns = table
    if not len(phrase):
        return np.zeros(len(asked)), np.zeros(len(asked)), np.zeros(len(asked), bool)
    place = np.minimum(np.searchsorted(phrase, asked), len(phrase) - 1)
    there = phrase[place] == asked
    value, base = (np.where(there, column[place], np.nan) for column in columns)
    return np.nan_to_num(value), np.nan_to_num(base), ~np.isnan(base)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every run the sums of its documents over a task's buckets; a bucket's table comes first, owners go on as they are."""
    last, parts, table, sums = None, [], None, Sums()
    for batch in batches:
        for run, kind, bucket, data in zip(*(column_of(batch, n).to_pylist() for n in ("run", "kind", "bucket", "data"))):
            if bucket != last:
                last, parts, table = bucket, [], None
            if kind == TABLE:
                parts.append(unpacked(data))
                continue
            if kind == OWNERS:
                yield _rows(np.array([run]), np.array([OWNERS]), np.array([bucket]), [data])
                continue
            if table is None:
                columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.uint64), np.empty(0), np.empty(0)]
                order = np.argsort(columns[0])
                table, parts = [c[order] for c in columns], []
            asked, times, owner = unpacked(data)
            sums.add(run, owner.astype(np.int64), [np.repeat(v, times) for v in _looked_up(from_planes(asked), table)])
            if sums.size > HELD_DOCUMENTS:
                yield sums.rows(last)
    if sums.size:
        yield sums.rows(last)


def _totals(unknown: float):
    """Sums of each run's documents; the row with its documents comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done():
            ids, tokens, value, base, known = held
            missing = (tokens - known) * unknown
            known = known.astype(np.int64)
            columns = [ids, tokens, known, base + missing, value + missing]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in RESULT.split(", ")])

        for batch in batches:
            for kind, data in zip(column_of(batch, "kind").to_pylist(), column_of(batch, "data").to_pylist()):
                parts = unpacked(data)
                if kind == OWNERS:
                    if held is not None:
                        yield done()
                    held = (*parts, *(np.zeros(len(parts[0])) for _ in range(3)))
                    continue
                for total, part in zip(held[2:], parts):
                    total[: len(part)] += part
        if held is not None:
            yield done()

    return run


def scores(documents: DataFrame, tree: Tree, depth: int = DEPTH, run: int = RUN, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every document.

    A null or empty text has its end as the only token. Repeated rows have a row each, a null ``doc_id`` stays null, an
    empty table gives an empty result. ``base_score`` adds up log10((c + 1) / (N + V + 1)), ``score`` the tree's log10
    probabilities. Texts stay where they are: a run of them asks for its phrases, and gets sums for its documents. A
    share of the texts asks at a time, and what it sent is let go before the next does.
    """
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = bucket_count(spark, tree.tokens, bucket)
    known = spark.sparkContext.broadcast(HashBits.of(tree.values.where("base is null"), "phrase"))
    texts, table, found = _texts(documents), stored(_given(tree.values, buckets)), []
    for part in range(rounds):
        own = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == part)
        # A run's documents and what it asks come from one task, so its name means the same texts to both.
        dealt = _asked(own, known, depth, buckets, run).union(table).repartition(tasks, "bucket")
        answers = dealt.sortWithinPartitions("bucket", "kind").mapInArrow(_answered, EXCHANGE)
        answers = answers.repartition(tasks, "run").sortWithinPartitions("run", "kind")
        found.append(stored(answers.mapInArrow(_totals(tree.unknown), RESULT)))
        release(spark)
    discard(table)
    return public_id(reduce(DataFrame.union, found))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: its id's checksum leaves two when divided by seven (a null id's does not)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def judged(documents: DataFrame, **settings) -> DataFrame:
    """All documents scored by the tree of those that are not held out."""
    own = {k: v for k, v in settings.items() if k in ("depth", "run", "bucket", "rounds")}
    # All work is done in here; bundles are large, and few of them go to Python at once.
    with with_settings(documents.sparkSession, **{key.replace(".", "__"): value for key, value in TEXT_SETTINGS.items()}):
        tree = learn(documents.where(~held_out()), **settings)
        found = scores(documents, tree, **own)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")
