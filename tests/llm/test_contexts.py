import os
import random
import zlib
from collections import Counter, defaultdict
from math import log, log10

import numpy as np
import pytest

from matchform.llm import bundles, contexts

FOLD = {c: c + 32 for c in range(65, 91)}


def tokens_of(text):
    return [*(text or "").translate(FOLD).encode().split(), None]


def plain_scores(rows, depth, context, follower, gain, discount=0.75):
    """The same from a recursive tree over tuples of words; rows are (id, text)."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    texts = [tokens_of(t) for _, t in rows]
    single, after = Counter(), defaultdict(Counter)
    for out, own in zip(held, texts):
        if not out:
            single.update(own)
            for at in range(len(own)):
                for k in range(1, min(depth, at) + 1):
                    after[tuple(own[at - k : at])][own[at]] += 1
    n, v = single.total(), len(single)
    nodes = {}
    for s, counts in after.items():
        if counts.total() >= context:
            kept = {w: c for w, c in counts.items() if c >= follower}
            if kept:
                nodes[s] = (counts.total(), kept, (counts.total() - sum(kept.values()) + discount * len(kept)) / counts.total())

    def chance(s, w):
        if not s:
            return (single[w] + 1) / (n + v + 1)
        if s not in nodes:
            return chance(s[1:], w)
        total, kept, rest = nodes[s]
        return max(kept.get(w, 0) - discount, 0) / total + rest * chance(s[1:], w)

    stay = set()
    for s in sorted(nodes, key=len, reverse=True):
        total, kept, rest = nodes[s]
        gained = sum(c * log(chance(s, w) / chance(s[1:], w)) for w, c in kept.items()) + (total - sum(kept.values())) * log(rest)
        if gained >= gain or s in stay:
            stay.update(s[k:] for k in range(len(s)))

    def scored(own):
        value = 0.0
        for at, w in enumerate(own):
            s = tuple(own[max(0, at - depth) : at])
            while s and s not in stay:
                s = s[1:]
            value += log10(chance(s, w))
        return value

    out = {}
    for (i, _), hold, own in zip(rows, held, texts):
        base = sum(log10((single[w] + 1) / (n + v + 1)) for w in own)
        out.setdefault((i, hold, len(own), sum(single[w] > 0 for w in own), n), []).append((base, scored(own)))
    return {k: sorted(x) for k, x in out.items()}, stay


def found_in(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), []).append((r.base_score, r.score))
    return {k: sorted(x) for k, x in out.items()}


def close(found, expected):
    assert found.keys() == expected.keys()
    for key, own in expected.items():
        assert [x for pair in found[key] for x in pair] == pytest.approx([x for pair in own for x in pair], rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(8)
    words = ["the", "The", "of", "red", "fox", "is", "é", "x\ty", "end\n"]
    made = []
    for i in range(300):
        line = []
        while len(line) < 40:
            line += rng.choices(words, k=3) if rng.random() < 0.6 else ["over", "the", "lazy", rng.choice(["dog", "cat"])]
        made.append((i, " ".join(line)))
    return made + [(500 + i, t[:2000]) for i, t in list(texts.items())[:60]] + [(900, None), (901, ""), (902, " \n"), (None, "the red fox"), (903, "Lazy dog"), (903, "Lazy dog"), (904, "over the lazy dog " * 4000)]


@pytest.mark.parametrize(("depth", "context", "follower", "gain", "sizes"), [(3, 32, 4, 8.0, {}), (3, 8, 2, 2.0, {"run": 700, "bucket": 300}), (2, 10, 1, 30.0, {"run": 3000, "bucket": 5000}), (1, 10**9, 1, 0.0, {})])
def test_equals_brute_force(as_documents, rows, depth, context, follower, gain, sizes):
    found = contexts.judged(as_documents(rows).repartition(3), depth=depth, context=context, follower=follower, gain=gain, **sizes)
    expected, stay = plain_scores(rows, depth, context, follower, gain)
    close(found_in(found), expected)
    if depth == 3:
        assert {len(s) for s in stay} == {1, 2, 3}


def test_sums_of_a_task():
    sums = contexts.Sums()
    sums.add(7, np.array([0, 2, 2]), [np.array([1.0, 2.0, 3.0]), np.array([True, False, True])])
    sums.add(9, np.array([1]), [np.array([4.0]), np.array([True])])
    sums.add(7, np.array([4]), [np.array([0.5]), np.array([True])])
    assert sums.size == 7
    rows = sums.rows(3).to_pylist()
    found = {r["run"]: [a.tolist() for a in bundles.unpacked(r["data"])] for r in rows}
    assert found == {7: [[1, 0, 5, 0, 0.5], [1, 0, 1, 0, 1]], 9: [[0, 4], [0, 1]]} and sums.size == 0


def test_contexts_make_held_out_texts_likelier(as_documents, rows):
    found = [r for r in contexts.judged(as_documents(rows)).collect() if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(found) > 20 and sum(r.score for r in found) > sum(r.base_score for r in found) * 0.9


def test_empty_tables(as_documents):
    assert contexts.judged(as_documents([])).count() == 0
    assert found_in(contexts.judged(as_documents([(None, None)]))) == {(None, False, 1, 1, 1): [(pytest.approx(log10(2 / 3)), pytest.approx(log10(2 / 3)))]}


def test_what_is_read_no_more_is_deleted_and_texts_ask_in_shares(spark, as_documents, rows, monkeypatch):
    written, asked, stored, ask = [], [], contexts.stored, contexts._asked

    def kept(frame):
        written.append(stored(frame))
        return written[-1]

    def counted(texts, *others):
        asked.append(texts.count())
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
        return ask(texts, *others)

    monkeypatch.setattr(contexts, "stored", kept)
    monkeypatch.setattr(contexts, "_asked", counted)
    assert contexts.judged(as_documents(rows)).count() == len(rows)
    assert len(asked) == contexts.ROUNDS and sum(asked) == len(rows) and max(asked) < len(rows) / 2
    files = [f.inputFiles()[0].removeprefix("file://").removeprefix("file:") for f in written]
    # Of the tables of the tree only its values and the contexts that stay are left, besides the shares' scores.
    assert sum(map(os.path.exists, files)) == 1 + contexts.DEPTH + contexts.ROUNDS < len(files)
