import random

import numpy as np
import pytest

import corpus_pipeline as cp
from matchform.llm import nearcopies, packing


def plain_set(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_firsts(rows):
    """Ids that come first in the components of Jaccard similarity 0.8 or more, by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * same >= 4 * union and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sorted(min(i for (i, _), h in zip(rows, group) if h == g) for g in set(group))


def edited(text, rng, share):
    words = text.split()
    for at in rng.sample(range(len(words)), max(1, int(len(words) * share))):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [nearcopies.SMALL_BYTES, 1])
def test_stage_equals_all_pairs(spark, as_documents, texts, monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL_BYTES", small)  # one: in several rounds, and by shuffles
    rng = random.Random(3)
    rows = [*texts.items(), (2001, None), (2002, " "), (2003, "one"), (2004, "ONE"), (2005, "a b c d e"), (2006, "a b c d e f")]
    sources = [t for t in texts.values() if t and len(t.split()) > 40][:40]
    rows += [(3000 + i, edited(t, rng, 0.005 * (1 + i % 9))) for i, t in enumerate(sources)]
    # A large group around a text that is not in it, with a passage that others share.
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))
    rows += [(4000 + i, edited(base, rng, 0.014)) for i in range(60)]
    rows += [(5000 + i, " ".join([*base.split()[:60], *(f"x{rng.randrange(10**6)}" for _ in range(90))])) for i in range(40)]
    expected = plain_firsts(rows)
    assert len(expected) < len(rows) - 40
    assert sorted(r.doc_id for r in cp.near_copies(spark, as_documents(rows), "").collect()) == expected


def test_empty_table(spark, as_documents):
    assert nearcopies.representatives(as_documents([])).count() == 0


def test_near_fingerprints_are_compared_first(spark, as_documents, monkeypatch):
    """Sets meet by the SimHash grid before any prefixes; those it links and those it misses are all found."""
    rng, found, grid = random.Random(8), [], nearcopies.grid_links
    bases = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(8)]
    rows = [(10 * k + i, edited(base, rng, share) if share else base) for k, base in enumerate(bases) for i, share in enumerate((0, 0.003, 0.02))]

    def recorded(bits, distance):
        links = grid(bits, distance)
        found.append((distance, bits.count(), links.count()))
        return links

    monkeypatch.setattr(nearcopies, "grid_links", recorded)
    assert sorted(r.doc_id for r in cp.near_copies(spark, as_documents(rows), "").collect()) == plain_firsts(rows)
    ((distance, prints, links),) = found
    assert distance == 4 and prints <= len(rows) and links >= 4


def test_only_groups_with_several_roots_are_looked_at():
    starts, root = np.array([0, 3, 4, 7]), np.array([5, 5, 5, 2, 9, 9, 1])
    assert nearcopies._several(starts, root) == [(4, 7)]


def test_text_goes_to_python_in_small_batches(spark, as_documents, monkeypatch):
    sizes, blocks = spark.sparkContext.accumulator(0), packing.blocks

    def counted(batches):
        for batch in batches:
            sizes.add(batch.nbytes > 6 << 20)
            yield batch

    monkeypatch.setattr(packing, "blocks", lambda batches: blocks(counted(batches)))
    docs = as_documents([(i, f"w{i} " * 2500) for i in range(1500)]).coalesce(1)
    assert cp.packed(spark, docs, "").count() >= 1500 and sizes.value == 0


def test_wide_sketches_rule_out_large_sets(spark):
    """What differs in the sketches differs in the sets; pairs of large sets that are far apart never move."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**64, 3000, np.uint64))
    some = {1: base, 2: np.unique(np.append(base[:2900], rng.integers(0, 2**64, 50, np.uint64))), 3: np.unique(rng.integers(0, 2**64, 2700, np.uint64)), 4: base[:1400], 5: base[:0], 6: base[:9]}
    for x in some.values():
        for y in some.values():
            assert nearcopies.bits_apart(nearcopies.wide_sketch(x), nearcopies.wide_sketch(y)) <= len(np.setxor1d(x, y))
    sets = spark.createDataFrame([(k, len(v), bytearray(nearcopies.wide_sketch(v))) for k, v in some.items()], "print long, size long, wide binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (5, 6)], "a long, b long")
    assert sorted((r.a, r.b) for r in nearcopies._likely(pairs, sets, 0.8).collect()) == [(1, 2), (5, 6)]


def test_turns_that_link_nothing_leave_the_roots(spark, as_documents, monkeypatch):
    """Only turns with new links make components; those by the grid are all there are in equal texts with one word changed."""
    rng, made, components = random.Random(4), [], nearcopies.components
    monkeypatch.setattr(nearcopies, "components", lambda edges: made.append(edges.count()) or components(edges))
    bases = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)) for _ in range(4)]
    rows = [(10 * k + i, edited(base, rng, 0.0001) if i else base) for k, base in enumerate(bases) for i in range(3)]
    assert sorted(r.doc_id for r in cp.near_copies(spark, as_documents(rows), "").collect()) == plain_firsts(rows)
    assert len(made) == 1
    rows = [(k, base) for k, base in enumerate(bases)]
    assert sorted(r.doc_id for r in cp.near_copies(spark, as_documents(rows), "").collect()) == [0, 1, 2, 3]
    assert len(made) == 1


def test_small_sets_are_compared_in_one_round(spark, as_documents, monkeypatch):
    """Pairs and centres that are broadcast need no rounds and no counts of their own; in rounds the result is the same."""
    rng, calls, verified = random.Random(6), [], nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, sets, similarity, small=False: calls.append(small) or verified(pairs, sets, similarity, small))
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    rows = [(i, edited(base, rng, 0.005 * (i % 3)) if i else base) for i in range(40)]
    monkeypatch.setattr(nearcopies, "_small", None)
    assert sorted(r.doc_id for r in cp.near_copies(spark, as_documents(rows), "").collect()) == plain_firsts(rows)
    assert calls and all(calls) and len(calls) <= 2 + nearcopies.STARS
