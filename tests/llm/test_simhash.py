import random

import numpy as np
import xxhash

from matchform.llm import components as stars, simhash
from matchform.llm.components import components

EDGE_TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c"), (6, "a b c d"), (6, "a b c d"), (None, "a b c d"),
              (7, "A B C D"), (8, "w " * 60_000), (9, "é\x00ü " * 9)]


def plain_fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    digests = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(d >> bit & 1 for d in digests) > len(digests))


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(prints, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{p:016x}", least.get(g)) for (i, p), g in zip(prints, group)), key=repr)


def test_documents_and_edge_cases_equal_brute_force(as_documents, texts):
    rows = list(texts.items())[:150] + [(1000 + (i or 0), t) if i else (None, t) for i, t in EDGE_TEXTS]
    found = simhash.near_duplicates(as_documents(rows)).collect()
    assert sorted(map(tuple, found), key=repr) == plain_components(rows)


def test_empty_table(as_documents):
    assert simhash.near_duplicates(as_documents([])).count() == 0


def test_large_cells_are_compared_in_parts(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 90:
        value = rng.choice(sorted(values))
        for _ in range(rng.randrange(1, 7)):
            value ^= 1 << rng.randrange(64)
        values.add(value)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "bits long")
    for part in (8, 1000):
        roots = components(simhash.links(frame, part=part)).collect()
        groups = {v: v for v in signed} | {r.node: r.root for r in roots}
        plain = {v: v for v in signed}
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and plain[a] != plain[b]:
                    low, high = sorted((plain[a], plain[b]))
                    plain = {k: low if g == high else g for k, g in plain.items()}
        assert groups == plain


def test_every_near_pair_shares_a_cell():
    rng = random.Random(1)
    masks = simhash.cell_masks(4)
    count = lambda x: (x & 0x5555555555555555) + (x >> 1 & 0x5555555555555555)
    for _ in range(500):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(not (count(a) ^ count(b)) & m & (2**64 - 1) for m in masks)


def test_edges_are_contracted_before_any_round(spark, monkeypatch):
    """A path takes a round that finds nothing to do; in small parts it takes more, with the same result."""
    written, checkpointed = [], stars.checkpointed
    monkeypatch.setattr(stars, "checkpointed", lambda frame: written.append(1) or checkpointed(frame))
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001), (7, 7), (2, None)], "a long, b long")
    expected = sorted([(i, 0) for i in range(1, 301)] + [(1001, 1000)])
    assert sorted(map(tuple, components(edges).collect())) == expected
    assert len(written) == 2
    monkeypatch.setattr(stars, "TOGETHER", 16)
    assert sorted(map(tuple, components(edges.repartition(9)).collect())) == expected
    assert components(edges.where("a < 0")).count() == 0


def test_few_edges_are_contracted_without_rounds(spark, monkeypatch):
    def never(edges):
        raise AssertionError("a round")

    monkeypatch.setattr(stars, "_large_star", never)
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001)], "a long, b long").repartition(9)
    assert sorted(map(tuple, components(edges).collect())) == sorted([(i, 0) for i in range(1, 301)] + [(1001, 1000)])
