import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from matchform.llm import repeats, suffixes


def plain_removed(rows, length):
    data = [(t or "").encode() for _, t in rows]
    often = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for at in range(len(d) - length + 1):
            if often[d[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found_in(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_documents_and_edge_cases_equal_brute_force(as_documents, texts):
    some = list(texts.items())[:120]
    long = " ".join(f"w{i % 977}" for i in range(12_000))
    rows = some + [(1000, None), (1001, ""), (1002, " "), (1003, long), (1004, "x" * 900), (1005, "\0" * 450), (1003, long), (None, some[0][1]), (1006, "é" * 199), (1006, "other")]
    assert found_in(suffixes.removed_bytes(as_documents(rows))) == plain_removed(rows, 200)


@pytest.mark.parametrize(("group", "most", "shard"), [(60, 90, 40), (400, 10**6, 100), (1 << 18, 1 << 20, 300)])
def test_groups_and_shards_of_any_size_give_the_same(monkeypatch, as_documents, group, most, shard):
    rng = random.Random(4)
    rows = []
    for i in range(50):
        line = "".join(rng.choice("ab\0") for _ in range(rng.randrange(40)))
        rows.append((i, line + "abcdefghijkl" * rng.randrange(3) + line[:12]))
    monkeypatch.setattr(suffixes, "Groups", lambda k, c: repeats.Groups(k, suffixes.arrays(k.length, shard), group, most))
    assert found_in(suffixes.removed_bytes(as_documents(rows), length=10, gram=4)) == plain_removed(rows, 10)


def test_long_texts_in_slices_give_the_same(monkeypatch, as_documents):
    rng = random.Random(9)
    part = "".join(rng.choices("abcde ", k=700))
    rows = [(i, "".join(rng.choices("xyz uvw", k=rng.randrange(4000))) + part + "".join(rng.choices("kl mn", k=rng.randrange(3000))) + part[:400]) for i in range(12)]
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 4 * 512)
    assert found_in(suffixes.removed_bytes(as_documents(rows))) == plain_removed(rows, 200)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 250):
        raw = rng.integers(0, alphabet, 700).astype(np.uint8)
        array = suffixes.suffix_array(raw.astype(np.uint16) + 1, 700)
        data = raw.tobytes()
        assert array.tolist() == sorted(range(700), key=lambda i: data[i:])
        shared = suffixes.common_prefixes(raw, array)
        for k in range(1, 700):
            a, b = data[array[k - 1] :], data[array[k] :]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_empty_table(as_documents):
    assert suffixes.removed_bytes(as_documents([])).count() == 0
