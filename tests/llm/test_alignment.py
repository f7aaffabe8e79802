import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from matchform.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain_ends(texts):
    """Per text the (id, end byte) lists of both tokenizers over whole texts, or None."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        x, y = first.encode(" " + text, add_special_tokens=False), second.encode(text)
        a = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(x.ids, x.tokens)]
        b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in y]
        raw = (" " + text).encode()
        if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            out.append(None)
            continue
        ends = []
        for tokens in (a, b):
            at, own = 0, []
            for i, t in tokens:
                own.append((i, at, at + len(t)))
                at += len(t)
            ends.append(own)
        out.append(ends)
    return out


def plain_aligned(rows):
    """The same from every pair of tokens whose byte ranges meet."""
    found, counts = plain_ends([t for _, t in rows]), Counter()
    links = []
    for ends in found:
        own = [(i, j) for i, s, e in ends[0] for j, t, f in ends[1] if s < f and t < e] if ends else []
        links.append(own)
        counts.update(own)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for (i, _), ends, own in zip(rows, found, links):
        if not ends:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        both = sorted({e for _, _, e in ends[0]} & {e for _, _, e in ends[1]})
        groups, since = [], 0
        for stop in both:
            sides = [",".join(str(k) for k, s, e in side if since <= s and e <= stop) for side in ends]
            groups.append("|".join(sides))
            since = stop
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, len(ends[0]), len(ends[1]), len(both), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), digest))
    return sorted(out, key=repr)


ODD = [None, "", " ", "  two  spaces ", "a\n b\n\n  c\t d", "▁ under", "one▁two", "<|endoftext|> <s></s> <unk>", "café 　 漢字 \U0001f600 x  y", "x" * 700, "\x00 \x1c z", "\n", "it's  'tis", "end "]


def found_in(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture(scope="module")
def rows(texts):
    some = [(i, t[:3000]) for i, t in list(texts.items())[:60]]
    return some + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, some[3][1]), some[4], some[4], (2000, "long " * 3000)]


def test_equals_brute_force(as_documents, rows):
    assert found_in(alignment.aligned(as_documents(rows), A, B)) == plain_aligned(rows)


def test_many_parts_give_the_same(monkeypatch, as_documents, rows):
    monkeypatch.setattr(alignment, "SHARD_PAIRS", 300)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    assert found_in(alignment.aligned(as_documents(rows).repartition(7), A, B, table_bytes=40_000)) == plain_aligned(rows)


def test_pieces_may_be_forgotten(monkeypatch, as_documents, rows):
    tokens = alignment.Aligner(A, B)
    memory = alignment.Remembered(tokens, True)
    memory.numbers([t for _, t in rows])
    assert memory.number and not memory.full()
    memory.chars = alignment.REMEMBERED_CHARS + 1
    assert memory.full()
    memory.forget()
    again = memory.numbers(["a b a"])
    assert again[0].tolist()[0] == again[0].tolist()[2] and memory.known["n_a"].tolist() == [1, 1]


def test_pairs_and_perfect_hash(as_documents):
    keys = np.array(random.Random(2).sample(range(1 << 45), 5000))
    sizes, bits, placed = alignment.perfect_hash(keys)
    table = alignment.PairTable(1, [{"shard": 0, "sizes": sizes.tobytes(), "bits": bits.tobytes(), "keys": placed.tobytes()}])
    assert sorted(table.slots(keys).tolist()) == list(range(5000)) and set(placed) == set(keys)
    with pytest.raises(KeyError):
        table.slots(np.array([1 << 50]))
    found = alignment.pair_counts(as_documents([(1, "a b"), (2, "a")]), A, B).collect()
    assert sorted(r.links for r in found) == [1, 2]


def test_empty_tables(as_documents):
    assert alignment.aligned(as_documents([]), A, B).count() == 0
    assert found_in(alignment.aligned(as_documents([(1, None), (None, "")]), A, B)) == sorted([(1, *[0] * 6, ""), (None, *[0] * 6, "")], key=repr)


def test_documents_are_encoded_once(spark, as_documents, rows, monkeypatch):
    read, blocks = spark.sparkContext.accumulator(0), alignment.blocks

    def counted(batches, **given):
        for batch in blocks(batches, **given):
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(alignment, "blocks", counted)
    assert alignment.aligned(as_documents(rows[:40]), A, B).count() == 40
    assert alignment.aligned(as_documents(rows[:40]), A, B).collect() and read.value == 80


def test_pieces_encoded_together_are_those_encoded_alone(texts):
    tokens = alignment.Aligner(A, B)
    pieces = {p for t in [*list(texts.values())[:50], *ODD] if t for p in alignment.CUT.split(t)}
    assert {p for t in [*texts.values(), *ODD] if t for p in alignment.cut(t)} >= pieces
    assert all(alignment.cut(t) == alignment.CUT.split(t) for t in [*texts.values(), *ODD] if t)
    found = tokens.align(list(pieces))
    at = np.cumsum(found.n_links) - found.n_links
    for k, piece in enumerate(found.pieces):
        (a, b, n_a, n_b, exact) = tokens._alone([piece])
        assert (found.exact[k], found.n_a[k], found.n_b[k]) == (exact[0], n_a[0] * exact[0], n_b[0] * exact[0])
        if exact[0]:
            own = tokens.align([piece])
            assert found.groups[k] == own.groups[0] and found.pairs[at[k] : at[k] + found.n_links[k]].tolist() == own.pairs.tolist()
