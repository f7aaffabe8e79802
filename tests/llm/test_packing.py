import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from matchform.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGE = ["", " ", "  two  spaces ", "\n\n a\t b", "tail  ", "   lead", "a   b \n c", "<|endoftext|> it's", "é\x00ü " * 50, "x" * 5000, " a", "a "]


def model():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_word_by_word_equals_whole_texts(texts):
    encoder, whole = packing.Encoder(PATH, remembered=20_000), model()
    for some in (list(texts.values())[:40], EDGE, EDGE + list(texts.values())[40:80]):
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(some)] == [
            e.ids for e in whole.encode_batch(some, add_special_tokens=False)
        ]


def test_pieces_and_sequences(as_documents, texts):
    rows = list(texts.items())[:80] + [(1000 + i, t) for i, t in enumerate(EDGE)] + [(2000, None), (None, "no id"), (2001, "twice"), (2001, "twice"), (2002, "w " * 40_000)]
    found = packing.pack(packing.pieces(as_documents(rows), PATH)).collect()
    whole, plain = model(), []
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 1024):
            part = np.array(ids[at : at + 1024], "<u4")
            plain.append((i, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(plain, key=repr)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and len(parts) <= packing.SEGMENTS


def test_all_limits_hold_and_little_is_wasted():
    rng = np.random.default_rng(2)
    length = rng.integers(1, 1024, 4000)
    loss = np.minimum(length, rng.integers(0, 700, 4000))
    limits = (1024, 6, 800)
    bins, offsets = packing.fill_bins(length, loss, limits)
    for total, limit in ((np.bincount(bins, length), 1024), (np.bincount(bins), 6), (np.bincount(bins, loss), 800)):
        assert total.max() <= limit
    for b in range(20):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert (offsets[own] == np.cumsum(length[own]) - length[own]).all()
    best = max(-(-length.sum() // 1024), -(-4000 // 6), -(-loss.sum() // 800))
    assert bins.max() + 1 <= 1.05 * best


def test_an_item_over_a_limit_has_its_own_bin():
    bins, _ = packing.fill_bins(np.array([2000, 10, 10]), np.array([0, 0, 0]), (1024, 8, 8))
    assert bins[0] not in bins[1:] and bins[1] == bins[2]


def test_empty_table(as_documents):
    assert packing.pack(packing.pieces(as_documents([]), PATH)).count() == 0


def test_new_words_are_merged_in_one_go():
    """One merge for all new words of a call, besides first words and words that begin with white space."""
    encoder, whole, calls = packing.Encoder(PATH), model(), []
    merge = encoder.merge
    encoder.merge = lambda text: calls.append(text) or merge(text)
    texts = [f"start w{i}, é{i}. (x{i})\nnext{i} last" for i in range(50)]
    for some in (texts, texts):
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(some)] == [e.ids for e in whole.encode_batch(some, add_special_tokens=False)]
    assert sum(len(c) > 5 for c in calls) == 1 and len(calls) <= 5


def test_white_space_around_a_space_may_be_one_token():
    texts = ["x \xa0 \xa0 y", "\xa0 \xa0", "a\n \tb", "a \xa0 \xa0", "\x85 \x85 b", "　 c \xa0d"]
    found = packing.Encoder(PATH).encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in found] == [e.ids for e in model().encode_batch(texts, add_special_tokens=False)]
