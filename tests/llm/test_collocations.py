import random
import re
from collections import Counter

import numpy as np
import pytest

from matchform.llm import bundles, collocations

TABLE_FOLD = {c: c + 32 for c in range(65, 91)}


def plain_phrases(rows, least=30, share=80, scale=2_000_000, top=2000):
    """The same from a table of all phrases; rows are (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(TABLE_FOLD)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    around = Counter()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                around[lang, words[i : i + k]] = max(a, around[lang, words[i : i + k]])
    out = {}
    for (lang, words), a in candidates.items():
        if around[lang, words] * 100 >= share * a:
            continue
        score, _, l, r = min((scale * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def found_in(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "of", "a", "RED", "red", "fox,", "is", "é", "x.y", "end\n", "b\tc", "q\rz", "ab "]
    rows = [(" ".join(rng.choices(words, [9, 7, 5, 1, 3, 2, 2, 1, 1, 2, 1, 1, 1], k=rng.randrange(60))), rng.choice(["en", "fr", None, "und"])) for _ in range(400)]
    return rows + [("the red fox is", "en")] * 90 + [(None, "en"), ("", None), (" \t", "fr"), ("lone of the " * 4000, "fr")]


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as a", "'x' as phrase", "2 as words", "3 as hash")


@pytest.mark.parametrize(("least", "run", "bucket", "top"), [(30, 1 << 21, 1 << 20, 2000), (5, 900, 1 << 20, 2000), (8, 700, 200, 25)])
def test_equals_brute_force(spark, rows, least, run, bucket, top):
    found = collocations.phrases(frame_of(spark, rows).repartition(3), least=least, top=top, run=run, bucket=bucket)
    assert found_in(found) == plain_phrases(rows, least, top=top)


def test_hot_leading_words_are_dealt_further():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 5, (4, 3000)).astype(np.uint64)
    two = bundles.joined(words[0], words[1])
    three = bundles.joined(two, words[2])
    routes = collocations.Routes(np.unique(two[:10]), np.unique(three[:4]), 64)
    route = routes(words)
    assert set(routes.bucket(route)) <= set(range(64))
    hot = routes.among(two, routes.two)
    assert len(np.unique(route[hot & (two == two[0])])) > 1 and len(np.unique(route[~hot])) == len(np.unique(two[~hot]))


def test_partitions_equal_counts():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, (4, 5000)).astype(np.uint64)
    for k in range(1, 4):
        words[k][words[k - 1] == 0] = 0
    times = rng.integers(1, 5, 5000)
    expected = Counter()
    for column, n in zip(words.T.tolist(), times.tolist()):
        for k in range(1, 5):
            if column[k - 1]:
                expected[tuple(column[:k])] += n
    at, depth, weight = collocations.partitions(words, times, 40)
    found = {tuple(words[:k, i].tolist()): w for i, k, w in zip(at.tolist(), depth.tolist(), weight.tolist())}
    assert found == {p: n for p, n in expected.items() if n >= 40} and len(found) == len(at)


def test_exact_where_products_pass_64_bits(spark):
    big = 2**62
    phrases = spark.createDataFrame([([1, 2], big)], "words array<long>, times long")
    single = spark.createDataFrame([(1, big), (2, big + 1)], "hash long, times long")
    assert [tuple(r) for r in collocations._scored(phrases, single, 2_000_000).collect()] == [([1, 2], big, big, big + 1, 2_000_000 * big // (2 * big + 1))]


def test_empty_and_short_tables(spark):
    assert collocations.phrases(frame_of(spark, [])).count() == 0
    assert collocations.phrases(frame_of(spark, [(None, None), ("", "en"), ("one", "fr")])).count() == 0


def test_bundles_and_bits(spark):
    arrays = [np.arange(5, dtype=np.uint64), bundles.small(np.array([3, 300])), np.empty(0, np.int64)]
    assert all(np.array_equal(x, y) and x.dtype == y.dtype for x, y in zip(arrays, bundles.unpacked(bundles.packed(arrays))))
    hashes = np.sort(np.random.default_rng(2).integers(0, 2**64, 999, np.uint64))
    assert np.array_equal(bundles.from_planes(bundles.planes(hashes)), hashes) and len(bundles.from_planes(bundles.planes(hashes[:0]))) == 0
    keys = spark.range(2000).selectExpr("xxhash64(id) as h")
    bits = bundles.HashBits.of(keys, "h")
    own = np.array([r.h for r in keys.collect()]).view(np.uint64)
    assert bits.has(own).all() and bits.has(own + np.uint64(1)).mean() < 0.01


def test_codes_of_ranked_and_other_words():
    words = np.array([[5, 9, 7, 5], [9, 0, 1 << 63, 9], [0, 0, 3, 2], [0, 0, 0, 2]], np.uint64)
    for ranked in ([9, 5], []):
        ranks = bundles.Ranks(np.array(ranked, np.uint64))
        back, times = ranks.words(ranks.bundle(words, ranks.codes(words), np.array([1, 2, 300, 4])), 4)
        assert np.array_equal(back, words) and times.tolist() == [1, 2, 300, 4]
