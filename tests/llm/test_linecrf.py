import itertools
import random
import re
from collections import Counter

import numpy as np

from matchform.llm import linecrf


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(threes)
    covered = {i + k for i, w in enumerate(threes) if often[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


EDGE = [None, "", "\n\n", " \r\n x", "a\na\n a\na", "é é é é é", "b " * 80, "x|y<z>\nx|y<z>", "\x0b\x0c", "end\n", "w\n" * 5000]


def test_base_counts_equal_a_plain_version(as_documents, texts):
    rows = list(texts.items()) + [(1000 + i, t) for i, t in enumerate(EDGE)] + [(None, "no id"), (1000, "twice"), (1000, "twice")]
    found = linecrf.judged(as_documents(rows), linecrf.blank_field()).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=repr)
    assert got == sorted(((i, *plain_counts(t)) for i, t in rows), key=repr)
    assert all(r.kept == (not r.base_failed) and r.content_share == 1 for r in found)


def random_field(seed):
    rng = np.random.default_rng(seed)
    return linecrf.Field(rng.normal(size=len(linecrf.FEATURES)), rng.normal(size=(2, 2))), rng


def path_score(field, features, labels):
    score = sum(float(f @ field.weights) for f, y in zip(features, labels) if y)
    return score + sum(field.transitions[a, b] for a, b in zip(labels, labels[1:]))


def test_viterbi_and_likelihood_equal_enumeration():
    field, rng = random_field(3)
    row = np.repeat([0, 2, 5, 6], [4, 1, 7, 2])
    features = rng.normal(size=(len(row), len(linecrf.FEATURES)))
    labels = rng.integers(0, 2, len(row))
    found, total = linecrf.viterbi(field, features, row), 0.0
    for r in set(row.tolist()):
        own = features[row == r]
        scores = {y: path_score(field, own, y) for y in itertools.product((0, 1), repeat=len(own))}
        assert tuple(found[row == r].tolist()) == max(scores, key=scores.get)
        total += path_score(field, own, labels[row == r].tolist()) - np.logaddexp.reduce(list(scores.values()))
    value, by_weights, by_transitions = linecrf.likelihood(field, features, row, labels)
    assert np.isclose(value, total)
    for part, slope in ((field.weights, by_weights), (field.transitions, by_transitions)):
        for place in random.Random(1).sample(range(part.size), 3):
            flat = part.reshape(-1)
            flat[place] += 1e-5
            assert np.isclose((linecrf.likelihood(field, features, row, labels)[0] - value) / 1e-5, slope.reshape(-1)[place], atol=1e-3)
            flat[place] -= 1e-5


def test_good_documents_stay_and_bad_ones_go(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    field = linecrf.fit_on(documents.where("doc_id % 2 = 0"), labels)
    found = linecrf.judged(documents.where("doc_id % 2 = 1"), field).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in found if r.quality == q] for q in (1, 0))
    assert len(good) > 50 and np.mean(good) >= 0.97
    assert len(bad) > 10 and np.mean(bad) <= 0.2


def test_no_labels_and_empty_table(spark, as_documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    field = linecrf.fit_on(as_documents([(1, "a")]), none)
    assert not field.weights.any()
    assert linecrf.judged(as_documents([]), field).count() == 0
