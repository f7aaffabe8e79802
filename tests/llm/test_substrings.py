import hashlib
import random

import numpy as np
import pytest

from matchform.llm import repeats, substrings


def plain_removed(rows, length):
    """The same result from a table of all windows."""
    words = [[w for w in (t or "").encode().split()] for _, t in rows]
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    least = {}
    for i, own in zip(ids, words):
        for at in range(len(own) - length + 1):
            key = tuple(own[at : at + length])
            least[key] = min(i, least.get(key, i))
    out = []
    for (public, _), i, own in zip(rows, ids, words):
        gone = [False] * len(own)
        for at in range(len(own) - length + 1):
            if least[tuple(own[at : at + length])] < i:
                gone[at : at + length] = [True] * length
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out.append((public, len(own), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found_in(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_documents_and_edge_cases_equal_brute_force(as_documents, texts):
    some = list(texts.items())
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = some + [(1000, None), (1001, ""), (1002, " \n"), (1003, long), (1004, "x " * 500), (1005, "x " * 300), (1003, long), (None, some[0][1]), (1006, long[:3000]), (1006, "other")]
    assert found_in(substrings.removed_words(as_documents(rows))) == plain_removed(rows, 50)


def test_many_equal_rows_without_id_have_the_spans_of_one(as_documents, texts):
    text = next(t for t in texts.values() if t and len(t.split()) > 120)
    other = [(i, t) for i, t in texts.items() if t != text][:20]
    found = substrings._with_spans(as_documents([*other, (-5, text), *[(None, text)] * 2000]), 50, 8)
    sizes = [r.n for r in found.where(f"doc_id = {2**63 - 1}").selectExpr("size(spans) as n").collect()]
    assert len(sizes) == 2000 and len(set(sizes)) == 1 and sizes[0] < len(text.split())


def test_a_shared_passage_moves_as_few_rows(as_documents):
    words = [f"w{n}" for n in range(200)]
    rows = [(n, " ".join([f"own{n}", *words])) for n in range(300)]
    kind = repeats.Windows(20, 8, True)
    shared = repeats._shared(repeats.keyed(as_documents(rows).coalesce(1)), kind)
    places = shared.agg(repeats.copies()).first()[0]
    assert places == 300 * 28 and shared.count() <= places // 15
    assert found_in(substrings.removed_words(as_documents(rows), 20)) == plain_removed(rows, 20)


@pytest.mark.parametrize(("group", "most"), [(40, 60), (500, 10**6), (1 << 18, 1 << 20)])
def test_groups_of_any_size_give_the_same(monkeypatch, as_documents, group, most):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        line = [f"w{rng.randrange(3)}" for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(line + ["a", "b", "c", "d", "e", "f", "g"] * rng.randrange(3) + line[:9])))
    kind = repeats.Windows(8, 3, True)
    monkeypatch.setattr(substrings, "Groups", lambda k, c: repeats.Groups(k, c, group, most))
    assert kind.length == 8
    assert found_in(substrings.removed_words(as_documents(rows), words=8, gram=3)) == plain_removed(rows, 8)


def test_texts_are_cut_and_other_columns_stay(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"head\n{line}  tail", "a"), (2, f"own start {line}\nend", "b"), (3, line, "c"), (4, None, "d"), (5, "", "e"), (None, "short", "f"), (2, "another text", "g")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, version string").selectExpr("*", "length(text) as n_chars")
    found = {r.version: (r.doc_id, r.text, r.n_chars) for r in substrings.without_repeats(documents).collect()}
    assert found == {"a": (1, rows[0][1], len(rows[0][1])), "b": (2, "own start end", 13), "d": (4, None, None), "e": (5, "", 0), "f": (None, "short", 5), "g": (2, "another text", 12)}


def test_deep_nodes():
    symbols = np.array([1, 2, 3, 4, 1, 2, 3, 5, 1, 2, 3, 4], np.uint64)
    node = substrings.deep_nodes(symbols, np.array([0, 4, 8, 1]), 4 - 0)
    assert node[0] == node[2] >= 0 and node[1] == -1 and node[3] == -1


def test_empty_table(as_documents):
    assert substrings.removed_words(as_documents([])).count() == 0
    assert substrings.without_repeats(as_documents([])).count() == 0
