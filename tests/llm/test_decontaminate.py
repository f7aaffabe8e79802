import numpy as np

from matchform.llm import decontaminate as dc


def plain_words(text):
    table = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
    return (text or "").encode().translate(table).split()


def plain_share(part, have):
    width = min(5, len(part))
    if not width:
        return 1.0
    wanted = {tuple(part[i : i + width]) for i in range(len(part) - width + 1)}
    return len(wanted & {tuple(have[i : i + width]) for i in range(len(have) - width + 1)}) / len(wanted)


def plain_scores(items, passage):
    """BM25 of a passage's distinct words against every item, as a share of the item's own score."""
    words = [plain_words(t) for t in items]
    mean = np.mean([len(w) for w in words])
    shares = []
    for own in words:
        score = {}
        for term in set(own):
            seen, tf = sum(term in w for w in words), own.count(term)
            idf = np.log(1 + (len(words) - seen + 0.5) / (seen + 0.5))
            score[term] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
        shares.append(sum(v for t, v in score.items() if t in set(passage)) / sum(score.values()))
    return shares


def test_all_passages_above_the_threshold_are_found(texts):
    documents = [t or "" for t in list(texts.values())[:60]]
    items = [" ".join(t.split()[5:45]) for t in documents if len(t.split()) > 60][:20] + ["rare zebra quux", "the of and"]
    index = dc.build_index(list(range(len(items))), items)
    for text in documents:
        raw = np.frombuffer(text.encode(), np.uint8)
        words, first = dc.word_hashes(raw, np.array([0, len(raw)]))
        got = {(start, item): score for _, start, item, score in dc.search(index, words, first, 0.3)}
        plain, expected, stride = plain_words(text), {}, index.longest
        for n in range(max(1, -(-len(plain) // stride) - 1)):
            for item, share in enumerate(plain_scores(items, plain[n * stride : (n + 2) * stride])):
                if share >= 0.3:
                    expected[n * stride, item] = share
        assert got.keys() == expected.keys()
        assert np.allclose([got[k] for k in expected], list(expected.values()))


def test_planted_items_are_found_and_others_left(spark, as_documents, texts):
    bench = [(i, f"{' '.join(t.split()[:30])}") for i, t in list(texts.items())[:40] if t and len(t.split()) > 60]
    clean = [(i + 500, t) for i, t in list(texts.items())[100:140]]
    first = bench[0][1].split()
    near = " ".join([*first[:10], "changed", *first[11:]])
    half = " ".join(first[:15])
    planted = [(900, "lead " * 300 + bench[1][1].upper() + " tail" * 200), (901, near), (902, half), (903, None), (904, ""), (None, bench[2][1]), (900, "twice")]
    items = spark.createDataFrame([*bench, (77, None), (78, ""), (None, "null item id is this one here")], "item_id long, text string")
    found = dc.contaminated(as_documents(clean + planted), items)
    expected = set()
    for i, t in clean + planted:
        for item, text in [*bench, (-1, "null item id is this one here")]:
            own, have = plain_words(text), plain_words(t)
            cut = len(own) - len(own) // 3
            if min(plain_share(own[:cut], have), plain_share(own[cut:], have)) >= 0.8:
                expected.add((i, item))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    assert {(900, bench[1][0]), (None, bench[2][0])} <= expected
    kept = dc.clean(as_documents(clean + planted), items)
    gone = {i for i, _ in expected}
    assert kept.columns == ["doc_id", "text", "version", "bits", "start"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, _ in clean + planted if i not in gone] + [900])


def test_given_answers_and_small_indexes(spark, as_documents):
    items = spark.createDataFrame([(1, "what is the name of it", "a very long answer indeed"), (2, "who was that one there", "no")], "item_id long, text string, answer string")
    rows = [(1, "q what is the name of it"), (2, "what is the name of it a very long answer indeed"), (3, "who was that one there no")]
    documents = as_documents(rows)
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(documents, items).collect()) == [(2, 1), (3, 2)]
    assert len(list(dc.indexes(items, size=1))) == 2


def test_empty_tables(spark, as_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(as_documents([(1, "a")]), none).count() == 0
    assert dc.contaminated(as_documents([]), none).count() == 0
    assert dc.clean(as_documents([(1, "a")]), none).count() == 1
