import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import plain_share, plain_words
from test_nearcopies import plain_firsts
from test_substrings import plain_removed

import corpus_pipeline as cp
from matchform.llm import bytenet, packing


def edits(item, words):
    """Words of an item to change, leave out or add to make a stretch of the words, by the textbook table."""
    cost = [0] * (len(words) + 1)
    for i, own in enumerate(item, 1):
        new = [i]
        for j, word in enumerate(words, 1):
            new.append(min(cost[j] + 1, new[-1] + 1, cost[j - 1] + (own != word)))
        cost = new
    return min(cost)


def plain_dirty(items, text):
    """Whether a text holds one of the items: both parts by shingles, or four fifths of its words in line."""
    words = plain_words(text)
    for own in items:
        head, tail = own[: len(own) - len(own) // 3], own[len(own) - len(own) // 3 :]
        if min(plain_share(head, words), plain_share(tail, words)) >= 0.8:
            return True
        if len(set(own) & set(words)) * 2 > len(set(own)) and edits(own, words) <= 0.2 * len(own) + 1e-9:
            return True
    return False


def rows_of(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_each_stage_against_a_plain_version(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [len(cp.STAGES), *[callable(f) for _, f in cp.STAGES]] == [5, *[True] * 5]

    done = cp.quality(spark, docs, folder).cache()
    assert done.columns == columns
    net = bytenet.fit_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = {i: bytenet.probabilities(net, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for i, t in texts.items()}
    kept = rows_of(done)
    assert kept == {i: t for i, t in texts.items() if scored[i] >= 0.7}

    done = cp.near_copies(spark, done, folder).cache()
    assert done.columns == columns
    firsts = set(plain_firsts(list(kept.items())))
    kept = {i: t for i, t in kept.items() if i in firsts}
    assert rows_of(done) == kept

    done = cp.repeated_passages(spark, done, folder).cache()
    assert done.columns == columns
    cut = rows_of(done)
    lost = {i: (n, gone) for i, n, gone, _ in plain_removed(list(kept.items()), 50)}
    assert set(cut) == {i for i, (n, gone) in lost.items() if gone < n or not n}
    assert all(len(cut[i].split()) == lost[i][0] - lost[i][1] for i in cut)

    done = cp.benchmark_free(spark, done, folder).cache()
    assert done.columns == columns
    items = [plain_words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/benchmark.parquet'").fetchall()]
    dirty = {i for i, t in cut.items() if plain_dirty(items, t)}
    assert dirty
    assert rows_of(done) == {i: t for i, t in cut.items() if i not in dirty}

    pieces = cp.packed(spark, done, folder).collect()
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    clean = {i: t for i, t in cut.items() if i not in dirty}
    sizes = {i: len(ids) // 4 + 1 for i, ids in zip(clean, encoder.encode(list(clean.values())))}
    assert {(r.doc_id, r.start, r.length) for r in pieces} == {(i, at, min(1024, n - at)) for i, n in sizes.items() for at in range(0, n, 1024)}


def test_one_row_of_a_group_stays(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "e f g h"), (3, "e f g h"), (2, "x"), (5, "x"), (3, "other words are these")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as place", "2 as own_id", "3 as bits")
    found = cp.near_copies(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == sorted({(None, "a b c d"), (3, "e f g h"), (2, "x"), (3, "other words are these")}, key=repr)


def folder_of(spark, path, rows, folder):
    """Documents with columns whose names clash with the operators' own, and the other tables as they are."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.selectExpr("*", "1 as version", "'x' as spans", "2 as print", "3 as root", "4 as start", "5 as length").write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def odd_rows(texts):
    good = [(i, t) for i, t in texts.items() if t and len(t.split()) > 80][:60]
    long = " ".join(t for _, t in good * 6)
    odd = [(None, good[0][1]), (None, good[0][1]), (None, None), (9001, None), (9002, ""), (9003, " \n"), (9004, long), good[1], good[1], (good[2][0], good[3][1])]
    return [(i, t, "en", "s", len(t or "")) for i, t in [*good, *odd]]


def test_every_stage_bears_odd_rows(spark, folder, texts, tmp_path):
    own = folder_of(spark, tmp_path, odd_rows(texts), folder)
    docs = spark.read.parquet(f"{own}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        found = stage(spark, docs, own)
        found.write.parquet(f"{tmp_path}/done{k}")
        done = spark.read.parquet(f"{tmp_path}/done{k}")
        if k < len(cp.STAGES) - 1:
            assert done.columns == docs.columns
            before, after = ({(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()} for frame in (docs, done))
            assert {i for i, _ in after} <= {i for i, _ in before} and (k == 2 or after <= before)
            docs = done
    # Every token of what is left is in one piece.
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    left = [r.text or "" for r in docs.collect()]
    assert left and sum(r.length for r in done.collect()) == sum(len(ids) // 4 + 1 for ids in encoder.encode(left))


@pytest.mark.parametrize("k", range(5))
def test_every_stage_bears_an_empty_table(spark, folder, k):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    assert cp.STAGES[k][1](spark, docs, folder).count() == 0


def test_whole_run(spark, folder, texts, tmp_path):
    """The run is its stages one after the other; odd rows go through it."""
    own = folder_of(spark, tmp_path, odd_rows(texts), folder)
    docs = spark.read.parquet(f"{own}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, own).write.parquet(f"{tmp_path}/step{k}")
        docs = spark.read.parquet(f"{tmp_path}/step{k}")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    found, expected = (sorted(map(tuple, frame.select(*names).collect()), key=repr) for frame in (cp.run(spark, own), docs))
    assert found == expected and found
    assert cp.run(spark, folder).count() > 0
