import zlib

import numpy as np

from matchform.llm import bytenet


def plain_probability(net, text):
    """The same network, one position at a time."""
    symbols = list(text) or [bytenet.PAD]
    reach = symbols + [bytenet.PAD] * bytenet.WIDTH
    found = [
        np.maximum(net.offset + sum(net.filters[t, reach[i + t]] for t in range(bytenet.WIDTH)), 0) for i in range(len(symbols))
    ]
    hidden = []
    for at in range(0, max(1, len(symbols) - bytenet.HOP), bytenet.HOP):
        chunk = found[at : at + bytenet.CHUNK]
        features = np.append(np.max(chunk, axis=0), len(chunk) / bytenet.CHUNK)
        hidden.append(np.maximum(features @ net.hidden + net.hidden_offset, 0))
    logit = np.max(hidden, axis=0) @ net.output + net.output_offset[0]
    return 1 / (1 + np.exp(-logit))


def test_every_byte_counts_and_equals_the_plain_network(as_documents, texts):
    net = bytenet.untrained(seed=3)
    rows = list(texts.items())[:25] + [(900, None), (901, ""), (902, "x"), (903, "é" * 3000), (None, "a b"), (903, "é" * 3000)]
    found = bytenet.scores(as_documents(rows), net).collect()
    assert len(found) == len(rows)
    expected = sorted(((i, plain_probability(net, (t or "").encode())) for i, t in rows), key=repr)
    got = sorted(((r.doc_id, r.score) for r in found), key=repr)
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert np.allclose([s for _, s in got], [s for _, s in expected], atol=1e-5)
    for r in found:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.7)


def test_gradients_equal_differences():
    net = bytenet.untrained(filters=3, hidden=4, seed=1)
    net.__dict__.update({k: v.astype(np.float64) for k, v in net.__dict__.items()})
    texts, labels = [b"some text here, twice as long as a hop. " * 9, b"", b"!!?"], np.array([1, 0, 1])

    def loss():
        p = np.array([plain_probability(net, t) for t in texts])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for part, gradient in zip(net.parts(), bytenet._gradients(net, texts, labels)):
        for place in list(np.argsort(-np.abs(gradient).ravel())[:2]):
            flat = part.reshape(-1)
            old = flat[place]
            flat[place] = old + 1e-4
            up = loss()
            flat[place] = old - 1e-4
            down = loss()
            flat[place] = old
            assert abs((up - down) / 2e-4 - gradient.ravel()[place]) < 1e-3


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    net = bytenet.fit_on(documents, labels)
    judged = bytenet.scores(documents, net).where("held_out").join(labels, "doc_id").collect()
    assert len(judged) > 50
    assert np.mean([r.predicted == r.quality for r in judged]) >= 0.93


def test_nothing_to_learn_or_to_score(as_documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = bytenet.fit_on(as_documents([(1, "a")]), none)
    assert bytenet.scores(as_documents([]), net).count() == 0
    assert bytenet.kept(as_documents([(1, None)]), net, 0.0).columns == ["doc_id", "text", "version", "bits", "start"]
