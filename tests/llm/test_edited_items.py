import random

import corpus_pipeline as cp
from matchform.llm import decontaminate as dc
from matchform.llm.queries import QUERIES


def test_items_with_one_word_changed_are_found(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    items = [" ".join(rng.choices(words, k=n)) for n in (12, 20, 30, 45)]
    lead, rows = " ".join(rng.choices(words, k=70)), []
    for item, text in enumerate(items):
        own = text.split()
        for at in range(len(own)):
            for new in (["changed"], [], [own[at], "added"]):
                rows.append((len(rows), " ".join([lead, *own[:at], *new, *own[at + 1 :], lead]), item))
    others = [(10_000 + i, " ".join(rng.choices(words, k=200)), -1) for i in range(50)]
    # The words of an item in another order are not the item.
    others += [(20_000 + i, " ".join(rng.sample(t.split(), len(t.split()))), -1) for i, t in enumerate(items)]
    documents = spark.createDataFrame(rows + others, "doc_id long, text string, item long")
    documents.drop("item").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES["op7_bm25_decontamination"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, item) for i, _, item in rows}
    assert {r.doc_id for r in cp.benchmark_free(spark, documents, str(tmp_path)).collect()} == {i for i, _, _ in others}


def test_given_answers_keep_their_own_rule(spark, as_documents):
    items = spark.createDataFrame([(1, "what is the name of it in the long and winding tale", "an old one")], "item_id long, text string, answer string")
    rows = [(1, "what is the name of it in the long and winding tale"), (2, "what is the name of it in the long and winding tale an old one")]
    assert [r.doc_id for r in dc.contaminated(as_documents(rows), items, whole=True).collect()] == [2]
