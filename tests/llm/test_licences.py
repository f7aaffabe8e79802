import re

from matchform.llm import licences


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licences.PHRASES.items():
        own = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


APACHE = licences.TEMPLATES["apache-2"][0]
MIT = licences.TEMPLATES["mit"][0]
EDGE = [None, "", " .. ", "Under the MIT License under the mit license", "apache-license/version 2", "CC BY-NC cc by nc by nc", "é\x00under the mit licenseé",
        "under the mit license " * 3000, "x " * 60_000, MIT, "# " + APACHE.replace(" ", "\n# "), MIT.replace("merge, ", ""), MIT[:60], "permission granted free software restriction copy"]


def test_base_columns_equal_a_plain_version(as_documents, texts):
    rows = list(texts.items()) + [(1000 + i, t) for i, t in enumerate(EDGE)] + [(None, "no id"), (1, "twice"), (1, "twice")]
    found = licences.scan(as_documents(rows)).collect()
    got = sorted((tuple(r)[:6] for r in found), key=repr)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in found)
    assert all(0 <= r.score <= 1 for r in found)


def test_templates_are_found_with_their_phrases_only(as_documents):
    rows = [(i, "some code first " * 9 + text + " and more") for i, (text, _) in enumerate(licences.TEMPLATES.values())]
    found = {r.doc_id: r for r in licences.scan(as_documents(rows)).collect()}
    for i, label in enumerate(licences.TEMPLATES):
        assert label in found[i].labels.split(",")
    rows = [(1, MIT.replace("merge, ", "")), (2, MIT.replace("hereby granted", "granted")), (3, MIT[:60]), (4, " ".join(reversed(MIT.split())))]
    found = {r.doc_id: r.labels for r in licences.scan(as_documents(rows)).collect()}
    assert found == {1: "mit", 2: "", 3: "", 4: ""}


def test_candidates_are_all_places_with_enough_rare_words():
    index = licences.RareWords({"a": ("one two three four five six", ["two three"]), "b": ("one seven eight nine", ["seven"])}, rare=0.5)
    words = b"x one two three y five six z seven eight".split()
    got = {}
    for label, _, have in index.candidates(words, share=0.3, slack=1):
        got[label] = max(got.get(label, 0), have)
    plain_share = {}
    for label, own in (("a", b"two three four five six".split()), ("b", b"seven eight nine".split())):
        offset, best = 1, 0
        for start in range(-9, 20):
            hit = {q for q, w in enumerate(own) for d in (0, 1) if 0 <= start + q + d < len(words) and words[start + q + d] == w}
            best = max(best, len(hit) / len(own))
        plain_share[label] = best
        assert offset == 1
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in plain_share.items()}


def test_empty_table(as_documents):
    assert licences.scan(as_documents([])).count() == 0
