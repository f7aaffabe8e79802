"""Licence scan: a positional index of rare template words, relative positions, and mandatory phrases.

Each template's words are indexed with their positions and inverse template frequency. Of a file's words only those
that are rare among the templates are looked up. A hit at file position p of a word at template position q votes for
the template beginning at p - q; votes within a few words of each other add up. A place with enough of a template's
rare words is a candidate, and is a licence if each mandatory phrase of the template stands there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchform.llm.texts import blocks, column_of

# The phrases of the base rule and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening words of public licence notices, and what must stand in a text that carries the label.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ["apache license version 2 0", "except in compliance with the license"],
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer",
        ["redistribution and use in source and binary forms", "must retain the above copyright notice"],
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
        ["under the terms of the gnu general public license", "published by the free software foundation"],
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
        ["mozilla public license v 2 0"],
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee", "appear in all copies"],
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this "
        "license, visit creativecommons.org",
        ["licensed under a creative commons attribution 4 0 international license"],
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software",
        ["free and unencumbered software released into the public domain"],
    ),
}

# Words that stand in at most this share of the templates are rare; shares of rare words that make a candidate; words
# by which the places of two votes for one template may differ.
RARE = 0.3
SHARE = 0.5
SLACK = 4

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters and digits and all other characters."""
    return text.translate(_FOLD).split()


def places(words: list[bytes], line: bytes, phrase: list[bytes]) -> list[int]:
    """Numbers of the words at which ``phrase`` begins; ``line`` holds the words with a space around each."""
    wanted, found, at = b" " + b" ".join(phrase) + b" ", [], -1
    number, counted = 0, 0
    while (at := line.find(wanted, at + 1)) >= 0:
        number, counted = number + line.count(b" ", counted, at), at
        found.append(number)
    return found


class RareWords:
    """The positional index of the rare words of a set of templates."""

    def __init__(self, templates: dict[str, tuple[str, list[str]]] | None = None, rare: float = RARE):
        templates = TEMPLATES if templates is None else templates
        words = {label: words_of(text.encode()) for label, (text, _) in templates.items()}
        seen: dict[bytes, int] = defaultdict(int)
        for own in words.values():
            for w in set(own):
                seen[w] += 1
        self.mandatory = {label: [words_of(p.encode()) for p in phrases] for label, (_, phrases) in templates.items()}
        self.length = {label: len(own) for label, own in words.items()}
        self.postings: dict[bytes, list[tuple[str, int, float]]] = defaultdict(list)
        self.weight = dict.fromkeys(words, 0.0)
        for label, own in words.items():
            for q, w in enumerate(own):
                if seen[w] <= max(1, rare * len(words)):
                    idf = float(np.log((1 + len(words)) / seen[w]))
                    self.postings[w].append((label, q, idf))
                    self.weight[label] += idf

    def candidates(self, words: list[bytes], share: float = SHARE, slack: int = SLACK) -> list[tuple[str, int, float]]:
        """(label, word at which the template would begin, share of its rare words' weight) of every candidate place."""
        hits = self.postings.keys() & set(words)
        if not hits:
            return []
        votes: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in hits:
                for label, q, idf in self.postings[w]:
                    votes[label].append((p - q, q, idf))
        found = []
        for label, own in votes.items():
            # Votes in the order of the place they stand for; a window of ``slack`` words moves over them.
            own.sort()
            held: dict[int, int] = defaultdict(int)
            low, have = 0, 0.0
            for place, q, idf in own:
                # A template word counts once, however often the file has it near its place.
                have += idf if not held[q] else 0.0
                held[q] += 1
                while place - own[low][0] > slack:
                    _, gone, less = own[low]
                    held[gone] -= 1
                    have -= less if not held[gone] else 0.0
                    low += 1
                if have >= share * self.weight[label] - 1e-9:
                    found.append((label, own[low][0], have / self.weight[label]))
        return found

    def labels(self, words: list[bytes]) -> dict[str, float]:
        """Verified labels with their best share."""
        sure: dict[str, float] = {}
        for label, start, have in self.candidates(words):
            low, high = max(0, start - SLACK), start + self.length[label] + 2 * SLACK
            near = words[low:high]
            line = b" " + b" ".join(near) + b" "
            if all(places(near, line, phrase) for phrase in self.mandatory[label]):
                sure[label] = max(sure.get(label, 0.0), min(have, 1.0))
        return sure


def scan(documents: DataFrame, templates: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """Licence phrases and labels of every document, from its whole text.

    ``n_base`` places of the base phrases with the first and last word they begin at (null without),
    their labels, all labels with those of verified templates, and ``score``: 1 with a base phrase, else
    the best verified share of a template's rare words, else 0. A null text is empty; repeated rows stay;
    an empty table gives an empty result; other columns are ignored.
    """
    index = RareWords(templates)
    phrases = [(words_of(p.encode()), label) for p, label in PHRASES.items()]

    def one(text: bytes) -> tuple:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        found = [(places(words, line, phrase), label) for phrase, label in phrases]
        at = [p for where, _ in found for p in where]
        base = {label for where, label in found if where}
        sure = index.labels(words)
        score = 1.0 if base else max(sure.values(), default=0.0)
        ends = (min(at), max(at)) if at else (None, None)
        return len(words), len(at), *ends, ",".join(sorted(base)), ",".join(sorted(base | sure.keys())), score

    kinds = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = [one(t.as_py() or b"") for t in column_of(batch, "text").cast(pa.binary())]
            columns = [pa.array([r[i] for r in rows], arrow[kind]) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), *columns], ["doc_id", *kinds])

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))
