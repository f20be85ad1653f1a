"""License scans by a positional index of rare template words.

Templates are license texts, whole or their notices. A template is cut into parts of about `PART` words, so that a file's
additions in one place do not shift the rest of it. The index holds each part's words with their places; a word's weight is its inverse
document frequency among the parts. In a file the words that are in the index are located, all of them are looked up, and
postings are intersected by relative position: each place votes with its word's weight for the file position at which the part
would begin. Where the votes of a part agree its words are aligned one by one, each up to `slack` words away. A template's parts that stand in
about its order and distance add up; the template counts if the share of its weight that is found is enough and its
mandatory key phrases stand there in full.

Short phrases are templates whose key phrase is the whole text; each is looked up by its rarest word at every place, so
all their places are found. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null or empty text has no
words, no labels and score 0. Repeated rows are scanned one by one. Columns other than the two named are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import trimmed
from .text import ALNUM, slices, split

#: Phrases of the base scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, template text, mandatory key phrases. The wording is that of the licenses and of their public notices.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software.""", ["permission is hereby granted free of charge", "without restriction"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.""", ["for any purpose with or without fee is hereby granted"]),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.""", ["redistribution and use in source and binary forms"]),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission
        is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered
        from any source distribution.""", ["permission is granted to anyone to use this software for any purpose", "must not be misrepresented"]),
    ("bsl", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
        reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject
        to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of
        the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
        language processor.""", ["accompanying documentation covered by this license"]),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", ["free and unencumbered software"]),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ["licensed under the apache license", "in compliance with the license"]),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation""",
        ["you can redistribute it", "gnu general public license as published by"]),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation""",
        ["gnu lesser general public license"]),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation""",
        ["gnu affero general public license"]),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at""", ["mozilla public license"]),
    ("epl", """This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution""", ["eclipse public license"]),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related"]),
]
#: words of a part of a template
PART = 24

SCANNED = "doc_id long, n_words long, places array<struct<word:long,label:string>>, found array<struct<word:long,label:string,score:double>>"


def plain_words(text: str) -> list[str]:
    words = split(pa.array([text]), ALNUM)
    raw = words.data.tobytes()
    return [raw[a:b].decode() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]


@dataclass
class Index:
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    labels: list[str] = field(default_factory=list)
    #: words of each template, its parts as (first word, words), key phrases as words
    words: list[list[int]] = field(default_factory=list)
    parts: list[list[int]] = field(default_factory=list)
    keys: list[list[list[int]]] = field(default_factory=list)
    #: postings of vocabulary entry w, posted[w] to posted[w + 1]: parts that hold it, and where
    posted: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    posting_part: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    posting_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    part: list[tuple[int, int, list[int]]] = field(default_factory=list)
    #: the parts' words and their weights, one row a part, filled up with -2 of weight 0
    part_words: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    part_weight: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    phrases: dict[int, list[tuple[str, list[int], int]]] = field(default_factory=dict)
    #: vocabulary entries without which no template's key phrases and no phrase can stand in a file
    triggers: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @classmethod
    def build(cls, templates: list[tuple[str, str, list[str]]], phrases: dict[str, str]) -> Index:
        plain = [plain_words(text) for _, text, _ in templates]
        short = [(label, plain_words(text)) for text, label in phrases.items()]
        pieces = [(t, i, words[i : i + size]) for t, words in enumerate(plain) for size in [-(-len(words) // -(-len(words) // PART))] for i in range(0, len(words), size)]
        vocabulary = sorted({w for words in [*plain, *(x for _, x in short)] for w in words})
        hashes = split(pa.array(vocabulary), ALNUM).hashes()
        order = np.argsort(hashes)
        number = {vocabulary[i]: n for n, i in enumerate(order.tolist())}
        df = Counter(number[w] for words in [*(x for *_, x in pieces), *(x for _, x in short)] for w in set(words))
        weight = np.array([math.log((1 + len(pieces) + len(short)) / (0.5 + df[i])) for i in range(len(vocabulary))])
        telling = lambda w: (weight[w], len(vocabulary[order[w]]))  # noqa: E731  of equally rare words the longest
        index = cls(hashes[order], weight, [label for label, _, _ in templates], [[number[w] for w in words] for words in plain], [[] for _ in plain])
        index.triggers = np.zeros(len(vocabulary), bool)
        index.phrases = defaultdict(list)
        for _, _, keys in templates:
            index.keys.append([[number[w] for w in plain_words(key)] for key in keys])
            for key in index.keys[-1]:
                index.triggers[max(key, key=telling)] = True
        for p, (t, first, words) in enumerate(pieces):
            index.parts[t].append(p)
            index.part.append((t, first, [number[w] for w in words]))
        index.part_words = np.full((len(pieces), PART), -2, np.int32)
        for p, (*_, words) in enumerate(index.part):
            index.part_words[p, : len(words)] = words
        index.part_weight = np.where(index.part_words >= 0, weight[index.part_words], 0.0)
        index.posting_part, index.posting_at = (x.astype(np.int64) for x in np.nonzero(index.part_words >= 0))
        entry = index.part_words[index.posting_part, index.posting_at]
        by_entry = np.argsort(entry, kind="stable")
        index.posting_part, index.posting_at = index.posting_part[by_entry], index.posting_at[by_entry]
        index.posted = np.searchsorted(entry[by_entry], np.arange(len(vocabulary) + 1))
        for label, words in short:
            own = [number[w] for w in words]
            rare = max(range(len(own)), key=lambda i: telling(own[i]))  # noqa: B023
            index.phrases[own[rare]].append((label, own, rare))
            index.triggers[own[rare]] = True
        return index

    def places(self, here: dict[int, int]) -> list[tuple[int, str]]:
        return sorted((p - i, label) for p, w in here.items() for label, words, i in self.phrases.get(w, ()) if all(here.get(p - i + j) == x for j, x in enumerate(words)))

    def aligned(self, line: np.ndarray, part: np.ndarray, begin: np.ndarray, slack: int) -> np.ndarray:
        """For parts that begin at places of the line the weight of their words that stand within slack words of their places."""
        words, out = self.part_words, np.zeros(len(part))
        place = np.arange(words.shape[1])[:, None] + np.arange(-slack, slack + 1)
        for i in range(0, len(part), 4096):
            own = part[i : i + 4096]
            at = begin[i : i + 4096, None, None] + place
            near = np.where((at >= 0) & (at < len(line)), line[np.clip(at, 0, len(line) - 1)], -1)
            out[i : i + 4096] = ((near == words[own][:, :, None]).any(axis=2) * self.part_weight[own]).sum(axis=1)
        return out

    def found_parts(self, at: np.ndarray, word: np.ndarray, line: np.ndarray, slack: int, share: float) -> dict[int, list[tuple[int, float]]]:
        """Beginnings and weights of the parts of which the share stands in the file, by votes for their beginnings.

        A vote's key is its part and the beginning it speaks for, parts so far from each other that no window of slack meets two.
        """
        n = self.posted[word + 1] - self.posted[word]
        flat = np.repeat(self.posted[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        votes = (self.posting_part[flat] << 40) + np.repeat(at, n) - self.posting_at[flat] + (1 << 39)
        keys, inverse = np.unique(votes, return_inverse=True)
        total = np.concatenate([[0.0], np.cumsum(np.bincount(inverse, weights=np.repeat(self.weight[word], n), minlength=len(keys)))])
        every = np.unique(keys[:, None] + np.arange(-slack, slack + 1))
        near = total[np.searchsorted(keys, every + slack, side="right")] - total[np.searchsorted(keys, every - slack)]
        full = share * self.part_weight.sum(axis=1) - 1e-9
        every = every[near >= full[every >> 40]]
        part, begin = every >> 40, (every & ((1 << 40) - 1)) - (1 << 39)
        got = self.aligned(line, part, begin, slack)
        out: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for p, b, x in zip(*(v[got >= full[part]].tolist() for v in (part, begin, got)), strict=True):
            out[p].append((b, x))
        return out

    def scan(self, at: np.ndarray, word: np.ndarray, slack: int, share: float) -> tuple[list[tuple[int, str]], list[tuple[int, str, float]]]:
        """Places of phrases and found templates of a file whose license words `word` stand at `at`."""
        here = dict(zip(at.tolist(), word.tolist(), strict=True))
        line = np.full(int(at[-1]) + 1 if len(at) else 1, -1, np.int32)
        line[at] = word
        return self.places(here), self.combined(here, self.found_parts(at, word, line, slack, share), slack, share)

    def combined(self, here: dict[int, int], parts: dict[int, list[tuple[int, float]]], slack: int, share: float) -> list[tuple[int, str, float]]:
        """Per label the template with the greatest share found: parts near where one of them would have the others."""
        best: dict[str, tuple[float, int]] = {}
        for t, own in enumerate(self.parts):
            full, drift = sum(self.weight[w] for w in self.words[t]), slack + len(self.words[t]) // 4
            begins = [sorted((b - self.part[p][1], x) for b, x in parts.get(p, ())) for p in own]
            bases = np.unique(np.array([b for found in begins for b, _ in found], np.int64))
            total = sum((_greatest_near(found, bases, drift) for found in begins), np.zeros(len(bases)))
            for base, got in zip(bases.tolist(), total.tolist(), strict=True):
                if got < share * full - 1e-9 or got / full <= best.get(self.labels[t], (0.0, 0))[0]:
                    continue
                places = range(base - drift, base + len(self.words[t]) + drift)
                if all(any(all(here.get(b + i) == w for i, w in enumerate(key)) for b in places) for key in self.keys[t]):
                    best[self.labels[t]] = (got / full, max(0, base))
        return sorted((b, label, min(1.0, s)) for label, (s, b) in best.items())


def _greatest_near(found: list[tuple[int, float]], bases: np.ndarray, drift: int) -> np.ndarray:
    """For each base the greatest value of the sorted (place, value) pairs within drift of it, 0 where there is none.

    Maxima over runs of 1, 2, 4, .. neighbours answer every window by two of them, however often a text repeats a license.
    """
    at, best = np.array([b for b, _ in found], np.int64), [np.array([x for _, x in found], np.float64)]
    while 2 ** len(best) <= len(at):
        half = 2 ** (len(best) - 1)
        best.append(np.maximum(best[-1][:-half], best[-1][half:]))
    lo, hi = np.searchsorted(at, bases - drift), np.searchsorted(at, bases + drift, side="right")
    out = np.zeros(len(bases))
    for level, runs in enumerate(best):
        own = np.flatnonzero((hi - lo >= 2**level) & (hi - lo < 2 ** (level + 1)))
        out[own] = np.maximum(runs[lo[own]], runs[hi[own] - 2**level])
    return out


def scans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list = TEMPLATES, phrases: dict[str, str] = PHRASES, slack: int = 3, share: float = 0.7) -> DataFrame:
    """Per row of docs its words, all places of phrases, and the templates found with the share of their weight that is there."""
    index = Index.build(templates, phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split(batch.column("text"), ALNUM)
            h = words.hashes()
            entry = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
            at = np.flatnonzero(index.vocabulary[entry] == h)
            word, row = entry[at], np.searchsorted(words.rows, at, side="right") - 1
            rows, n = np.searchsorted(row, np.arange(batch.num_rows + 1)), np.diff(words.rows)
            places, found = [[] for _ in n], [[] for _ in n]
            for r in np.unique(row[index.triggers[word]]).tolist():
                own = slice(rows[r], rows[r + 1])
                p, f = index.scan(at[own] - words.rows[r], word[own], slack, share)
                places[r] = [{"word": a, "label": x} for a, x in p]
                found[r] = [{"word": a, "label": x, "score": s} for a, x, s in f]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n), pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), pa.array(found, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("score", pa.float64())])))],
                ["doc_id", "n_words", "places", "found"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(scan), SCANNED)


def digest(scanned: DataFrame) -> DataFrame:
    labels = lambda *xs: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(x)["label"] for x in xs]))), ",")
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("found.score"), F.lit(0.0)))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        labels("places").alias("base_labels"), labels("places", "found").alias("labels"), score.alias("score"),
    )
