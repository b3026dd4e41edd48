"""License scan by a positional index of rare words.

Templates are base phrases, notices and license texts.  Their words are counted in all documents (one pass),
which gives each an IDF weight.  A template is entered in the index under its rarest words only: so many that without any of
them too little weight is left to reach the threshold.  Of a document, the occurrences of these words
are looked up; word position less template offset is an alignment, at which the postings of the template's other words are
intersected, and a template found at an alignment must hold its mandatory key phrases there, word by word.
A base phrase is a template of which every word must be in its place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.llm import words as W
from terrasol.llm.common import small_batches, table

#: share of a template's IDF weight that must stand in its place
SHARE = 0.8
#: one word in so many may be missing or added before a template's word
LOOSE = 10

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License texts and notices, each with its label and mandatory key phrases.
TEMPLATES = (
    ("mit", ("permission is hereby granted free of charge", "without restriction"), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", ("permission to use copy modify", "with or without fee is hereby granted"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-2-clause", ("redistribution and use in source and binary forms",), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", ("may be used to endorse or promote products",), "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("apache-2.0", ("you may not use this file except in compliance with the license",), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", ("apache license version 2 0",), "under the Apache License, Version 2.0"),
    ("gpl-2.0", ("either version 2 of the license",), "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", ("either version 3 of the license",), "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", ("general public license version 2",), "the GNU General Public License, version 2"),
    ("gpl-3.0", ("general public license version 3",), "the GNU General Public License, version 3"),
    ("lgpl", ("lesser general public license",), "the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", ("affero general public license",), "the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", ("mozilla public license",), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("zlib", ("this software is provided as is", "the origin of this software must not be misrepresented"), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("unlicense", ("released into the public domain",), "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0-1.0", ("cc0 1 0",), "under CC0 1.0 Universal"),
    ("cc-by-4.0", ("cc by 4 0",), "licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", ("cc by sa 4 0",), "licensed under CC BY-SA 4.0"),
    ("cc-by-nd-4.0", ("cc by nd 4 0",), "licensed under CC BY-ND 4.0"),
    ("cc-by-nc-4.0", ("cc by nc 4 0",), "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", ("cc by nc sa 4 0",), "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd-4.0", ("cc by nc nd 4 0",), "licensed under CC BY-NC-ND 4.0"),
)

PLACES = "array<struct<start:bigint,end:bigint,label:string,base:boolean,score:double>>"
PLACE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("score", pa.float64())])


def split(text: str) -> list[str]:
    """Words of a template, as documents are split."""
    low = W.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = W.spans(low, np.array([0, len(low)]), W.ALNUM)
    raw = low.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts, ends)]


@dataclass
class Entry:
    """A template in the index: words by number, what it must reach, and under which words it is entered."""

    label: str
    base: bool
    words: np.ndarray
    weight: np.ndarray
    least: float
    slack: int
    entered: np.ndarray  # offsets of its rarest words
    keys: list


class Index:
    """Templates by the hashes of their words."""

    def __init__(self, templates, phrases, share: float):
        self.raw = [(label, True, split(p), [], 1.0) for p, label in phrases.items()]
        self.raw += [(label, False, split(text), [split(k) for k in keys], share) for label, keys, text in templates]
        vocabulary = sorted({w for _, _, text, keys, _ in self.raw for w in text + [w for k in keys for w in k]})
        data = " ".join(vocabulary).encode()
        low = np.frombuffer(data, np.uint8)
        starts, ends, _ = W.spans(low, np.array([0, len(low)]), W.ALNUM)
        names = W.hashes(low, starts, ends) if len(low) else np.empty(0, np.uint64)
        by = np.argsort(names)
        self.names = names[by]
        self.number = {vocabulary[i]: n for n, i in enumerate(by)}

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for those in no template."""
        if not len(self.names):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[at] == hashes, at, -1)

    def weigh(self, n_docs: int, having: dict[int, int]) -> None:
        """IDF weights from the counts of documents, and the entries that follow from them."""
        self.idf = np.array([np.log(1 + n_docs / (1 + having.get(w, 0))) for w in range(len(self.names))])
        self.entries = []
        for label, base, text, keys, share in self.raw:
            number = np.array([self.number[w] for w in text], np.int64)
            weight = self.idf[number]
            rarest = sorted(set(number.tolist()), key=lambda w: (-self.idf[w], w))
            left, least, entered = weight.sum(), share * weight.sum() - 1e-9, []
            while left >= least and len(entered) < len(rarest):  # without the words entered so far, it could still be reached
                entered.append(rarest[len(entered)])
                left = weight[~np.isin(number, entered)].sum() - 2e-9
            offsets = np.flatnonzero(np.isin(number, entered))
            self.entries.append(Entry(label, base, number, weight, least, 0 if base else len(number) // LOOSE, offsets, [np.array([self.number[w] for w in k], np.int64) for k in keys]))
        looked_up = np.zeros(len(self.names) + 1, bool)
        for e in self.entries:
            looked_up[e.words[e.entered]] = True
        self.looked_up = looked_up


def _near(at: np.ndarray, want: np.ndarray, slack: int) -> np.ndarray:
    """Whether a position within `slack` of each wanted one is in the sorted `at`."""
    return np.searchsorted(at, want + slack, "right") > np.searchsorted(at, want - slack)


def places(numbers: np.ndarray, index: Index) -> list[dict]:
    """Templates found in a document given by its words' numbers (-1: in no template)."""
    known = np.flatnonzero(numbers >= 0)
    by = known[np.argsort(numbers[known], kind="stable")]
    bounds = np.searchsorted(numbers[by], np.arange(len(index.names) + 1))
    at = lambda w: by[bounds[w] : bounds[w + 1]]
    out = []
    for e in index.entries:
        start = np.unique(np.concatenate([at(e.words[o]) - o for o in e.entered])) if len(e.entered) else by[:0]
        if not len(start):
            continue
        score = np.zeros(len(start))
        for o, w in enumerate(e.words):
            score += e.weight[o] * _near(at(w), start + o, e.slack)
        good = score >= e.least
        start, score = start[good], score[good]
        for key in e.keys:
            if len(start):
                rare = int(np.argmax(index.idf[key]))
                held = at(key[rare]) - rare
                for o, w in enumerate(key):
                    held = held[_near(at(w), held + o, 0)]
                inside = np.searchsorted(held, start + len(e.words) + e.slack - len(key), "right") > np.searchsorted(held, start - e.slack)
                start, score = start[inside], score[inside]
        if not len(start):
            continue
        # alignments within the slack of each other are one place: the best of them, ties to the first
        for a in np.split(np.arange(len(start)), np.flatnonzero(np.diff(start) > e.slack) + 1):
            best = a[np.argmax(score[a])]
            begin = max(0, int(start[best]))
            out.append({"start": begin, "end": min(len(numbers), int(start[best]) + len(e.words)), "label": e.label, "base": e.base, "score": min(1.0, float(score[best] / e.weight.sum()))})
    return sorted(out, key=lambda r: (r["start"], r["end"], r["label"], not r["base"], r["score"]))


def _documents(batches, index: Index):
    """(batch, numbers of all words, counts) of the texts in the second column, in slices."""
    for batch in batches:
        raw, offsets = W.utf8(batch.column(1))
        for i, j in W.slices(offsets):
            low = W.LOWER[raw[offsets[i] : offsets[j]]]
            starts, ends, counts = W.spans(low, offsets[i : j + 1] - offsets[i], W.ALNUM)
            yield batch.slice(i, j - i), index.of(W.hashes(low, starts, ends)), counts


def _counter(index: Index):
    """(word, documents that hold it) of a task; word -1 counts the documents."""

    def run(batches):
        total = np.zeros(len(index.names), np.int64)
        n = 0
        for batch, numbers, counts in _documents(batches, index):
            known = numbers >= 0
            pairs = np.unique(np.repeat(np.arange(len(counts)), counts)[known] * len(index.names) + numbers[known])
            total += np.bincount(pairs % max(1, len(index.names)), minlength=len(index.names))
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"w": pa.array(np.arange(-1, len(total), dtype=np.int64)), "n": pa.array(np.concatenate([[n], total]))})

    return run


def _scanner(index: Index):
    def run(batches):
        for batch, numbers, counts in _documents(batches, index):
            ends = np.cumsum(counts)
            # only documents with a word under which a template is entered are looked into
            some = np.flatnonzero(index.looked_up[numbers])
            found: list[list] = [[]] * len(counts)
            for d in np.unique(np.searchsorted(ends, some, "right")):
                found[d] = places(numbers[ends[d] - counts[d] : ends[d]], index)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(PLACE))], ["_id", "n_words", "places"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, share: float = SHARE) -> DataFrame:
    """One row per input row: id, n_words and `places` (first word, end, label, whether a base phrase, share of the template's
    weight in place), sorted.

    Null or empty texts have no words and no places; null ids and repeated rows stay rows of their own; an empty
    table gives an empty result; other columns are not looked at; alignments of equal score count as the first. A text
    is handled whole in one task, however long, in time linear in its words. The index is as
    large as the templates.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    index = Index(templates, phrases, share)
    counted = texts.mapInArrow(_counter(index), "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    having = {r.w: r.n for r in counted}
    index.weigh(having.pop(-1, 0), having)
    return texts.mapInArrow(_scanner(index), f"_id {texts.schema['_id'].dataType.simpleString()}, n_words bigint, places {PLACES}").withColumnRenamed("_id", id_col)


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), score.alias("score"))
