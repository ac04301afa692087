"""Licence scan with a positional index of rare words.

A template is a list of mandatory key phrases that follow each other. A first pass counts in how many files each licence
word occurs, over all files. The index posts, for each template, the ANCHORS words of its phrases with the highest idf
(of one word of those it takes the first place in the phrase that holds it), with their place in the phrase. The second
pass looks up a file's licence words that the index holds - its rarest ones, by construction - and turns every posting
into a start of the phrase (place in the file less place in the phrase); a start that all anchors of a phrase agree on
is a candidate. There each mandatory phrase is verified word by word: the anchored phrase at the start, the others before
and after it with at most `slack` words between two of them. As an anchor is a mandatory word at a fixed place,
the index loses no match of the phrases.

Words are case-folded runs of letters and digits, so line breaks and punctuation don't matter. Both passes are narrow; the driver sees one
count for each licence word.

Defined results. One row for each file, template and place: repeated rows of a file give repeated rows. Null, empty and
wordless texts give none. Ties of idf go to the earlier word. A file may match several templates. A null doc_id stays
null. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T

ANCHORS = 3
SLACK = 60

#: name -> mandatory key phrases, in order; from the licences' own public texts and notices
TEMPLATES: dict[str, list[str]] = {
    "MIT-notice": ["released under the MIT License"],
    "Apache-2.0-notice": ["licensed under the Apache License, Version 2.0"],
    "GPL-3.0-notice": ["licensed under the GNU General Public License, version 3"],
    "GPL-2.0-notice": ["licensed under the GNU General Public License, version 2"],
    "CC-BY-NC-4.0-notice": ["licensed under CC BY-NC 4.0"],
    "CC-BY-4.0-notice": ["licensed under CC BY 4.0"],
    "CC-BY-SA-4.0-notice": ["licensed under CC BY-SA 4.0"],
    "MIT-licensed": ["licensed under the MIT License"],
    "BSD-3-Clause-notice": ["licensed under the BSD 3-Clause License"],
    "BSD-2-Clause-notice": ["licensed under the BSD 2-Clause License"],
    "ISC-notice": ["licensed under the ISC License"],
    "MPL-2.0-notice": ["licensed under the Mozilla Public License, v. 2.0"],
    "CC-BY-3.0-notice": ["licensed under CC BY 3.0"],
    "CC-BY-ND-4.0-notice": ["licensed under CC BY-ND 4.0"],
    "SPDX-MIT": ["SPDX-License-Identifier: MIT"],
    "SPDX-Apache-2.0": ["SPDX-License-Identifier: Apache-2.0"],
    "SPDX-GPL-2.0": ["SPDX-License-Identifier: GPL-2.0"],
    "SPDX-GPL-3.0": ["SPDX-License-Identifier: GPL-3.0"],
    "SPDX-BSD": ["SPDX-License-Identifier: BSD"],
    "SPDX-MPL-2.0": ["SPDX-License-Identifier: MPL-2.0"],
    "MIT": ["permission is hereby granted, free of charge, to any person obtaining a copy", "the above copyright notice and this permission notice shall be included", "the software is provided \"as is\", without warranty of any kind"],
    "ISC": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "the author disclaims all warranties"],
    "BSD-2-Clause": ["redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice"],
    "Apache-2.0": ["you may not use this file except in compliance with the license", "distributed on an \"as is\" basis, without warranties or conditions of any kind"],
    "GPL": ["this program is free software", "you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "LGPL": ["under the terms of the GNU Lesser General Public License"],
    "AGPL": ["under the terms of the GNU Affero General Public License"],
    "MPL-2.0": ["this source code form is subject to the terms of the Mozilla Public License"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "CC0-1.0": ["to the extent possible under law", "has waived all copyright and related or neighboring rights"],
}
SCHEMA = "doc_id long, licence string, start_word long, n_words long"


class Templates:
    """Hashed phrases and the words in them."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = list(texts)
        self.phrases = [[h for h in map(T.hash_words, p) if len(h)] for p in texts.values()]
        flat = [h for p in self.phrases for h in p]
        self.words = np.unique(np.concatenate(flat)) if flat else np.zeros(0, np.uint64)

    def index(self, df: np.ndarray) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], np.ndarray]:
        """(template, phrase, anchor words, their places) of each template, and the words that any of them posts."""
        posts = []
        for t, phrases in enumerate(self.phrases):
            if not phrases:
                continue
            # the phrase that has the rarest word carries the anchors, so that all of them are at fixed places
            rank = [np.sort(df[np.searchsorted(self.words, p)]) for p in phrases]
            which = min(range(len(phrases)), key=lambda k: (*rank[k][:ANCHORS], k))
            p = phrases[which]
            _, place = np.unique(p, return_index=True)
            place = place[np.lexsort((place, df[np.searchsorted(self.words, p[place])]))][:ANCHORS]
            posts.append((t, which, p[place], place))
        words = np.unique(np.concatenate([x[2] for x in posts])) if posts else np.zeros(0, np.uint64)
        return posts, words


def frequencies(docs: DataFrame, templates: Templates) -> np.ndarray:
    """The number of files that hold each licence word, over all files."""
    words = templates.words

    def run(batches):
        n = np.zeros(len(words), np.int64)
        for rows, data, offs in T.chunks(batches):
            _, _, row, h = T.words(data, offs)
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            hit = words[at] == h
            n += np.bincount(np.unique(row[hit] * len(words) + at[hit]) % len(words), minlength=len(words))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], names=["word", "n"])

    out = np.zeros(len(words), np.int64)
    if len(words):
        text = F.col("text").cast("string").alias("text")
        for r in docs.select(text).filter("text <> ''").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            out[r["word"]] = r["n"]
    return out


def _places(h: np.ndarray, lo: int, hi: int, p: np.ndarray) -> list[int]:
    """Where the phrase p begins, from lo to hi."""
    at = lo + np.flatnonzero(h[lo : max(lo, hi + 1)] == p[0])
    return [x for x in at.tolist() if (h[x : x + len(p)] == p).all()]


def _follow(h: np.ndarray, last: int, at: int, phrases: list[np.ndarray], slack: int) -> int | None:
    """The earliest end of a chain of the phrases from `at`, with at most `slack` words before each; None if there is no chain."""
    ends = {at}
    for p in phrases:
        ends = {x + len(p) for e in ends for x in _places(h, e, min(e + slack, last - len(p)), p)}
    return min(ends, default=None)


def _before(h: np.ndarray, first: int, at: int, phrases: list[np.ndarray], slack: int) -> int | None:
    """The latest begin of a chain of the phrases up to `at`."""
    begins = {at}
    for p in reversed(phrases):
        begins = {x for e in begins for x in _places(h, max(first, e - len(p) - slack), e - len(p), p)}
    return max(begins, default=None)


def scan(docs: DataFrame, texts: dict[str, list[str]] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """(doc_id, licence, start_word, n_words) of every place of a licence; words count from 0."""
    templates = Templates(texts)
    posts, words = templates.index(frequencies(docs, templates))

    def run(batches):
        for rows, data, offs in T.chunks(batches):
            _, _, row, h = T.words(data, offs)
            if not len(h) or not len(words):
                continue
            near = np.minimum(np.searchsorted(words, h), len(words) - 1)
            hits = np.flatnonzero(words[near] == h)
            hw = h[hits]
            bounds = np.searchsorted(row, np.arange(rows.num_rows + 1))
            out = []
            for t, which, anchors, places in posts:
                start = hits[hw == anchors[0]] - places[0]
                for w, q in zip(anchors[1:], places[1:], strict=True):
                    start = start[np.isin(start, hits[hw == w] - q, assume_unique=True)]
                phrases = templates.phrases[t]
                p = phrases[which]
                start = start[(start >= 0) & (start + len(p) <= len(h))]
                start = start[row[start] == row[start + len(p) - 1]]
                for s in start.tolist():
                    if not (h[s : s + len(p)] == p).all():
                        continue
                    first, last = bounds[row[s]], bounds[row[s] + 1]
                    begin = _before(h, first, s, phrases[:which], slack)
                    end = None if begin is None else _follow(h, last, s + len(p), phrases[which + 1 :], slack)
                    if end is not None:
                        out.append((row[s], t, begin - first, end - begin))
            if out:
                r, t, b, n = map(np.array, zip(*sorted(out), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(r)), pa.array(np.array(templates.names)[t]), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "licence", "start_word", "n_words"]
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter("text <> ''").mapInArrow(run, SCHEMA)
