"""License notices by conditional compression.

In texts that name a license, copyright, permission or the like, every template
is looked for around these candidate words, across line breaks: from each word that can be the first of
a notice, the template is compared with the words that follow, as far as a notice
of its length can reach. What has enough of the template's words in order is
confirmed, with the exact differences in wording: words of the template that the
notice lacks and words within the notice that the template lacks. Each confirmed
notice is cut out and compressed alone and with the template as raw zstandard
dictionary; the bytes saved rank templates that claim the same words.

Defined cases: null and empty texts have no notices; of templates that save the
same, the one with fewer differences wins, then the first in ``TEMPLATES``; no
word counts for two notices; a notice is in the line of its first word; of a
template that names none of these, enough words are candidates too that no notice
can lack them all; repeated rows each give their rows; other columns are
ignored. Documents without any candidate word never leave the JVM.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Usual wordings of notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."),
)
CANDIDATE = r"(?i)licen[cs]e|copyright|\bpermission|redistribut|all\W+rights\W+reserved|public\W+domain|\bwaived\b|spdx|\bcc\W+(by|0)"
#: Least share of a template's words that a notice must have, in order.
COVERED = 0.8
#: A notice reaches over twice its template's words and so many more.
MARGIN = 16
WORD = re.compile(r"\w+(?:[.-]\w+)*")
#: A line break with the marks of a comment that goes on.
BREAK = re.compile(r"\s*\n[\s#*/;%!>|-]*")


def _words(text: str) -> list[str]:
    return [m.group().lower() for m in WORD.finditer(text)]


def _least(n_words: int) -> int:
    return next(n for n in range(n_words + 1) if n >= COVERED * n_words)


def candidates(templates=TEMPLATES) -> str:
    """Pattern of the words by which notices of these templates are found."""
    more = set()
    for _, text in templates:
        if not re.search(CANDIDATE, text):
            words = _words(text)
            more |= set(sorted(words, key=lambda w: (-len(w), w))[: len(words) - _least(len(words)) + 1])
    return "|".join([CANDIDATE.replace("(?i)", "(?iu)") if more else CANDIDATE, *(re.escape(w) for w in sorted(more))])


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.templates = templates
        self.words = [_words(t) for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.least = [_least(len(w)) for w in self.words]
        # One of these is the first word of any notice that lacks no more than it may.
        self.first = [set(w[: len(w) - n + 1]) for w, n in zip(self.words, self.least, strict=True)]
        self.reach = [2 * len(w) + MARGIN for w in self.words]
        params = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=17)
        self.alone = zstandard.ZstdCompressor(compression_params=params)
        self.given = [zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        self.candidate = re.compile(candidates(templates))

    def enough(self, template: int, block: list[str | None]) -> bool:
        """Whether the block has as many of the template's words as a notice must, in any order."""
        need, have = self.least[template], Counter(block)
        return sum(min(n, have[w]) for w, n in self.counts[template].items()) >= need

    def difference(self, template: int, block: list[str | None]) -> tuple[list[int], list[str], list[str | None]] | None:
        """(places in the block of the words in common in order, template words that are missing,
        words put between), or None. Words at the ends that stand further off than they count are left out."""
        mine = self.words[template]
        runs = [r for r in SequenceMatcher(None, mine, block, autojunk=False).get_matching_blocks() if r.size]
        if not runs or sum(r.size for r in runs) < self.least[template]:
            return None
        best = (0, 0, 0)
        for i in range(len(runs)):
            score = size = 0
            for j in range(i, len(runs)):
                score += runs[j].size - (runs[j].b - runs[j - 1].b - runs[j - 1].size if j > i else 0)
                size += runs[j].size
                if size >= self.least[template] and (best[2] == 0 or score > best[0]):
                    best = score, i, j + 1
        runs = runs[best[1] : best[2]]
        kept = {i for r in runs for i in range(r.a, r.a + r.size)}
        places = [i for r in runs for i in range(r.b, r.b + r.size)]
        found = set(places)
        return places, [w for i, w in enumerate(mine) if i not in kept], [block[i] for i in range(places[0], places[-1] + 1) if i not in found]

    def starts(self, template: int, words: list[str], marks: list[int]) -> Iterator[int]:
        """Places of words that can be the first of a notice with a candidate word in reach."""
        reach, first, k, done = self.reach[template], self.first[template], 0, 0
        while k < len(marks):
            low, k = marks[k], bisect_left(marks, marks[k] + reach)
            begin, end = max(low - reach + 1, done), marks[k - 1] + 1
            done = max(done, end)
            if self.enough(template, words[begin : end + reach]):
                for s in range(begin, end):
                    if words[s] in first and marks[bisect_left(marks, s)] < s + reach and self.enough(template, words[s : s + reach]):
                        yield s

    def notices(self, text: str) -> list[tuple]:
        """(offset, license, bytes saved, share saved, missing, added) of every confirmed notice, by offset."""
        spans = [m.span() for m in WORD.finditer(text)]
        words: list[str | None] = [text[a:b].lower() for a, b in spans]
        begins = [a for a, _ in spans]
        marks = sorted({min(bisect_left(begins, m.start() + 1) - 1, len(words) - 1) for m in self.candidate.finditer(text)} - {-1})

        def confirmed(i: int, s: int) -> tuple | None:
            block = words[s : s + self.reach[i]]
            if (found := self.difference(i, block)) is None:
                return None
            places, missing, added = [s + p for p in found[0]], found[1], [w for w in found[2] if w is not None]
            raw = BREAK.sub(" ", text[spans[places[0]][0] : spans[places[-1]][1]]).encode()
            plain = len(self.alone.compress(raw))
            saved = plain - len(self.given[i].compress(raw))
            return -saved, len(missing) + len(added), i, s, places, saved / plain, missing, added

        heap = [c for i, mine in enumerate(self.words) if mine for s in self.starts(i, words, marks) if (c := confirmed(i, s))]
        heapq.heapify(heap)
        rows = []
        while heap:
            saved, _, i, s, places, share, missing, added = heapq.heappop(heap)
            if any(words[p] is None for p in places):
                # Another notice has some of these words: compared again without them.
                if again := confirmed(i, s):
                    heapq.heappush(heap, again)
                continue
            for p in places:
                words[p] = None
            rows.append((begins[places[0]], self.templates[i][0], -saved, share, missing, added))
        return sorted(rows, key=lambda r: r[0])

    def block(self, text: str) -> tuple[str, int, float, list[str], list[str]] | None:
        """(license, bytes saved, share saved, missing, added) of the notice that saves most."""
        return max((r[1:] for r in self.notices(text)), key=lambda r: r[1], default=None)

    def scan(self, text: str) -> Iterator[tuple]:
        if self.candidate.search(text):
            number = at = 0
            for offset, *found in self.notices(text):
                number, at = number + text.count("\n", at, offset), offset
                yield number, *found


_scanners: dict[tuple, Scanner] = {}


def _run(batches: Iterator[pa.RecordBatch], templates: tuple) -> Iterator[pa.RecordBatch]:
    if templates not in _scanners:
        _scanners[templates] = Scanner(templates)
    for batch in batches:
        rows = [(d, *r) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in _scanners[templates].scan(t)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "line", "license", "saved", "share", "missing", "added"])


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per confirmed notice of (doc_id, text): doc_id, line (from 0) of its first word, license,
    saved bytes, share of the notice's compressed size that was saved, missing and added words.
    ``templates``: pairs of license and wording."""
    templates = tuple((name, text) for name, text in templates)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(candidates(templates)))
    return docs.mapInArrow(lambda batches: _run(batches, templates), "doc_id long, line int, license string, saved int, share double, missing array<string>, added array<string>")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "line", "license", "saved", "share", F.size("missing").alias("n_missing"), F.size("added").alias("n_added"))
