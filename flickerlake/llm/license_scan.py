"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are runs of letters and digits, lower-cased; shingles are ``SHINGLE`` words. For a template of n
shingles, windows of about 1.25 n to 1.5 n shingles begin at every multiple of a step of at most n / 4, so
any n consecutive shingles lie inside one. A window that holds a share ``containment`` of the
template's shingles has a Jaccard similarity of at least containment / (1.5 + 1 - containment) with
it, 0.47 for 0.8; BANDS bands of one row each then collide with a chance of 0.99996 or more, for whole
templates of 1 - 1e-7. (More rows would only spare candidates, which are rare here.) Each candidate is verified by the exact share of the template's distinct
shingles inside the window; verified windows that overlap are one run, reported as one match at its first
best window, unless it holds several: then every exact span that doesn't overlap a better one is reported
(best share first, then the shortest, then the earliest). The SQL still has one match a run, so it differs
for notices that follow each other within a window's length. Minima are taken once over steps and combined upwards, so windows that overlap share the work.

Templates are a small fixed table, the only thing sent to all tasks. A text is scanned whole, in
chunks of bounded size that overlap by the longest window.

Defined results: a null or empty text has no match; a null doc_id is carried along; repeated rows are
reported once each; ties between windows go to the earliest; an empty table gives no rows; other
columns are ignored. A template shorter than one shingle is refused.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 16
CHUNK = 1 << 16
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W_]+")

#: Short public licence notices and the openings of well-known licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

SCHEMA = "doc_id long, template string, start_word long, n_words long, containment double, match_start long, match_end long"


class _Words(dict):
    """Word as written -> hash of its lower case; emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.lower())
        return value


_words = _Words()


def shingle_hashes(text: str) -> np.ndarray:
    """Hash of each run of SHINGLE words."""
    own = [np.fromiter(map(_words.__getitem__, WORD.findall(part)), np.uint64) for part in pieces(text)]
    own = own[0] if len(own) == 1 else np.concatenate([*own, np.zeros(0, np.uint64)])
    if len(own) < SHINGLE:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(own) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(h)]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """MinHash bands of the templates, by geometry (step, steps in a window) of their windows."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS, containment: float = CONTAINMENT):
        self.bands, self.containment = bands, containment
        rng = np.random.default_rng(11)
        self.multipliers = rng.integers(1, 1 << 32, bands, dtype=np.uint32) | np.uint32(1)
        self.offsets = rng.integers(0, 1 << 32, bands, dtype=np.uint32)
        self.names, self.shingles = [*templates], []
        self.geometry: dict[tuple[int, int], list[dict[int, list[int]]]] = {}
        self.windows: list[int] = []
        for t, text in enumerate(templates.values()):
            hashes = shingle_hashes(text)
            n = len(hashes)
            if not n:
                raise ValueError(f"template {self.names[t]!r} has fewer than {SHINGLE} words")
            self.shingles.append(np.unique(hashes))
            step = 1 << max(0, (n // 4).bit_length() - 1)
            width = -(-n // step) + (step > 1)
            self.windows.append(step * width)
            tables = self.geometry.setdefault((step, width), [defaultdict(list) for _ in range(bands)])
            for table, low in zip(tables, self._minhashes(hashes).min(axis=1).tolist()):
                table[low].append(t)
        self.longest = max(self.windows)
        self.largest_step = max(step for step, _ in self.geometry)
        #: by geometry and band: which low 16 bits any template's minimum has
        self.maybe = {key: np.zeros((bands, 1 << 16), bool) for key in self.geometry}
        for key, tables in self.geometry.items():
            for band, table in enumerate(tables):
                self.maybe[key][band, [low & 0xFFFF for low in table]] = True

    def _minhashes(self, h: np.ndarray) -> np.ndarray:
        """(bands, shingles)."""
        x = ((h >> np.uint64(32)).astype(np.uint32) + self.offsets[:, None]) * self.multipliers[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        return x

    def candidates(self, h: np.ndarray, filler: np.ndarray) -> set[tuple[int, int]]:
        """(window start, template) of windows that collide in a band; windows begin at multiples of their step."""
        found: set[tuple[int, int]] = set()
        minima = self._minhashes(h)
        minima[:, filler] = 0xFFFFFFFF
        blocks, step = {1: minima}, 1
        while step < self.largest_step:
            b, step = blocks[step], step * 2
            if b.shape[1] % 2:
                b = np.concatenate([b, np.full((len(b), 1), 0xFFFFFFFF, np.uint32)], axis=1)
            blocks[step] = np.minimum(b[:, ::2], b[:, 1::2])
        for (step, width), tables in self.geometry.items():
            b = blocks[step]
            low = b[:, : b.shape[1] - width + 1].copy()
            for k in range(1, width):
                np.minimum(low, b[:, k : k + low.shape[1]], out=low)
            for band, maybe in enumerate(self.maybe[step, width]):
                for at in np.flatnonzero(maybe[low[band].astype(np.uint16)]).tolist():
                    found.update((at * step, t) for t in tables[band].get(int(low[band, at]), ()))
        return found

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int, float, int, int]]]:
        """For each whole text its matches: template, first word, words, containment, first and end character.

        Texts lie one after the other, each from a multiple of the largest step and with a longest
        window of filler behind it, so that no window holds shingles of two texts.
        """
        out: list[list] = [[] for _ in texts]
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for k, text in enumerate(texts):
            h = shingle_hashes(text)
            if len(h):
                group.append((k, h))
                size += len(h)
            if size >= CHUNK or k == len(texts) - 1:
                self._scan_group(group, texts, out)
                group, size = [], 0
        return out

    @staticmethod
    def _places(text: str, first: int, last: int) -> tuple[int, int]:
        """Characters where word ``first`` begins and word ``last - 1`` ends."""
        found = islice(WORD.finditer(text), first, last)
        begin = next(found)
        return begin.start(), deque(found, maxlen=1).pop().end() if last > first + 1 else begin.end()

    def _occurrences(self, hits: np.ndarray, hashes: np.ndarray, t: int) -> list[tuple[int, int, float]]:
        """(first shingle, last shingle, share) of spans that don't overlap, ascending, if there can be several."""
        total, window = len(self.shingles[t]), self.windows[t]
        if len(hits) < 2 * self.containment * total:
            return []
        at, own = hits.tolist(), hashes.tolist()
        taken: list[tuple[int, int, float]] = []
        gaps = [(0, len(at))]
        while gaps:
            spans = []
            for lo, hi in gaps:
                for i in range(lo, hi):
                    seen, last = set(), i
                    for j in range(i, hi):
                        if at[j] >= at[i] + window:
                            break
                        if own[j] not in seen:
                            seen.add(own[j])
                            last = j
                    if len(seen) / total >= self.containment:
                        spans.append((-len(seen), at[last] - at[i], i, last))
            used = np.zeros(len(at), bool)
            new = []
            for count, _, i, last in sorted(spans):
                if not used[i : last + 1].any():
                    used[i : last + 1] = True
                    new.append((i, last))
                    taken.append((at[i], at[last], -count / total))
            new.sort()
            # what lies between them may hold spans that a better one cut short
            rest = []
            for lo, hi in gaps:
                inside = new[bisect_left(new, (lo,)) : bisect_left(new, (hi,))]
                edges = [lo, *(e for i, last in inside for e in (i, last + 1)), hi]
                rest += [(a, b) for a, b in zip(edges[::2], edges[1::2]) if inside and b - a >= self.containment * total]
            gaps = rest
        return sorted(taken)

    def _scan_group(self, group: list[tuple[int, np.ndarray]], texts: list[str], out: list[list]) -> None:
        begins, at = [], 0
        for _, h in group:
            begins.append(at)
            at += -(-(len(h) + self.longest) // self.largest_step) * self.largest_step
        line, filler = np.zeros(at, np.uint64), np.ones(at, bool)
        for begin, (_, h) in zip(begins, group):
            line[begin : begin + len(h)] = h
            filler[begin : begin + len(h)] = False
        stride = CHUNK - CHUNK % self.largest_step
        verified: dict[tuple[int, int], dict[int, float]] = defaultdict(dict)
        for begin in range(0, at, stride):
            end = begin + stride + self.longest
            for place, t in self.candidates(line[begin:end], filler[begin:end]):
                d = bisect_right(begins, begin + place) - 1
                start = begin + place - begins[d]
                share = float(np.isin(self.shingles[t], group[d][1][start : start + self.windows[t]]).mean())
                if share >= self.containment:
                    verified[d, t][start] = share
        for (d, t), starts in sorted(verified.items()):
            k, h = group[d]
            run: list[int] = []
            for start in [*sorted(starts), None]:
                if run and (start is None or start >= run[-1] + self.windows[t]):
                    hits = run[0] + np.flatnonzero(np.isin(h[run[0] : run[-1] + self.windows[t]], self.shingles[t]))
                    several = self._occurrences(hits, h[hits], t)
                    if len(several) < 2:
                        best = max(run, key=lambda s: (starts[s], -s))
                        hit = hits[(hits >= best) & (hits < best + self.windows[t])]
                        several = [(int(hit[0]), int(hit[-1]), starts[best])]
                    for first, last, share in several:
                        last += SHINGLE
                        out[k].append((self.names[t], first, last - first, share, *self._places(texts[k], first, last)))
                    run = []
                if start is not None:
                    run.append(start)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each match in docs(doc_id, text): template, place in words and characters, containment."""
    templates = templates or TEMPLATES

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, containment=containment)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = [(doc_id, *m) for doc_id, found in zip(batch.column("doc_id").to_pylist(), index.scan(texts)) for m in found]
            columns = [*zip(*rows)] or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "template", "start_word", "n_words", "containment", "match_start", "match_end"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(task, SCHEMA)


def oracle_sql(templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> str:
    """The scan without retrieval: exact containment of every template in every window, without characters' places."""
    index = Index(templates or TEMPLATES, containment=containment)
    rows = []
    for t, (name, text) in enumerate((templates or TEMPLATES).items()):
        words = [w.lower() for w in WORD.findall(text)]
        step = next(s for (s, _), tables in index.geometry.items() if any(t in ts for ts in tables[0].values()))
        for shingle in sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}):
            rows.append(f"('{name}', {step}, {index.windows[t]}, {len(index.shingles[t])}, '{shingle}')")
    return f"""
WITH template(template, step, win, n, shingle) AS (VALUES {", ".join(rows)}),
docs AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)) AS words FROM documents),
shingles AS (
    SELECT r, doc_id, i, array_to_string(list_slice(words, i + 1, i + {SHINGLE}), ' ') AS shingle
    FROM (SELECT r, doc_id, words, unnest(range(0, len(words) - {SHINGLE - 1})) AS i FROM docs WHERE len(words) >= {SHINGLE})
),
hit AS (SELECT * FROM shingles JOIN template USING (shingle)),
windowed AS (
    SELECT r, doc_id, template, win, w, count(DISTINCT shingle) / n::DOUBLE AS containment, min(i) AS first_i, max(i) AS last_i
    FROM (SELECT *, unnest(range(greatest(0, (i - win + step) // step * step), i + 1, step)) AS w FROM hit)
    WHERE w <= i AND w > i - win GROUP BY r, doc_id, template, win, n, w HAVING count(DISTINCT shingle) / n::DOUBLE >= {containment}
),
marked AS (SELECT *, coalesce(w >= lag(w) OVER (PARTITION BY r, template ORDER BY w) + win, true)::INT AS fresh FROM windowed),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY w) AS run FROM marked),
best AS (SELECT *, row_number() OVER (PARTITION BY r, template, run ORDER BY containment DESC, w) AS k FROM runs)
SELECT doc_id, template, first_i AS start_word, last_i - first_i + {SHINGLE} AS n_words, containment FROM best WHERE k = 1
"""
