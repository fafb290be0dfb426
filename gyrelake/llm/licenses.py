"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Texts and templates become words (lower case A-Z, ASCII marks at a word's ends removed), then word
shingles of ``WORDS`` (a template with fewer words is one shingle of its own length). Templates are
sorted into classes by size: class s (a power of 2) has templates of s / 2 < m <= s shingles. For a
class a text is read in windows of 2 * s shingles every s shingles, so that every stretch of s
shingles lies wholly inside one window. A window that holds ``CONTAINED`` of a template has a
Jaccard similarity of at least 0.19 with it; with ``BANDS`` bands of one MinHash row each it is
missed with a probability below (1 - 0.19) ** BANDS = 2e-4, and a whole template (at least 0.25)
below 1e-5. Retrieved windows of a text that meet are read as one stretch, in which exact shingle
containment finds every place of the template on its own (``stretches``).

Templates are broadcast in blocks of at most ``BLOCK_WORDS`` words. Null or blank templates match
nothing; a null text counts as empty; null ids stay; repeated rows are scanned one by one; other
columns are ignored; texts are whole and empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import pkgutil
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrelake.llm.common import WordHashes, hash_word, mix, scan_blocks, words_of

WORDS, CONTAINED = 5, 0.8
BANDS = 40
BLOCK_WORDS = 2_000_000
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TOKEN = re.compile(r"[^ \t-\r]+")
_ODD = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


class Stripped(WordHashes):
    """token -> hash of the word without marks, 0 where nothing is left."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        word = token.strip(_MARKS)
        value = self[token] = (hash_word(word) or 1) if word else 0
        return value


_stripped = Stripped()

# Short notices of common public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def production_templates() -> list[tuple[str, str]]:
    """Whole texts of common licences, their usual notices in several wordings, and SPDX lines: the package's data and ``TEMPLATES``."""
    return [*TEMPLATES, *map(tuple, json.loads(pkgutil.get_data(__package__, "license_texts.json")))]


def words_of_template(text: str) -> list[bytes]:
    return [w for t in words_of(text) if (w := t.strip(_MARKS))]


def ordered(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles in the order of the text."""
    if len(hashes) < n:
        return hashes[:0]
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i])
    return out


class Templates:
    """Templates by shingle length and size class, with their bands."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.names: list = []
        self.sets: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, int]] = []  # times of each shingle, and all of them
        self.classes: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, text in rows:
            hashes = _stripped.array(words_of_template(text or ""))
            if not len(hashes):
                continue
            n = min(WORDS, len(hashes))
            found, times = np.unique(ordered(hashes, n), return_counts=True)
            k = len(self.names)
            self.names.append(name)
            self.sets.append(found)
            self.parts.append((times, int(times.sum())))
            self.classes[n][1 << (len(found) - 1).bit_length()].append(k)
        self.classes = {n: dict(c) for n, c in self.classes.items()}
        self.bands: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for n, classes in self.classes.items():
            for size, members in classes.items():
                mins = np.stack([(self.sets[k][:, None] * _ODD).min(0) for k in members])  # template, band
                for b in range(BANDS):
                    order = np.argsort(mins[:, b], kind="stable")
                    self.bands[n, size, b] = (mins[order, b], np.array(members)[order])

    def _levels(self, lengths: np.ndarray, n: int) -> list[tuple]:
        """Of each power of 2 its blocks: size, the two blocks below, the next block, text and number in it.

        A text takes part as long as it can hold some template of the size or above it.
        """
        least, top = {}, max(self.classes[n])
        for size, members in sorted(self.classes[n].items(), reverse=True):
            least[size] = min([math.ceil(CONTAINED * len(self.sets[k]) - 1e-9) for k in members] + list(least.values()))
        texts, counts, begin, size, out = np.arange(len(lengths)), lengths, np.append(0, np.cumsum(lengths))[:-1], 1, []
        while size < top:
            size *= 2
            kept = lengths[texts] >= min(x for at, x in least.items() if at >= size)
            texts, below, old = texts[kept], counts[kept], begin[kept]
            counts = (below + 1) // 2
            begin = np.append(0, np.cumsum(counts))[:-1]
            own = np.repeat(np.arange(len(texts)), counts)
            if not len(own):
                break
            number = np.arange(len(own)) - begin[own]
            left = old[own] + 2 * number
            right = np.minimum(left + 1, old[own] + below[own] - 1)
            out.append((size, left, right, np.arange(len(own)) + (number + 1 < counts[own]), texts[own], number))
        return out

    def _retrieve(self, grams: np.ndarray, lengths: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        """(text, template, first position of the window) of the pairs that share a band; one shingle is looked up as it is."""
        classes = self.classes[n]
        found: set[tuple[int, int, int]] = set()

        def look(keys: np.ndarray, members: np.ndarray, windows: np.ndarray, texts: np.ndarray, number: np.ndarray, size: int) -> None:
            table = np.zeros(1 << 16, bool)
            table[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            for w in np.flatnonzero(table[(windows & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                s = int(np.searchsorted(keys, windows[w]))
                while s < len(keys) and keys[s] == windows[w]:
                    found.add((int(texts[w]), int(members[s]), int(number[w]) * size))
                    s += 1

        if 1 in classes:
            texts = np.repeat(np.arange(len(lengths)), lengths)
            number = np.arange(len(grams)) - (np.cumsum(lengths) - lengths)[texts]
            keys, members = np.array([self.sets[k][0] for k in classes[1]]), np.array(classes[1])
            order = np.argsort(keys, kind="stable")
            look(keys[order], members[order], grams, texts, number, 1)
        levels = self._levels(lengths, n)
        for b in range(BANDS if levels else 0):
            blocks = grams * _ODD[b]
            for size, left, right, following, texts, number in levels:
                blocks = np.minimum(blocks[left], blocks[right])
                if size in classes:
                    look(*self.bands[n, size, b], np.minimum(blocks, blocks[following]), texts, number, size)
        return iter(sorted(found))

    def matches_of(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """(name, start, end, containment) of every place that holds a template, for each text."""
        hashes, ats = [], []
        for text in texts:
            h = _stripped.array(text.encode("utf-8", "surrogatepass").lower().split())
            at = np.flatnonzero(h)
            hashes.append(h[at])
            ats.append(at)
        best: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        for n in self.classes:
            parts = [ordered(h, n) for h in hashes]
            grams = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            reach: dict[tuple[int, int], list[list[int]]] = {}
            for d, k, a in self._retrieve(grams, np.array([len(g) for g in parts], np.int64), n):
                size = 1 << (len(self.sets[k]) - 1).bit_length()
                b = min(len(parts[d]), a + 2 * size)
                meets = reach.setdefault((d, k), [[a, b]])
                if a <= meets[-1][1]:
                    meets[-1][1] = max(b, meets[-1][1])
                else:
                    meets.append([a, b])
            for (d, k), meets in reach.items():
                for a, b in meets:
                    best[d] += [(k, share, a + x, a + y + n) for share, x, y in self.stretches(k, parts[d][a:b])]
        return [self._places(t, at, b) if b else [] for t, at, b in zip(texts, ats, best, strict=True)]

    def stretches(self, k: int, grams: np.ndarray) -> list[tuple[float, int, int]]:
        """(containment, first, last shingle) of the places of a template, which share no shingle.

        A stretch ends where enough shingles of the template were met; it begins as late as it can.
        Of the stretches that end within the template's length after that one, the densest is the place, so that a
        copy is neither cut nor begun in the rest of another; a shingle more often than in the template
        begins anew.
        """
        own, (times, total) = self.sets[k], self.parts[k]
        index = np.searchsorted(own, grams)
        index[index == len(own)] = 0
        where = np.flatnonzero(own[index] == grams)
        at, which = where.tolist(), index[where].tolist()
        need, far = math.ceil(CONTAINED * len(own) - 1e-9), 2 << (len(own) - 1).bit_length()
        out, first = [], 0
        while first < len(at):
            seen: Counter = Counter()
            i, top, until = first, None, None
            for j in range(first, len(at)):
                if until is not None and at[j] > until:
                    break
                seen[which[j]] += 1
                while i < j:  # the first shingle goes where it is too far, once too often, or makes the stretch less dense
                    left = len(seen) - (seen[which[i]] == 1)
                    room, less = max(total, at[j] - at[i] + 1), max(total, at[j] - at[i + 1] + 1)
                    if at[j] - at[i] < far and seen[which[i]] <= times[which[i]] and not (left >= need and left * room > len(seen) * less):
                        break
                    seen[which[i]] -= 1
                    if not seen[which[i]]:
                        del seen[which[i]]
                    i += 1
                if len(seen) >= need:
                    until = at[j] + total if until is None else until
                    density = len(seen) / max(total, at[j] - at[i] + 1)
                    if top is None or density > top[0] or (density == top[0] and at[i] == top[2] and at[j] - at[i] < total):
                        top = (density, len(seen) / len(own), at[i], at[j], j)
            if top is None:
                break
            out.append(top[1:4])
            first = top[4] + 1
        return out

    def _places(self, text: str, at: np.ndarray, best: list) -> list[tuple[str, int, int, float]]:
        spans = [m.span() for m in _TOKEN.finditer(text)]
        found = sorted(((self.names[k], spans[at[a]][0], spans[at[b - 1]][1], share) for k, share, a, b in best), key=lambda m: (m[1], -m[2], -m[3], str(m[0])))
        lost, around = set(), []
        for i, m in enumerate(found):
            around = [(j, o) for j, o in around if o[2] > m[1]]
            for j, o in around:
                both = min(o[2], m[2]) - m[1]
                if o[3] != m[3]:  # most of the place is held better by another one, as of another version of a licence
                    k, less = (i, m) if m[3] < o[3] else (j, o)
                    if 2 * both > less[2] - less[1]:
                        lost.add(k)
                if o[0] == m[0] and m[0] is not None and o[2] >= m[2] and o[3] >= m[3]:  # another wording of the same licence
                    lost.add(i)
            around.append((i, m))
        out = [m for i, m in enumerate(found) if i not in lost]
        return sorted(out, key=lambda m: (m[1], str(m[0])))

    def matches(self, text: str) -> list[tuple[str, int, int, float]]:
        return self.matches_of([text])[0]


MATCH = "array<struct<license_id:string,start:bigint,end:bigint,containment:double>>"
_ARROW = pa.list_(pa.struct([("license_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


def template_blocks(templates: DataFrame) -> Iterator[list[tuple[str, str]]]:
    rows = templates.select(F.col("license_id").cast("string"), "text")
    total = rows.agg(F.sum(F.size(F.split("text", " "))).alias("n")).first()["n"] or 0
    n = int(total // BLOCK_WORDS) + 1
    for b in range(n):
        yield sorted((tuple(r) for r in rows.where(F.pmod(F.xxhash64("license_id", "text"), F.lit(n)) == b).collect()), key=str)


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id and matches, an array of (license_id, start, end, containment); offsets are code points."""

    def matches(block: Templates, texts: list[str]) -> list[list[dict]]:
        return [[{"license_id": n, "start": s, "end": e, "containment": c} for n, s, e, c in rows] for rows in block.matches_of(texts)]

    return scan_blocks(spark, docs, map(Templates, template_blocks(templates)), matches, MATCH, _ARROW)


def license_report(spark: SparkSession, docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (distinct, sorted, comma-joined) and spans as license:start:end."""
    ids = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license_id"]))), ",")
    told = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license_id"], m["start"], m["end"])), ",")
    return scan_licenses(spark, docs, templates).select("doc_id", F.size("matches").cast("long").alias("n_matches"), ids.alias("licenses"), told.alias("spans"))
