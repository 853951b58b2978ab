"""License notices in whole texts: MinHash bands over overlapping windows, then exact containment.

A text's words give hashed five-word shingles. For a template of s shingles the text is cut into blocks of
s/4 shingles, and windows of enough consecutive blocks that any run of s shingles lies inside one. Each window has
`bands` MinHash values, one a band; a window whose value equals the template's in any band is a candidate.
The number of bands follows from the least Jaccard similarity that a match with the asked containment can
have with its window, J = c s / (window + (1 - c) s): the chance to miss it, (1 - J) ** bands, is at most `miss`.
Candidates are verified: the share of the template's distinct shingles found in the window must reach
`containment`.

Edge cases: null and empty texts and texts under five words match nothing; repeated rows give repeated rows;
templates under five words are refused, as they have no shingle; a tie between windows goes to the first;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquifer.llm.common import WordHashes, as_bytes, map_batches, mix64, ngram_hashes

SHINGLE = 5
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.\-][a-z0-9\x80-\xff]+)*")

#: Notices to look for: fixed values, from the licenses' own public texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"),
    "Apache-2.0-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "All-rights-reserved-notice": (
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
}

FAR = np.uint64(2**64 - 1)


def tokens(text: bytes) -> list[bytes]:
    return TOKEN.findall(text.lower())


class Template:
    """A template's shingles, window shape and MinHash values."""

    def __init__(self, name: str, text: str, containment: float, miss: float):
        words = WordHashes().of(tokens(text.encode()))
        self.name = name
        self.shingles = np.unique(ngram_hashes(words, SHINGLE))
        run = len(words) - SHINGLE + 1
        if run < 1:
            raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
        self.block = max(1, run // 4)
        self.blocks = -(-(run - 1) // self.block) + 1
        s = len(self.shingles)
        self.needed = math.ceil(containment * s - 1e-9)
        least = self.needed / (self.block * self.blocks + s - self.needed)
        self.bands = 1 if least >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - least)))
        self.minima = [permuted(self.shingles, k).min() for k in range(self.bands)]


def permuted(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k-th random order of shingles."""
    return mix64(shingles ^ np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64))


def candidates(shingles: np.ndarray, templates: list[Template]) -> Iterator[tuple[Template, np.ndarray]]:
    """Each template with the first shingles of the windows that share a band with it."""
    orders = max((t.bands for t in templates), default=0)
    shapes = sorted({(t.block, t.blocks) for t in templates})
    hits: dict[str, list[np.ndarray]] = {t.name: [] for t in templates}
    for k in range(orders):
        values = np.where(shingles == FAR, FAR, permuted(shingles, k))
        for block, blocks in shapes:
            own = [t for t in templates if (t.block, t.blocks) == (block, blocks) and k < t.bands]
            if not own:
                continue
            short = -len(values) % block
            lows = np.append(values, np.full(short, FAR, np.uint64)).reshape(-1, block).min(axis=1)
            window = lows.copy()
            for j in range(1, blocks):
                window[:-j] = np.minimum(window[:-j], lows[j:]) if j < len(lows) else window[:-j]
            for t in own:
                hits[t.name].append(np.flatnonzero(window == t.minima[k]) * block)
    for t in templates:
        yield t, np.unique(np.concatenate(hits[t.name]))


def matches(texts: list[bytes], templates: list[Template], hashes: WordHashes) -> list[tuple[int, str, int, int, float]]:
    """(text, template, first word of the best window, matching windows, containment) of all matches."""
    words = [hashes.of(tokens(t)) for t in texts]
    runs = [ngram_hashes(w, SHINGLE) for w in words]
    sizes = np.array([len(r) for r in runs], np.int64)
    ends = np.cumsum(sizes)
    shingles = np.concatenate(runs) if runs else np.empty(0, np.uint64)
    best: dict[tuple[int, str], list] = {}
    if not len(shingles):
        return []
    for t, starts in candidates(shingles, templates):
        for start in starts.tolist():
            stop = min(start + t.block * t.blocks, len(shingles))
            text = int(np.searchsorted(ends, start, side="right"))
            while text < len(texts) and ends[text] - sizes[text] < stop:  # a window may reach into the next text
                low, high = max(start, int(ends[text] - sizes[text])), min(stop, int(ends[text]))
                found = int(np.isin(t.shingles, shingles[low:high]).sum())
                if found >= t.needed:
                    share = found / len(t.shingles)
                    place = low - int(ends[text] - sizes[text])
                    got = best.setdefault((text, t.name), [place, 0, 0.0])
                    got[1] += 1
                    if share > got[2]:
                        got[0], got[2] = place, share
                text += 1
    return [(text, name, *got) for (text, name), got in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = 0.75, miss: float = 1e-3,
         text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = 2_000_000) -> DataFrame:
    """A row per document row and template found: doc_id, license, first_word, windows, containment."""
    made = [Template(name, t, containment, miss) for name, t in sorted(templates.items())]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            texts, at = as_bytes(b, "text"), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= chunk_bytes):
                    held += len(texts[end])
                    end += 1
                got = matches(texts[at:end], made, hashes)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array([at + g[0] for g in got], pa.int64())),
                     pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64()),
                     pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.float64())],
                    names=["doc_id", "license", "first_word", "windows", "containment"])
                at = end

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, license string, first_word long, windows long, containment double")
