"""Licence notices in texts, by conditional compression.

The text around words that name a licence or its usual terms forms candidate blocks, whatever lines it stands on. In
them every notice that few words turn into a part of the block is confirmed by its wording: word by word, with few
words changed, and none that carries a number or tells variants of a licence apart. Each place is compressed alone and
with its licence's template as a zstandard raw-content dictionary; the reduction is that of the notice's own place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch

# Licence notices as they are commonly worded.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GPL-2.0": (
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU GPL v2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-3.0": (
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-2.1": (
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
#: White space and comment marks may stand between the words of a trigger.
TRIGGER = re.compile(r"licen[sc]|permission[\W_]+(?:is[\W_]+hereby|to[\W_]+use)|spdx-|creative[\W_]+commons|redistribution[\W_]+and[\W_]+use|mozilla[\W_]+public|gnu[\W_]+g|cc[\W_]+by|unencumbered", re.IGNORECASE)
_FIRST = ("licens", "licenc", "permission", "spdx-", "creative", "redistribution", "mozilla", "gnu", "cc", "unencumbered")
# Words that tell licences or their variants apart.
TELLING = frozenset("apache bsd mit gnu gpl lgpl agpl affero isc epl eclipse unlicense mpl lesser mozilla cc by attribution noncommercial sharealike nc sa nd".split())
MOST_CHANGED = 0.2  # share of a notice's words
LEVEL = 3

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
REACH = 2 * max(len(n) for v in TEMPLATES.values() for n in v)  # code points around a trigger; twice a notice leaves room for comment marks


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _compressors() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]:
    own = {k: zstandard.ZstdCompressionDict("\n".join(v).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in TEMPLATES.items()}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False), {k: zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False) for k, d in own.items()}


def reductions(block: str) -> list[tuple[float, str]]:
    """(share by which the template shrinks the block's compressed size, licence), largest first."""
    plain, given = _compressors()
    data = block.encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    return sorted(((1 - len(c.compress(data)) / alone, k) for k, c in given.items()), key=lambda x: (-x[0], x[1]))


def wording(block: list[str], notice: list[str]) -> list[str] | None:
    """Changes that turn the notice into its place in the block, as ``-word`` and ``+word``; None if it is not there."""
    match = SequenceMatcher(None, notice, block, autojunk=False)
    spans = [m for m in match.get_matching_blocks() if m.size]
    if not spans:
        return None
    out: list[str] = []
    for op, a, b, c, d in match.get_opcodes():
        if op == "equal":
            continue
        out += [f"-{w}" for w in notice[a:b]]
        # What stands before or after the notice is not part of it.
        if spans[0].b < d and c < spans[-1].b + spans[-1].size and not (a == b and (a == 0 or a == len(notice))):
            out += [f"+{w}" for w in block[c:d]]
    telling = any(w[1:] in TELLING or any(ch.isdigit() for ch in w) for w in out)
    return None if telling or len(out) > MOST_CHANGED * len(notice) else out


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of the text around triggers, as far as the longest notice reaches; what overlaps is one block."""
    low = text.lower()
    if not any(t in low for t in _FIRST):
        return []
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        out[-1:] = [(out[-1][0], b)] if out and a <= out[-1][1] else [*out[-1:], (a, b)]
    return out


@lru_cache(maxsize=1)
def _notices() -> list[tuple[str, list[str], Counter, int]]:
    """(licence, words, their counts, most words changed) of every notice."""
    return [(k, words(n), Counter(words(n)), int(MOST_CHANGED * len(words(n)))) for k, v in TEMPLATES.items() for n in v]


def places(block: np.ndarray, notice: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of the block that the notice turns into by at most ``most`` words left out or put in, the closest of those that overlap."""
    m, along = len(block), np.arange(len(block) + 1)
    cost, begin = np.zeros(m + 1, np.int64), along.copy()
    for i, word in enumerate(notice, 1):
        new, come = cost + 1, begin.copy()
        hit = np.flatnonzero(block == word) + 1
        same = hit[cost[hit - 1] < new[hit]]
        new[same], come[same] = cost[same - 1], begin[same - 1]
        # words put in: the best to the left, the farthest of equals, a change for each word since
        rest = (new - along) * (m + 1) + along
        best = np.minimum.accumulate(rest) % (m + 1)
        cost, begin = new[best] - best + along, come[best]
    out: list[tuple[int, int, int]] = []
    for e in np.flatnonzero(cost <= most).tolist():
        s, c = int(begin[e]), int(cost[e])
        if out and s < out[-1][1]:
            if c < out[-1][2]:
                out[-1] = (s, e, c)
        else:
            out.append((s, e, c))
    return [(s, e) for s, e, _ in out if e > s]


def scan(text: str | None) -> list[dict]:
    """Confirmed notices of a text, in order: start and end of their lines, their own start and end, license, reduction and differences (words changed, in order)."""
    text, found = text or "", []
    for start, end in blocks(text):
        spans = [(m[0].lower(), start + m.start(), start + m.end()) for m in _WORD.finditer(text[start:end])]
        block = [w for w, _, _ in spans]
        number: dict[str, int] = {}
        coded = np.array([number.setdefault(w, len(number)) for w in block], np.int64)
        have = Counter(block)
        here: list[tuple[int, int, str, list[str]]] = []
        for name, notice, count, most in _notices():
            # Words that the block lacks are changes wherever the notice stands.
            if (count - have).total() > most:
                continue
            for s, e in places(coded, np.array([number.get(w, -1) for w in notice]), most):
                changes = wording(block[s:e], notice)
                if changes is not None:
                    here.append((s, e, name, changes))
        # Of one licence's notices that overlap the least changed tells, then the longest.
        kept: list[tuple[int, int, str, list[str]]] = []
        for s, e, name, changes in sorted(here, key=lambda x: (len(x[3]), x[0] - x[1], x[0])):
            if not any(name == k and s < y and x < e for x, y, k, _ in kept):
                kept.append((s, e, name, changes))
        for s, e, name, changes in sorted(kept, key=lambda x: (x[0], x[2])):
            a, b = spans[s][1], spans[e - 1][2]
            size = next(r for r, k in reductions(text[a:b]) if k == name)
            stop = text.find("\n", b)
            found.append({"start": text.rfind("\n", 0, a) + 1, "end": len(text) if stop < 0 else stop, "notice_start": a, "notice_end": b, "license": name, "reduction": round(size, 4), "n_changed": len(changes), "changes": " ".join(changes)})
    return found


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, notice_start, notice_end, license, reduction, n_changed and changes: a row for each confirmed notice of ``docs`` (doc_id, text).

    Null and empty texts hold none. Rows are scanned one by one, so repeated rows give repeated results; other columns
    are ignored.
    """
    scratch.prepare(docs)
    names = ["start", "end", "notice_start", "notice_end", "license", "reduction", "n_changed", "changes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, t in enumerate(batch.column(1)):
                for r in scan(t.as_py()):
                    owner.append(i)
                    rows.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scratch.tidy(run), "doc_id long, start long, end long, notice_start long, notice_end long, license string, reduction double, n_changed long, changes string")
