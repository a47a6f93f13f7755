"""License scans: hashed runs of template tokens pick candidates, banded alignment measures them.

Templates become tokens (runs of letters and digits in lower case) and hashes of all their runs of ``GRAM`` tokens, or
of fewer for the shortest: of the tokens that ``coverage`` asks for, cut apart by as many edits as it allows (one at
least), some run has that length, so every such passage shares a hash. The hashes form an inverted index (hash to
template and place), which is sent to the tasks in blocks of about ``INDEX_ROWS`` entries; a larger index takes several
passes.

Documents look up all their hashes. The hits of one template on one diagonal form a candidate, and a local alignment in
a band around it (other token -1, gap -1, equal token one more than the edits that ``coverage`` allows) gives the matched share of the template and the span in the document,
in code points. Of overlapping candidates of one template the best stays.

Defined results: null or empty texts have no matches; a license that stands in a document several times is reported each time; repeated rows are scanned one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import WordHashes, window_hashes

TOKEN = re.compile(r"[^\W_]+")
GRAM = 3
WINDOW = 4
BAND = 8
COVERAGE = 0.8
INDEX_ROWS = 1_000_000

# Public license notices.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at"
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met"
    ),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction'
    ),
}

MATCHES = (
    "doc_id long, template string, coverage double, matched_tokens int, template_tokens int, start_char int, end_char int"
)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window (the last one if equal); all places of fewer hashes' one window."""
    if len(hashes) <= window:
        return np.array([int(hashes.argmin())] if len(hashes) else [], np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    last = len(hashes) - 1 - (views.argmin(1) + np.arange(len(views)))
    return np.unique(last)


def allowed_edits(size: int, coverage: float) -> int:
    """Tokens of a template that a match may lack."""
    return size - max(1, math.ceil(coverage * size - 1e-9))


def gram_of(size: int, coverage: float) -> int:
    """Length of a run that some part of every match has, at most ``GRAM``."""
    edits = allowed_edits(size, coverage)
    return min(GRAM, -(-(size - edits) // (max(edits, 1) + 1)))


def fingerprints(ids: np.ndarray, coverage: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of a template and their places."""
    hashes = window_hashes(ids, gram_of(len(ids), coverage)) if len(ids) else np.empty(0, np.uint64)
    return hashes, np.arange(len(hashes))


def _index(coverage: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for name, text in zip(batch.column("template").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = hashes.of([t.encode() for t in TOKEN.findall((text or "").lower())])
                found, places = fingerprints(ids, coverage)
                size = len(found)
                yield pa.record_batch(
                    [
                        pa.array([name] * size, pa.string()),
                        pa.array(found.view(np.int64)),
                        pa.array(places, pa.int32()),
                        pa.array([gram_of(len(ids), coverage) if size else 0] * size, pa.int32()),
                        pa.array([ids.view(np.int64).tolist()] * size, pa.list_(pa.int64())),
                    ],
                    ["template", "hash", "place", "gram", "tokens"],
                )

    return run


def align(template: list[int], tokens: list[int], diagonal: int, band: int, gain: int = 1) -> tuple[int, int, int]:
    """Best local alignment near a diagonal, an equal token worth ``gain``: (equal tokens, first and one past the last token of the document)."""
    width = 2 * band + 1
    empty = (0, 0, -1, -1)  # score, equal tokens, first and last place
    above: list[tuple[int, int, int, int]] = [empty] * (width + 1)
    best = empty
    for i, token in enumerate(template):
        row = []
        left = empty
        for b in range(width):
            j = i + diagonal + b - band
            cell = empty
            if 0 <= j < len(tokens):
                same = tokens[j] == token
                score, equal, first, _ = above[b]
                if same:
                    cell = (score + gain, equal + 1, first if score > 0 else j, j)
                elif score > 1:
                    cell = (score - 1, equal, first, above[b][3])
                for other in (above[b + 1], left):
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, *other[1:])
                if cell[0] > best[0]:
                    best = cell
            row.append(cell)
            left = cell
        above = [*row, empty]
    return best[1], best[2], best[3] + 1


def _scan(index: list[dict], coverage: float) -> callable:
    grams = sorted({r["gram"] for r in index})
    names = sorted({r["template"] for r in index})
    numbers = {n: i for i, n in enumerate(names)}
    known = {numbers[r["template"]]: r["tokens"] for r in index}
    by_gram = {}
    for gram in grams:
        rows = sorted((r for r in index if r["gram"] == gram), key=lambda r: r["hash"])
        by_gram[gram] = (
            np.array([r["hash"] for r in rows], np.int64),
            np.array([numbers[r["template"]] for r in rows], np.int64),
            np.array([r["place"] for r in rows], np.int64),
        )

    def document(text: str, hashes: WordHashes) -> list[tuple]:
        words = TOKEN.findall(text.lower())
        ids = hashes.of([w.encode() for w in words]).view(np.int64)
        hits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for gram, (index_hashes, index_templates, index_places) in by_gram.items():
            own = window_hashes(ids.view(np.uint64), gram).view(np.int64)
            low = np.searchsorted(index_hashes, own, "left")
            found = np.flatnonzero((low < len(index_hashes)) & (index_hashes[np.minimum(low, len(index_hashes) - 1)] == own))
            for at in found.tolist():
                entry = int(low[at])
                while entry < len(index_hashes) and index_hashes[entry] == own[at]:
                    hits.setdefault(int(index_templates[entry]), []).append((at, int(index_places[entry])))
                    entry += 1
        if not hits:
            return []
        # Lower-casing may change the length of a text, so offsets come from the text as it is.
        spans = [m.span() for m in TOKEN.finditer(text)]
        out = []
        for template, pairs in hits.items():
            tokens = known[template]
            results = []
            # Narrower than a template, so that no band reaches the next place of the same one.
            band = min(BAND, max(len(tokens) // 2, 1))
            gain = allowed_edits(len(tokens), coverage) + 1
            for diagonal in sorted({at - place for at, place in pairs}):
                low = max(0, diagonal - band)
                part = ids[low : diagonal + len(tokens) + band + 1].tolist()
                near = set(part)
                if sum(t in near for t in tokens) < coverage * len(tokens):
                    continue
                equal, first, last = align(tokens, part, diagonal - low, band, max(gain, 2))
                if equal >= coverage * len(tokens):
                    results.append((equal, first + low, last + low))
            taken: list[tuple[int, int]] = []
            for equal, first, last in sorted(results, key=lambda r: (-r[0], r[1])):
                if all(last <= a or first >= b for a, b in taken) and last <= len(spans):
                    taken.append((first, last))
                    out.append((names[template], equal / len(tokens), equal, len(tokens), spans[first][0], spans[last - 1][1]))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 4)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                rows.extend((doc_id, *match) for match in document(text.as_py() or "", hashes))
            cells = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], [f.split()[0] for f in MATCHES.split(", ")]
            )

    return scan


def template_table(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """The templates as a frame (template, text)."""
    return docs.sparkSession.createDataFrame(list((templates or TEMPLATES).items()), "template string, text string")


def license_matches(docs: DataFrame, templates: DataFrame | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where templates stand in documents, with at least ``coverage`` of their tokens.

    Columns: doc_id, template, coverage, matched_tokens, template_tokens, start_char and end_char (code points).
    """
    templates = template_table(docs) if templates is None else templates
    rows = templates.select(F.col("template").cast("string"), F.col("text").cast("string")).dropDuplicates(["template"])
    index = rows.mapInArrow(_index(coverage), "template string, hash long, place int, gram int, tokens array<long>")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, block, used = None, [], set()

    def passed(frame: DataFrame | None, part: list[dict]) -> DataFrame:
        found = plain.mapInArrow(_scan(part, coverage), MATCHES)
        return found if frame is None else frame.union(found)

    for row in index.orderBy("template", "place").toLocalIterator():
        if len(block) >= INDEX_ROWS and row["template"] not in used:
            out, block, used = passed(out, block), [], set()
        block.append(row.asDict())
        used.add(row["template"])
    return passed(out, block) if block or out is None else out
