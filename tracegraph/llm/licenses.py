"""License notices found by MinHash bands over windows of the text and verified by their shingles."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tracegraph.llm.tables import quoted
from tracegraph.llm.words import bare_words, chained, mix

SHINGLE = 5
CONTAINMENT = 0.8
# Probability with which a window that holds a template collides with it in some band.
GUARANTEE = 0.999

# Notices as their publishers word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}


@dataclass
class SizeClass:
    """Templates of one length: their bands, and the windows that are compared with them."""

    words: int
    window: int  # words
    step: int
    seeds: np.ndarray  # bands x rows
    keys: np.ndarray  # bands x templates
    names: list
    grams: list


@dataclass
class Scanner:
    classes: list[SizeClass]
    minima: np.ndarray  # template shingles that are the smallest of some band's rows
    width: int


def band_settings(jaccard: float, guarantee: float = GUARANTEE, rows: int = 1) -> int:
    """How many bands of ``rows`` minima make sets of this similarity collide with the given probability."""
    if jaccard >= 1:
        return 1
    return math.ceil(math.log(1 - guarantee) / math.log(1 - jaccard**rows))


def band_keys(grams: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One key per band for each row of a two-dimensional array of shingles."""
    out = np.zeros((len(seeds), len(grams)), dtype=np.uint64)
    for b, band in enumerate(seeds):
        for seed in band:
            out[b] = mix(out[b] + mix(grams ^ seed).min(axis=1))
    return out


def build_scanner(templates: dict[str, str], containment: float = CONTAINMENT, guarantee: float = GUARANTEE, rows: int = 1, width: int = SHINGLE) -> Scanner:
    """Size classes with bands chosen for the least similarity a verified window can have.

    Windows are a quarter longer than the template and move on so that every run of its
    length lies in one. Templates without a word are left out; those of fewer than
    ``width`` words are one shingle of all of them.
    """
    words = {name: bare_words(text) for name, text in templates.items()}
    classes, minima = [], []
    for n in sorted({len(w) for w in words.values() if len(w)}):
        names = [k for k, w in words.items() if len(w) == n]
        size = min(width, n)
        grams = [np.unique(chained(words[k], size)) for k in names]
        window = math.ceil(1.25 * n)
        need = min(math.ceil(containment * len(g)) / (len(g) + window - size + 1 - math.ceil(containment * len(g))) for g in grams)
        bands = band_settings(need, guarantee, rows)
        seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(n)).reshape(bands, rows)
        keys = np.concatenate([band_keys(g[None], seeds) for g in grams], axis=1)
        minima += [g[mix(g ^ s).argmin()] for g in grams for s in seeds.ravel()]
        classes.append(SizeClass(n, window, window - n + 1, seeds, keys, names, grams))
    return Scanner(classes, np.unique(np.array(minima, dtype=np.uint64)), width)


def scan(scanner: Scanner, text: str | None, containment: float = CONTAINMENT) -> list[tuple[str, int, int, float]]:
    """(template, first word, last word, containment) of every occurrence in the whole text.

    A window collides in a band only through shingles that are a template's minima there,
    so texts without any of these are done at once. Overlapping windows that find the
    same template are one occurrence, the fullest.
    """
    words = bare_words(text)
    found: list[tuple[str, int, int, float]] = []
    shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in scanner.classes:
        size = min(scanner.width, c.words)
        if size not in shingles:
            own = chained(words, size) if len(words) >= size else np.zeros(0, np.uint64)
            near = np.minimum(np.searchsorted(scanner.minima, own), len(scanner.minima) - 1)
            shingles[size] = own, np.concatenate(([0], np.cumsum(scanner.minima[near] == own)))
        own, marks = shingles[size]
        if not marks[-1]:
            continue
        span = min(c.window - size + 1, len(own))
        starts = np.arange(0, max(1, len(own) - span + c.step), c.step)
        starts = np.minimum(starts, len(own) - span)
        # Only windows with such a shingle.
        starts = np.unique(starts[marks[starts + span] > marks[starts]])
        windows = np.lib.stride_tricks.sliding_window_view(own, span)
        for at in range(0, len(starts), 4096):
            block = starts[at : at + 4096]
            keys = band_keys(windows[block], c.seeds)
            for k, name in enumerate(c.names):
                for w in np.flatnonzero((keys == c.keys[:, k : k + 1]).any(axis=0)):
                    inside = np.isin(windows[block[w]], c.grams[k])
                    share = len(np.unique(windows[block[w]][inside])) / len(c.grams[k])
                    if share >= containment - 1e-9:
                        places = np.flatnonzero(inside) + block[w]
                        found.append((name, int(places[0]), int(places[-1]) + size - 1, share))
    kept: list[tuple[str, int, int, float]] = []
    for m in sorted(found, key=lambda m: (m[0], -m[3], m[1])):
        if not any(m[0] == o[0] and m[1] <= o[2] and o[1] <= m[2] for o in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[1], m[0]))


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, license, first_word, last_word, containment) of every notice in every whole text.

    Words are lower-cased and without ASCII punctuation, numbered from 0. Null, empty and
    clean texts give no row; rows that repeat are reported as often; other columns are
    ignored. The templates are a parameter of the job, not data, and go to every task.
    """
    scanner = build_scanner(TEMPLATES if templates is None else templates)
    source = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    schema = StructType([
        StructField("doc_id", source.schema["doc_id"].dataType), StructField("license", StringType()), StructField("first_word", LongType()),
        StructField("last_word", LongType()), StructField("containment", DoubleType()),
    ])

    def run(batches):
        for batch in batches:
            rows = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in scan(scanner, t)]
            index, names, first, last, share = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(index, pa.int64())), pa.array(names, pa.string()), pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()), pa.array(share, pa.float64()),
                ],
                schema.fieldNames(),
            )

    return source.mapInArrow(run, schema)
