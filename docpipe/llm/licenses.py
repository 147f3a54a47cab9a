"""License notices and full license texts in documents: MinHash bands over overlapping windows retrieve
templates, exact shingle containment verifies them.

Words are runs of letters, digits and signs above ASCII, lower-cased; shingles
are five words. Templates are grouped by their number of shingles. For each
group, windows a quarter longer than its largest template start at every fifth
of their length, so each run of words as long as a template lies in a window.
With 32 bands of one MinHash each, a window of similarity s to a template is
missed with probability (1 - s) ** 32; the groups keep s at 0.2 or more for a
template that is there in full, a miss of less than one in a thousand. Each
group is four times as large as the one before, so this holds at any length.

Templates overlap: a version's notice holds the one without version, and one
license repeats another. Where found templates share most of their words in a
text, the one with most shingles found less those missing is reported.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.shared import once, share, slices
from docpipe.llm.shingles import all_shingles, mix, word_hashes

BANDS = 32
CONTAINED = 0.75
#: Groups of templates: most shingles, shingles of a window, of a step.
GROUPS = ((1, 1, 1), (8, 10, 2), (40, 50, 10), (160, 200, 40), (640, 800, 160), (2560, 3200, 640), (10240, 12800, 2560))

#: Usual notices of public licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_GNU = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License
as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."""
#: Notices with versions, and their kin that the ones above would be taken for.
NOTICES = (
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    *((f"{short}-{version}", _GNU.format(what=what, name=name, version=version.removesuffix(".0")))
      for short, name, version in (("GPL", "General", "2.0"), ("GPL", "General", "3.0"), ("LGPL", "Lesser General", "2.1"),
                                   ("LGPL", "Lesser General", "3.0"), ("AGPL", "Affero General", "3.0"))
      for what in ("program", "library")),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
                "which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                "which is available at https://www.eclipse.org/legal/epl-2.0"),
)


def known_licenses() -> tuple[tuple[str, str], ...]:
    """Name and text of all notices, and of the full texts beside this file."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return TEMPLATES + NOTICES + tuple((f.stem, f.read_text("utf-8")) for f in files)


_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ODD = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def license_shingles(text: str | None) -> np.ndarray:
    """Shingles in order; fewer than five words make none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_KEEP))
    return all_shingles(words) if len(words) >= 5 else np.empty(0, np.uint64)


@dataclass
class Template:
    name: str
    shingles: np.ndarray


class LicenseFinder:
    def __init__(self, templates=TEMPLATES) -> None:
        self.groups = []
        self.known = [Template(name, np.unique(license_shingles(text))) for name, text in templates]
        low = 0
        for most, window, step in GROUPS:
            own = [k for k, t in enumerate(self.known) if low < len(t.shingles) <= most]
            low = most
            tables = []
            for odd in _ODD[: BANDS if window > 1 else 1]:
                by_min: dict[int, list[int]] = {}
                for k in own:
                    by_min.setdefault(int(((self.known[k].shingles * odd) >> np.uint64(32)).min()), []).append(k)
                quick = np.zeros(1 << 16, bool)
                quick[[m & 0xFFFF for m in by_min]] = True
                tables.append((by_min, quick))
            if own:
                self.groups.append((window, step, tables))
        if any(len(t.shingles) > GROUPS[-1][0] or not len(t.shingles) for t in self.known):
            raise ValueError("a template has too few or too many words")

    def candidates(self, shingles: np.ndarray):
        """(template, first shingle, window) of windows that share a band."""
        seen: set[tuple[int, int, int]] = set()
        if not len(shingles):
            return
        for band, odd in enumerate(_ODD):
            low, done = ((shingles * odd) >> np.uint64(32)).astype(np.uint32), 1
            for window, step, tables in self.groups:
                if band >= len(tables):
                    continue
                # Steps are multiples of each other: minima of steps from those of smaller ones.
                low, done = np.minimum.reduceat(low, np.arange(0, len(low), step // done)), step
                best, parts = low.copy(), window // step
                for k in range(1, min(parts, len(low))):
                    np.minimum(best[: len(low) - k], low[k:], out=best[: len(low) - k])
                by_min, quick = tables[band]
                for at in np.flatnonzero(quick[best & np.uint32(0xFFFF)]).tolist():
                    for t in by_min.get(int(best[at]), ()):
                        if (t, at, step) not in seen:
                            seen.add((t, at, step))
                            yield t, at * step, window

    def find(self, texts: list[str | None]) -> list[dict[str, float]]:
        """For each text: licenses with their greatest containment."""
        each = [license_shingles(t) for t in texts]
        ends = np.cumsum([len(s) for s in each])
        every = np.concatenate(each) if each else np.empty(0, np.uint64)
        hits: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in texts]
        for t, start, window in self.candidates(every):
            shingles = self.known[t].shingles
            stop = min(start + window, len(every))
            at = start
            while at < stop:  # a window may reach over the end of a text
                doc = int(np.searchsorted(ends, at, side="right"))
                end = min(stop, int(ends[doc]))
                if end - at >= CONTAINED * len(shingles):
                    here = every[at:end]
                    place = np.minimum(np.searchsorted(shingles, here), len(shingles) - 1)
                    inside = shingles[place] == here
                    both = len(np.unique(place[inside]))
                    if both / len(shingles) >= CONTAINED:
                        hits[doc].append((t, both, at + np.flatnonzero(inside)))
                at = end
        return [self._best(h) for h in hits]

    def _best(self, hits: list[tuple[int, int, np.ndarray]]) -> dict[str, float]:
        """Of hits that lie on the same shingles of a text, the best one."""
        out: dict[str, float] = {}
        taken: dict[str, list[np.ndarray]] = {}
        for t, both, places in sorted(hits, key=lambda h: (len(self.known[h[0]].shingles) - 2 * h[1], h[0])):
            name, size = self.known[t].name, len(self.known[t].shingles)
            others = [p for other, held in taken.items() if other != name for p in held]
            if others and 2 * np.isin(places, np.concatenate(others)).sum() > len(places):
                continue
            taken.setdefault(name, []).append(places)
            out[name] = max(both / size, out.get(name, 0.0))
        return out


def scan_licenses(docs: DataFrame, templates=None) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> doc_id, licenses
    (array of name and greatest containment, by name). Null, empty and short
    texts have none; repeated rows stay; whole texts are read. The templates
    (name, text; ``known_licenses`` if not given) go along. No shuffle."""
    held = share(docs.sparkSession, LicenseFinder(known_licenses() if templates is None else templates))

    def work(batches):
        kind = pa.list_(pa.struct([("name", pa.string()), ("contained", pa.float64())]))
        for batch in slices(batches):
            found = once(held).find(batch.column("text").to_pylist())
            rows = [[{"name": n, "contained": f[n]} for n in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "licenses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, licenses array<struct<name: string, contained: double>>")
