"""Licence scans: parts of a text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ngrams, prefix_hash, range_hash, slices, words

THRESHOLD = 0.8

#: Customary notices of public licences (fixed values).
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
}

#: Notices of further licences, and longer forms of those above. Only windows are compared with them.
NOTICES = {
    "mit-licensed-line": "Licensed under the MIT License.",
    "bsd-line": "Licensed under the BSD License.",
    "mpl-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "gpl-3.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    "lgpl-3.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    "agpl-3.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
}


def longer() -> dict[str, str]:
    """NOTICES and the whole licence texts of the folder license_texts."""
    return NOTICES | {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


# letters (A-Z lowered), digits and bytes above 127 stand; the newline keeps lines apart; all else is white space
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[10] = 10


def bigrams(text: bytes) -> set[tuple[bytes, bytes]]:
    """Distinct word bigrams of the normalised text."""
    w = _PLAIN[np.frombuffer(text, np.uint8)].tobytes().split()
    return set(zip(w, w[1:]))


def _hashes(text: bytes) -> np.ndarray:
    """Hashes of all word bigrams of the normalised text, in order."""
    buf = _PLAIN[np.frombuffer(text, np.uint8)]
    s, e, d = words(buf, np.array([0, len(buf)]))
    return ngrams(range_hash(prefix_hash(buf), s, e), np.zeros_like(d), 2)[0]


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float, longer: dict[str, str] | None = None):
        self.threshold = threshold
        self.sets = sorted((len(b), k, b) for k, t in templates.items() if (b := bigrams(t.encode())))
        t = threshold
        # Dice >= t needs t / (2 - t) <= |A| / |B| <= (2 - t) / t
        self.least, self.most = t / (2 - t), (2 - t) / t
        self.low = min((self.least * n for n, _, _ in self.sets), default=0)
        self.high = max((self.most * n for n, _, _ in self.sets), default=-1)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_hashes(x.encode()) for x in templates.values())]))
        self.fast = np.zeros(1 << 16, bool)
        self.fast[(self.known >> np.uint64(48)).astype(np.int64)] = True

        # for windows: name, bigrams as strings, their hashes, number of bigrams with repeats; and who has a bigram
        every = {**templates, **(longer or {})}
        runs = {k: _hashes(x.encode()) for k, x in every.items()}
        self.wide = [(k, bigrams(every[k].encode()), np.unique(h), len(h)) for k, h in runs.items() if len(h)]
        owner = np.repeat(np.arange(len(self.wide)), [len(h) for _, _, h, _ in self.wide])
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _ in self.wide)])
        order = np.argsort(hashes, kind="stable")
        self.owner = owner[order]
        self.grams, self.first, self.owners = np.unique(hashes[order], return_index=True, return_counts=True)
        self.need = np.array([ceil(self.least * len(h) - 1e-9) for _, _, h, _ in self.wide], np.int64)
        self.fast_wide = np.zeros(1 << 20, bool)
        self.fast_wide[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def best(self, text: bytes) -> list[tuple[str, float, int]]:
        """The best template of at least the threshold, and any that ties with it: name, dice, shared bigrams."""
        own = bigrams(text)
        n, out, top = len(own), [], self.threshold
        for size, name, want in self.sets:
            if 2 * min(n, size) < top * (n + size):
                continue  # the bound by sizes alone
            shared = len(own & want)
            d = 2 * shared / (n + size)
            if d >= top:
                out = [x for x in out if x[1] == d] + [(name, d, shared)]
                top = d
        return out

    def scan(self, buf: np.ndarray, offs: np.ndarray):
        """(text number, template, dice) of each line, each whole text of several lines, and each window that matches."""
        plain = _PLAIN[buf]
        cut = np.flatnonzero(plain == 10)
        lines = np.union1d(offs, cut)  # a line's number is where it starts, counted over the slice
        s, e, doc = words(plain, offs)
        if not len(s) or not self.wide:
            return
        h = range_hash(prefix_hash(plain), s, e)
        line = np.searchsorted(lines, s, "right") - 1
        parts: dict[int, list[tuple[int, int, str, int]]] = {}
        for unit, bounds in ((line, lines), (doc, offs)):
            grams, at = ngrams(h, unit, 2)
            per = np.bincount(unit[at], minlength=len(bounds))
            likely = np.flatnonzero(self.fast[(grams >> np.uint64(48)).astype(np.int64)])
            likely = likely[np.isin(grams[likely], self.known)]
            # hits count repeats, so they bound the shared bigrams from above; the sizes bound the rest
            hits = np.bincount(unit[at[likely]], minlength=len(bounds))
            for u in np.flatnonzero((hits > 0) & (hits >= self.low - 1e-9)):
                a, b = int(bounds[u]), int(bounds[u + 1]) if u + 1 < len(bounds) else len(buf)
                number = int(np.searchsorted(offs, a, "right")) - 1 if unit is line else int(u)
                if unit is not line and not (a < b and (plain[a:b] == 10).any()):
                    continue
                if per[u] > self.high and len(bigrams(plain[a:b].tobytes())) > self.high:
                    continue
                for name, d, shared in self.best(plain[a:b].tobytes()):
                    parts.setdefault(number, []).append((*(int(x) for x in np.searchsorted(s, [a, b])), name, shared))
                    yield number, name, d
        # grams and at are now those of whole texts
        likely = np.flatnonzero(self.fast_wide[(grams >> np.uint64(44)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.grams, grams[likely]), len(self.grams) - 1)
        same = self.grams[spot] == grams[likely]
        likely, spot = likely[same], spot[same]
        many = self.owners[spot]
        which = self.owner[np.repeat(self.first[spot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(spot) else spot
        where = np.repeat(likely, many)
        key = doc[at[where]] * np.int64(len(self.wide)) + which
        order = np.argsort(key, kind="stable")
        key, where = key[order], where[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        size = np.diff(np.append(begin, len(key)))
        found: dict[int, list] = {}
        for x in np.flatnonzero(size >= self.need[key[begin] % len(self.wide)]):
            number, k = divmod(int(key[begin[x]]), len(self.wide))
            mine = at[where[begin[x] : begin[x] + size[x]]]
            bounds = np.searchsorted(doc, [number, number + 1])
            got = found.setdefault(number, [])
            taken = [(a, b) for a, b, name, _ in parts.get(number, []) if name == self.wide[k][0]]
            for a, b in self.windows(k, mine, h, line, int(bounds[0]), int(bounds[1]), taken):
                own, want = bigrams(plain[s[a] : e[b - 1]].tobytes()), self.wide[k][1]
                shared = len(own & want)
                if (d := 2 * shared / (len(own) + len(want))) >= self.threshold:
                    got.append((-shared, -d, a, b, self.wide[k][0]))
        for number, got in found.items():
            mine = sorted((x, y, shared) for x, y, _, shared in parts.get(number, []))
            # lines lie apart; only the whole text covers them
            across = [p for p in mine if len(mine) > 1 and p[0] <= mine[0][0] and p[1] >= max(y for _, y, _ in mine)] if mine else []
            apart = [p for p in mine if p not in across]
            starts = [x for x, _, _ in apart]

            def covered(a: int, b: int, shared: int) -> bool:
                """Whether a matching line or text with at least as many shared bigrams overlaps [a, b)."""
                if any(x < b and a < y and n >= shared for x, y, n in across):
                    return True
                k = bisect_left(starts, b)
                while k and apart[k - 1][1] > a:
                    k -= 1
                    if apart[k][2] >= shared:
                        return True
                return False

            # windows that count lie apart, or are one and the same: the last that starts before b tells all
            told: list[tuple[int, int, tuple]] = []
            for less, d, a, b, name in sorted(got):
                key = (less, d, a, b)
                if covered(a, b, -less):
                    continue
                k = bisect_left(told, (b,))
                if k and told[k - 1][1] > a and told[k - 1][2] != key:
                    continue
                told.insert(k, (a, b, key))
                yield number, name, -d

    def windows(self, k: int, mine: np.ndarray, h: np.ndarray, line: np.ndarray, lo: int, hi: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Word ranges in [lo, hi), the words of one text, that match template k; `mine` are the places of its bigrams."""
        _, _, want, length = self.wide[k]
        size, longest = len(want), int(self.most * length + 1e-9)
        free = np.ones(hi - lo + 1, bool)  # by word, counted from lo
        free[-1] = False
        for a, b in taken:
            free[a - lo : b - lo] = False
        mine = mine - lo
        mine = mine[free[mine] & free[mine + 1]]
        if len(mine) < self.need[k] or len(np.unique(ngrams(h[lo:hi], np.zeros(hi - lo, np.int8), 2)[0][mine])) < self.need[k]:
            return []
        grams, _ = ngrams(h[lo:hi], np.zeros(hi - lo, np.int8), 2)
        kind = np.unique(grams, return_inverse=True)[1]
        order = np.argsort(kind, kind="stable")
        last = np.full(len(grams), -1)  # where the same bigram stood before
        again = kind[order][1:] == kind[order][:-1]
        last[order[1:][again]] = order[:-1][again]
        known = np.zeros(len(grams), bool)
        known[mine] = True
        stop = np.flatnonzero(~free)
        row = line[lo:hi]
        # a line whose size fits the template is weighed as a line; inside it, shorter windows than the template do not count
        fits = np.zeros(hi - lo, np.int64)  # end of the fitting line that a word stands in
        starts = [mine]
        for r in np.unique(row[mine]):
            a, b = (int(x) for x in np.searchsorted(row, [r, r + 1]))
            if self.least * size - 1e-9 <= len(np.unique(kind[a : b - 1])) <= self.most * size + 1e-9:
                fits[a:b] = b
                starts.append(np.arange(a, b - 1))
        begin = np.unique(np.concatenate(starts))
        begin = begin[free[begin]]
        begin = begin[np.searchsorted(mine, begin + longest) - np.searchsorted(mine, begin) >= self.need[k]]
        end = stop[np.searchsorted(stop, begin)]  # the first word that is not free

        def best(i: int, limit: int):
            """(-dice, bigrams, start) of the best window from word i that ends by `limit`; the shortest of equals."""
            z = min(i + longest, limit - 1)
            if z <= i:
                return None
            new = last[i:z] < i
            d = 2 * np.cumsum(new & known[i:z]) / (np.cumsum(new) + size)
            if fits[i]:
                d[: max(0, min(length - 1, fits[i] - 1 - i))] = 0
            j = int(d.argmax())
            return (-float(d[j]), j + 1, i) if d[j] >= self.threshold else None

        limit = dict(zip(begin.tolist(), end.tolist()))
        now = {i: b for i, z in limit.items() if (b := best(i, z))}
        heap = list(now.values())
        heapify(heap)
        out = []
        while heap:
            item = heappop(heap)
            d, n, i = item
            if now.get(i) != item:
                continue
            a, b = i, i + n + 1
            out.append((a + lo, b + lo))
            for x in range(max(0, a - longest), b):
                if x in now:
                    old = now[x]
                    if x >= a:
                        del now[x]
                        continue
                    limit[x] = min(limit[x], a)
                    if x + old[1] + 1 > a:
                        del now[x]
                        if new := best(x, limit[x]):
                            now[x] = new
                            heappush(heap, new)
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, more: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license_id, dice (the best of any part) and n_parts, for documents with a part like a template.

    The parts of a text are its \\n-split lines, the whole text if it has several lines, and windows. Normalised: A-Z
    lower-cased, all but letters, digits and other scripts made white space. A line or whole text matches its best
    templates (ties: each of them) if the Dice coefficient of their sets of word bigrams reaches the threshold; sizes that
    rule this out are pruned.

    A window is a run of words, over any lines, of at most (2 - t) / t times a template's bigrams. For each template the
    best window of at least the threshold is taken (ties: the shortest, then the first), then the best of the words left
    beside it, and so on. Words of a line or text that matches the template itself are left out; so are windows shorter
    than the template inside one line whose size fits it, which was weighed as a line. Of windows that overlap, the one
    with more shared bigrams counts, then the higher Dice, then the first (ties in all: each template); a window that
    overlaps a matching line or text counts only if it shares more bigrams.

    Null and empty texts, and parts of one word, match nothing. Rows that repeat a doc_id count together. The templates,
    and `more` (for windows only; with the default templates, the notices and whole texts of longer()), are parameters
    whose size the caller sets; they go to every executor.
    """
    if more is None and templates is None:
        more = longer()
    given = docs.sparkSession.sparkContext.broadcast((templates or TEMPLATES, threshold, more))
    schema = docs.select("doc_id").schema.add("license_id", "string").add("dice", "double")

    def run(batches):
        scanner = Scanner(*given.value)
        for rows, buf, offs in slices(batches, "text"):
            found = list(scanner.scan(buf, offs))
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=schema.names)

    hits = docs.select("doc_id", "text").mapInArrow(run, schema)
    return hits.groupBy("doc_id", "license_id").agg(F.max("dice").alias("dice"), F.count("*").alias("n_parts"))
