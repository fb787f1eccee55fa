"""License scans: blocks that share words with a license, compressed with each license text as a raw zstandard dictionary, confirmed by wording."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import scratch

# Wordings of public licenses and of the usual notices. <...> stands for up to MAX_SLOT words of any kind.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of <the copyright holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}

TOKEN = re.compile(r"\w+(?:[.\-/]\w+)*")
#: Words of other wording that a <...> slot may hold, and the least share by which the best dictionaries must shrink a block.
MAX_SLOT, LEAST_GAIN = 12, 0.08
#: A wording of fewer characters saves a compressor next to nothing: its gain is given, but does not keep it from being confirmed.
SHORT = 24
LEVEL = 3
_SLOT = "<>"


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words with start and end in code points."""
    return [(m[0].lower(), m.start(), m.end()) for m in TOKEN.finditer(text)]


@dataclass
class Wording:
    license: str
    no: int
    words: list[str]
    changes: int  # words that may be changed, missing or added
    fixed: set[int]  # places of words that name the license: these must stand
    anchors: list[str]
    squeezed: zstandard.ZstdCompressor
    chars: int

    @property
    def reach(self) -> int:
        """Words that a place of this wording can take up."""
        slots = self.words.count(_SLOT)
        return len(self.words) - slots + self.changes + MAX_SLOT * slots

    @property
    def least(self) -> int:
        """Words of the wording that any place of it must hold."""
        return max(1, len(self.words) - self.words.count(_SLOT) - self.changes)


def aligned(wording: list[str], got: list[str]) -> tuple[int, int, int, list[tuple[int, int, int, int]]]:
    """Least number of words to change, remove or add so that a run of ``got`` reads as ``wording``; slots hold up to MAX_SLOT words free.

    Returns (changes, first and last word of the run, edits), each edit as ranges of the wording and of ``got``.
    """
    n, cols = len(got), np.arange(len(got) + 1)
    rows = [np.zeros(n + 1, np.int32)]
    words = np.array(got, dtype=object)
    for w in wording:
        above = rows[-1]
        if w == _SLOT:
            row = above.copy()
            for k in range(1, min(MAX_SLOT, n) + 1):
                row[k:] = np.minimum(row[k:], above[:-k])
        else:
            row = above + 1
            row[1:] = np.minimum(row[1:], above[:-1] + (words != w))
            row = np.minimum.accumulate(row - cols) + cols
        rows.append(row.astype(np.int32))
    j = last = int(rows[-1].argmin())
    edits, i = [], len(wording)
    while i:
        w, here, above = wording[i - 1], rows[i][j], rows[i - 1]
        if w == _SLOT:
            k = next(k for k in range(min(MAX_SLOT, j) + 1) if above[j - k] == here)
            i, j = i - 1, j - k
        elif j and above[j - 1] + (got[j - 1] != w) == here:
            if got[j - 1] != w:
                edits.append((i - 1, i, j - 1, j))
            i, j = i - 1, j - 1
        elif above[j] + 1 == here:
            edits.append((i - 1, i, j, j))
            i -= 1
        else:
            edits.append((i, i, j - 1, j))
            j -= 1
    return int(rows[-1][last]), j, last, edits[::-1]


class Scanner:
    """Finds wordings of ``templates``; all that tells where to look is derived from them.

    A wording of n words may have c = n * max_difference words changed. Of any c + 1 of its words one stands unchanged, so c + 1 of them, the
    longest, are anchors: a text without an anchor of a wording cannot hold it. Where an anchor stands, the runs of words that hold as many words of
    the wording as any place of it must are its candidate blocks.
    """

    def __init__(self, templates: Mapping[str, list[str]] = TEMPLATES, max_difference: float = 0.1):
        self.items: list[Wording] = []
        for name, wordings in templates.items():
            for no, w in enumerate(wordings):
                words = [t if t == _SLOT else t.lower() for t in re.findall(rf"{_SLOT}|{TOKEN.pattern}", re.sub(r"<[^>]*>", _SLOT, w))]
                plain = [t for t in words if t != _SLOT]
                if not plain:
                    continue
                changes = int(max_difference * len(plain))
                anchors = sorted(range(len(words)), key=lambda i: (words[i] == _SLOT, -len(words[i]), i))[: changes + 1]
                data = zstandard.ZstdCompressionDict(w.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                squeezed = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False)
                self.items.append(Wording(name, no, words, changes, set(), [words[i] for i in anchors], squeezed, max(1, len(" ".join(words)))))
        for a in self.items:  # where wordings of two licenses nearly agree, the words that tell them apart name the license
            for b in self.items:
                if a.license != b.license and abs(len(a.words) - len(b.words)) <= 2 * (a.changes + b.changes):
                    differ, _, _, edits = aligned(a.words, b.words)
                    if differ <= 2 * max(a.changes, b.changes):
                        a.fixed |= {i for first, last, _, _ in edits for i in range(first, last)}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        vocabulary = sorted({w for item in self.items for w in item.words if w != _SLOT})
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.member = np.zeros((len(self.items), len(vocabulary) + 1), bool)
        for k, item in enumerate(self.items):
            self.member[k, [self.number[w] for w in item.words if w != _SLOT]] = True
        self.by_anchor: dict[str, list[int]] = {}
        for k, item in enumerate(self.items):
            for w in set(item.anchors):
                self.by_anchor.setdefault(w, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for w in self.by_anchor:
            self.automaton.add_word(w, w)
        if len(self.automaton):
            self.automaton.make_automaton()

    def candidates(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """By wording, the word ranges that hold enough of its words; long ranges come as overlapping ones of bounded length."""
        ids = np.array([self.number.get(w, 0) for w in words], np.int64)
        out: dict[int, list[tuple[int, int]]] = {}
        for k in sorted({k for w in set(words) & self.by_anchor.keys() for k in self.by_anchor[w]}):
            item = self.items[k]
            held = np.concatenate([[0], np.cumsum(self.member[k][ids])])
            ends = np.minimum(np.arange(len(ids)) + item.reach, len(ids))
            starts = np.flatnonzero(held[ends] - held[:-1] >= item.least)
            if not len(starts):
                continue
            breaks = np.flatnonzero(np.diff(starts) > 1) + 1
            for run in np.split(starts, breaks):
                first, last = int(run[0]), min(len(ids), int(run[-1]) + item.reach)
                for at in range(first, max(first + 1, last - item.reach + 1), item.reach):
                    out.setdefault(k, []).append((at, min(last, at + 2 * item.reach)))
        return out

    def places(self, item: Wording, words: list[str], low: int = 0) -> Iterator[tuple[int, int, list[str]]]:
        """All places, apart from each other, where a wording stands in ``words`` with few enough changes and no change of its name."""
        if len(words) < item.least:
            return
        changes, first, last, edits = aligned(item.words, words)
        if changes > item.changes or first == last:
            return
        if not any(i in item.fixed for a, b, _, _ in edits for i in range(a, b)):
            yield low + first, low + last, [f"-{' '.join(item.words[a:b])}+{' '.join(words[c:d])}" for a, b, c, d in merged(edits)]
        yield from self.places(item, words[:first], low)
        yield from self.places(item, words[last:], low + last)

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float, list[str]]]:
        """(license, wording, start, end, gain, differences) in a whole text; of overlapping finds the one with most unchanged words less its
        differences, then the longest, then the one of highest gain stays."""
        if not text or not len(self.automaton) or next(self.automaton.iter(text.lower()), None) is None:
            return []
        spans = tokens(text)
        words = [w for w, _, _ in spans]
        found: dict[tuple[str, int, int, int], tuple[float, list[str], int]] = {}
        ranked: dict[tuple[int, int], dict[int, float]] = {}
        for k, blocks in self.candidates(words).items():
            for low, high in blocks:
                if (low, high) not in ranked:
                    ranked[low, high] = self.gains(text[spans[low][1] : spans[high - 1][2]])
                gain = ranked[low, high].get(k)
                if gain is None:
                    continue
                item = self.items[k]
                for first, last, differences in self.places(item, words[low:high], low):
                    found[item.license, item.no, spans[first][1], spans[last - 1][2]] = (gain, differences, len(item.words) - 2 * len(differences))
        rank = sorted(found.items(), key=lambda f: (-f[1][2], f[0][2] - f[0][3], -f[1][0], f[0]))
        starts: list[int] = []
        out: list[tuple[str, int, int, int, float, list[str]]] = []
        for (name, no, start, end), (gain, differences, _) in rank:
            at = bisect.bisect_left(starts, start)
            if (at == len(starts) or out[at][2] >= end) and (at == 0 or out[at - 1][3] <= start):
                starts.insert(at, start)
                out.insert(at, (name, no, start, end, gain, differences))
        return out

    def gains(self, block: str) -> dict[int, float]:
        """By wording, by how much of its length its text as a dictionary shrinks a block, highest first; those of LEAST_GAIN only, or SHORT."""
        data = block.lower().encode("utf-8", "surrogatepass")
        size = len(self.plain.compress(data))
        gains = sorted(((size - len(item.squeezed.compress(data))) / item.chars, k) for k, item in enumerate(self.items))[::-1]
        return {k: gain for gain, k in gains if gain >= LEAST_GAIN or self.items[k].chars < SHORT}


def merged(edits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Neighbouring edits as one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, c, d in edits:
        if out and out[-1][1] == a and out[-1][3] == c:
            out[-1] = (out[-1][0], b, out[-1][2], d)
        else:
            out.append((a, b, c, d))
    return out


def scan(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, max_difference: float = 0.1, text_col: str = "text") -> DataFrame:
    """``docs`` with ``licenses``: array<struct<license,wording,start,end,gain,exact,differences>> of every whole text.

    Blocks with enough words of a wording are compressed alone and with each template as raw dictionary; gains are ranked per
    template character, and winners confirmed word by word: ``differences`` lists -old+new changes, ``exact`` has none. At most
    ``max_difference`` of a wording's words may be changed, missing or added (so short wordings must stand exactly), and none that tells two licenses
    apart ("Attribution" of "Attribution-ShareAlike", the 2 of version 2), wherever in the wording they are.
    Null and empty texts have none; texts of any length are read whole, in time that grows with them. Repeated rows have the same finds; an empty
    table gives no rows. A column named ``licenses`` is replaced; other columns stay. One narrow pass, no shuffle.
    """
    kept = docs.drop("licenses")
    kind = T.ArrayType(T.StructType.fromDDL("license string, wording int, start bigint, end bigint, gain double, exact boolean, differences array<string>"))
    schema = T.StructType([*kept.schema.fields, T.StructField("licenses", kind)])
    arrow = pa.list_(pa.struct([("license", pa.string()), ("wording", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("gain", pa.float64()), ("exact", pa.bool_()), ("differences", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, max_difference)
        for b in batches:
            out = [[dict(zip(("license", "wording", "start", "end", "gain", "exact", "differences"), (n, w, s, e, g, not d, d))) for n, w, s, e, g, d in scanner.scan(t.as_py())] for t in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow)], names=[*b.schema.names, "licenses"])

    return kept.transform(scratch.bounded).mapInArrow(run, schema)
