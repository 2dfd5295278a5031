"""License scans by template-markup matching.

A template is license wording with markup: ``<<opt>>...<<end>>`` encloses an optional region (they nest),
``<<var:a-b>>`` stands for a to b words of any wording. It is compiled to an automaton over word tokens
(case, punctuation and line breaks don't count). A stretch of a text is accepted if the automaton reads it
to the end, that is, if all mandatory wording is there exactly and in order and nothing else is, except in
optional and replaceable regions. Every start in every text is tried, and of the accepted stretches those
are reported that lie in no longer one, whatever its license, so that a text is found once and not again
without its optional parts.

Starts are found by the first two mandatory words of a template, compared as hashes over whole batches, so
the automata run only where these words stand.

Defined cases: null and empty texts hold nothing; texts are scanned whole; repeated rows are reported each;
null ids are carried; equal wording at several places is reported at each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vec
from .common import narrow

_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<opt>>1. <<end>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<opt>>2. <<end>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY <<var:1-12>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
_SPDX = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later")

TEMPLATES = {
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0<<opt>> (the License); you may not use this <<var:1-4>> except in compliance with the License<<end>>",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3<<opt>>, or (at your option) any later version<<end>>",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0<<opt>> International<<end>>",
    "MIT": "<<opt>>MIT License<<end>><<opt>>Copyright <<var:1-20>><<end>>Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph) <<end>>shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "ISC": "Permission to use, copy, modify, and<<opt>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND <<var:1-10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + "<<opt>>3. <<end>>Neither the name of <<var:1-12>> nor the names of <<var:1-4>> may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    **{f"{k}-spdx": f"SPDX-License-Identifier: {k}" for k in _SPDX},
}

# a program is a list of (op, a, b): word a | split to a and b | jump to a | any word, counted by splits


def compile_template(markup: str) -> list[tuple[str, object, object]]:
    """The automaton of a template, as a program of words, any-words and splits."""
    program: list[list] = []
    opened: list[int] = []
    for part in re.split(r"(<<[^>]*>>)", markup):
        if part == "<<opt>>":
            opened.append(len(program))
            program.append(["split", len(program) + 1, None])
        elif part == "<<end>>":
            program[opened.pop()][2] = len(program)
        elif part.startswith("<<var:"):
            least, most = (int(x) for x in part[6:-2].split("-"))
            program += [["any", None, None] for _ in range(least)]
            end = len(program) + 2 * (most - least)
            for _ in range(most - least):
                program += [["split", len(program) + 1, end], ["any", None, None]]
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part}")
        else:
            program += [["word", w, None] for w in vec.word_list(part)]
    if opened:
        raise ValueError("an optional region is not closed")
    return [tuple(x) for x in program]


class Automaton:
    """A compiled template that runs over word hashes."""

    def __init__(self, markup: str) -> None:
        self.program = [(op, _hash(a) if op == "word" else a, b) for op, a, b in compile_template(markup)]

    def starts(self) -> set[tuple[int, int | None]]:
        """The words that an accepted stretch can begin with, each with the one after it if that is certain."""
        out = set()
        for pc in self._closure({0}):
            if pc == len(self.program) or self.program[pc][0] != "word":
                raise ValueError("a template must begin with wording")
            after = self.program[pc + 1] if pc + 1 < len(self.program) else ("end", None, None)
            out.add((self.program[pc][1], after[1] if after[0] == "word" else None))
        return out

    def _closure(self, pcs: set[int]) -> set[int]:
        out, todo = set(), list(pcs)
        while todo:
            pc = todo.pop()
            if pc in out:
                continue
            if pc < len(self.program) and self.program[pc][0] == "split":
                todo += self.program[pc][1:]
            else:
                out.add(pc)
        return out

    def longest(self, words: list[int], at: int) -> int:
        """The end of the longest accepted stretch that begins at ``at``, or -1."""
        end, state, final = -1, self._closure({0}), len(self.program)
        while state:
            if final in state:
                end = at
            if at == len(words):
                break
            w = words[at]
            state = self._closure({pc + 1 for pc in state if pc < final and (self.program[pc][0] == "any" or self.program[pc][1] == w)})
            at += 1
        return end


def _hash(word: str) -> int:
    return int(vec.words(*vec.flat(pa.array([word])))[0][0])


def maximal(stretches: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Those of the stretches (row, first, last, name) that lie in no longer one of their row."""
    out, row, reach, begun = [], None, 0, 0
    for x in sorted(stretches, key=lambda x: (x[0], x[1], -x[2], x[3])):
        r, first, last, _ = x
        if r != row:
            row, reach, begun = r, 0, 0
        # of those before it in this order, one that reaches as far holds it, unless it is the same stretch
        if last > reach or (last == reach and first == begun):
            out.append(x)
            if last > reach:
                reach, begun = last, first
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, first_word, last_word (words from 1) of every accepted stretch."""
    rows = narrow(docs, "doc_id", "text")
    automata = {name: Automaton(t) for name, t in templates.items()}
    starts = [(name, a, b) for name, m in automata.items() for a, b in m.starts()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.flat(batch.column(1))
            found = []
            for i, j in vec.chunks(offsets):
                h, _, bounds = vec.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                following = np.append(h[1:], np.uint64(0))
                hits = set()
                for name, a, b in starts:
                    ok = h == np.uint64(a)
                    if b is not None:
                        ok &= following == np.uint64(b)
                    hits.update((int(p), name) for p in np.flatnonzero(ok))
                here = []
                for p, name in sorted(hits):
                    r = int(np.searchsorted(bounds, p, "right")) - 1
                    end = automata[name].longest(_Slice(h, p, int(bounds[r + 1])), 0)
                    if end >= 0:
                        first = p - int(bounds[r])
                        here.append((i + r, first + 1, first + end, name))
                found += [(r, name, a, b) for r, a, b, name in maximal(here)]
            cols = list(zip(*found)) if found else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "license", "first_word", "last_word"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, license string, first_word long, last_word long")


class _Slice:
    """The words of one text from a place on, without copying them."""

    def __init__(self, h: np.ndarray, at: int, end: int) -> None:
        self.h, self.at, self.n = h, at, end - at

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> int:
        return int(self.h[self.at + k])
