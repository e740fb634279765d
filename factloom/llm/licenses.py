"""License scans as an exact set-similarity join of text blocks with templates.

A block is a line, taken as the set of its tokens. A template is found in it if
the block has at least THRESHOLD of the template's distinct tokens. Only tokens
of templates can add to that, so both sides are reduced to them and put in one
global order, the rarest in the corpus first (by the number of blocks with the
token, over all documents). With o as the overlap that the threshold asks of a
template of m tokens:

* prefix: a block without any of the template's first m - o + 1 tokens is none;
* length: nor is one with less than o tokens;
* position: the first token in common, at places i and j, leaves an overlap of
  at most 1 + min(m - i - 1, n - j - 1).

What is left is verified by its overlap. The templates' prefixes are an inverted
index, so a template costs nothing where none of its rarest tokens occurs.

A template wrapped over lines is found in a run of consecutive tokens that goes
across line ends, if the run has as many of its distinct tokens and, without one
token for each line end (as a comment's mark may be), isn't longer than the
template over THRESHOLD. Such a find has the line that the run begins in; none
is reported that overlaps another find of the template. The same prefix says
where to look. Templates are a parameter and small; the
documents are passed over twice and never shuffled.

Defined results: null texts and lines without template tokens have no finds;
templates without tokens are never found; repeated rows are each reported, null
ids come out as null; other columns are ignored.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernels as K
from factloom.llm.linededup import ceil_of

THRESHOLD = (4, 5)
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3.0", "This library is free software under the GNU Lesser General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
)
FOUND = "doc_id long, line_no int, template string, overlap int, containment double"


class Blocks:
    """The lines that have template tokens: which ones, without repetitions."""

    def __init__(self, texts: pa.Array, keys: np.ndarray):
        t = K.tokenise(texts)
        low = np.uint64((1 << 16) - 1)
        mask = np.zeros(1 << 16, bool)
        mask[keys & low] = True
        some = np.flatnonzero(mask[t.h & low])
        at = K.lookup(keys, t.h[some])
        some, at = some[at >= 0], at[at >= 0]
        newlines = np.zeros(len(t.raw) + 1, np.int64)
        np.cumsum(t.raw == 10, out=newlines[1:])
        line = newlines[t.start[some]] + t.doc[some]
        both, one = np.unique(line * len(keys) + at, return_index=True) if len(some) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.line, self.token = both // max(1, len(keys)), both % max(1, len(keys))
        self.doc = t.doc[some[one]]
        self.all = some, at, line, t.doc[some]  # every occurrence: position, token, line, document
        self.begin = newlines[t.offsets[:-1]] + np.arange(len(t.offsets) - 1)  # each document's first line
        self.number = line[one] - newlines[t.offsets[self.doc]] - self.doc


class Index:
    """The templates' tokens, known by their ranks, as inverted lists: (token, template, place in the template's order)."""

    def __init__(self, ordered: list[np.ndarray], need: np.ndarray, tokens: int):
        self.ordered, self.need = ordered, need
        self.size = np.array([len(x) for x in ordered], np.int64)
        self.tokens = tokens
        template = np.repeat(np.arange(len(ordered)), np.where(self.size > 0, self.size - need + 1, 0))
        place = K.ragged(np.zeros(len(ordered), np.int64), np.where(self.size > 0, self.size - need + 1, 0))
        token = np.array([ordered[t][i] for t, i in zip(template.tolist(), place.tolist())], np.int64)
        order = np.lexsort((template, token))
        self.token, self.template, self.place = token[order], template[order], place[order]
        self.first = np.searchsorted(self.token, np.arange(tokens + 1))
        #: every template's tokens end to end, and each as one sorted number with its template
        self.begin = np.append(0, np.cumsum(self.size))
        self.flat = np.concatenate([*ordered, np.zeros(0, np.int64)]).astype(np.int64)
        self.member = np.sort(np.repeat(np.arange(len(ordered)), self.size) * tokens + self.flat)

    def hits(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, posting) of all entries whose token is in a template's prefix."""
        low, count = self.first[token], self.first[token + 1] - self.first[token]
        return np.repeat(np.arange(len(token)), count), K.ragged(low, count)

    def overlaps(self, group: np.ndarray, token: np.ndarray, groups: np.ndarray, templates: np.ndarray) -> np.ndarray:
        """How many of a template's tokens its group has. (group, token) pairs, sorted and distinct, are given."""
        key = group * self.tokens + token
        out = np.zeros(len(groups), np.int64)
        for lo in range(0, len(groups), 1 << 15):
            g, t = groups[lo : lo + (1 << 15)], templates[lo : lo + (1 << 15)]
            wanted = np.repeat(g, self.size[t]) * self.tokens + self.flat[K.ragged(self.begin[t], self.size[t])]
            own = np.repeat(np.arange(len(g)), self.size[t])
            out[lo : lo + len(g)] = np.bincount(own[K.lookup(key, wanted) >= 0], minlength=len(g))
        return out


def alone(index: Index, block: np.ndarray, token: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, template, overlap) of the blocks that hold a template. (block, token) are distinct, in order of blocks and ranks."""
    begins = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(block))))
    size = np.bincount(number, minlength=len(begins))
    entry, posting = index.hits(token)
    template, i = index.template[posting], index.place[posting]
    enough = size[number[entry]] >= index.need[template]
    entry, template, i = entry[enough], template[enough], i[enough]
    _, one = np.unique(number[entry] * max(1, len(index.size)) + template, return_index=True)  # the first token in common
    entry, template, i = entry[one], template[one], i[one]
    own, j = number[entry], entry - begins[number[entry]]
    near = 1 + np.minimum(index.size[template] - i - 1, size[own] - j - 1) >= index.need[template]
    own, template = own[near], template[near]
    overlap = index.overlaps(block, token, block[begins[own]], template)
    ok = overlap * den >= num * index.size[template]
    return block[begins[own[ok]]], template[ok], overlap[ok]


def wrapped(index: Index, lengths: np.ndarray, pos: np.ndarray, token: np.ndarray, line: np.ndarray, doc: np.ndarray, held: set, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(document, line, template, overlap) of the templates' runs across line ends. The places of all occurrences of templates' tokens are given; held has the (line, template) that hold one alone."""
    out: list = []
    if not len(pos):
        return out
    both = np.unique(doc * index.tokens + token)
    own_doc, own_token = both // index.tokens, both % index.tokens
    entry, posting = index.hits(own_token)
    pairs = np.unique(own_doc[entry] * len(index.size) + index.template[posting])
    docs, templates = pairs // len(index.size), pairs % len(index.size)
    lines = np.zeros(int(doc[-1]) + 1, np.int64)
    first = np.searchsorted(doc, np.arange(int(doc[-1]) + 2))
    some = np.flatnonzero(np.diff(first))
    lines[some] = line[first[some + 1] - 1] - line[first[some]]
    several = lines[docs] > 0  # on a single line there's nothing to wrap
    docs, templates = docs[several], templates[several]
    enough = index.overlaps(own_doc, own_token, docs, templates) >= index.need[templates]
    for d, t in zip(docs[enough].tolist(), templates[enough].tolist()):
        here = slice(first[d], first[d + 1])
        mine = index.ordered[t]
        of = np.searchsorted(mine, token[here])
        hit = np.flatnonzero(mine[np.minimum(of, len(mine) - 1)] == token[here])
        found = {n for n in np.unique(line[here][hit]).tolist() if (n, t) in held}
        out += ((d, n, t, c) for n, c in runs(pos[here][hit], of[hit], line[here][hit], len(mine), int(lengths[t]), int(index.need[t]), num, den, found))
    return out


def runs(pos: np.ndarray, token: np.ndarray, line: np.ndarray, m: int, length: int, need: int, num: int, den: int, found: set[int]) -> list[tuple[int, int]]:
    """(line, overlap) of a template's runs across line ends in one document; found has the lines that hold it alone."""
    most = length * den // num
    near = pos[token < m - need + 1]  # the prefix
    if not len(near):
        return []
    at = np.searchsorted(near, pos)
    gap = np.minimum(np.abs(near[np.minimum(at, len(near) - 1)] - pos), np.abs(pos - near[np.maximum(at - 1, 0)]))
    pos, token, line = (x[gap < 2 * most] for x in (pos, token, line))
    cut_ = np.append(True, np.diff(pos) >= 2 * most)
    part = np.cumsum(cut_) - 1
    kinds = np.bincount(np.unique(part * m + token) // m, minlength=part[-1] + 1)
    begins = np.append(np.flatnonzero(cut_), len(pos))
    out = []
    for p in np.flatnonzero((kinds >= need) & (line[begins[1:] - 1] > line[begins[:-1]])):
        last: dict[int, int] = {}  # of each token the last entry, by entry
        for e in range(begins[p], begins[p + 1]):
            if line[e] in found:
                last.clear()
                continue
            last.pop(token[e], None)
            last[token[e]] = e
            if len(last) < need:
                continue
            s = next(islice(last.values(), len(last) - need, None))
            ends = line[e] - line[s]
            if ends and pos[e] - pos[s] + 1 <= most + min(ends, length):
                whole = slice(s, np.searchsorted(pos[: begins[p + 1]], pos[s] + most + min(ends, length)))
                rest = ~np.isin(line[whole], list(found))
                out.append((int(line[s]), len(np.unique(token[whole][rest]))))
                last.clear()
    return out


def scan(documents: DataFrame, templates=TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, template, overlap, containment) of all finds; lines count from 0."""
    num, den = threshold
    t = K.tokenise(pa.array([text for _, text in templates], pa.string()))
    sets = [np.unique(t.h[t.first[i] : t.first[i + 1]]) for i in range(len(templates))]
    keys = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches):
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for part in K.chunks(batch):
                total += np.bincount(Blocks(part.column("text"), keys).token, minlength=len(keys))
        yield pa.record_batch([pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(total)], ["token", "n"])

    counted = docs.select("text").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(keys), np.int64)
    frequency[counted["token"].to_numpy()] = counted["n"].to_numpy()
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, frequency))] = np.arange(len(keys))
    ordered = [np.sort(rank[np.searchsorted(keys, s)]) for s in sets]  # each template's tokens by rarity
    lengths = np.diff(t.first)
    index = Index(ordered, np.array([int(ceil_of(np.int64(len(s)), num, den)) for s in sets], np.int64), len(keys))
    names = pa.array([name for name, _ in templates], pa.string())

    def find(batches):
        for batch in batches:
            for part in K.chunks(batch):
                b = Blocks(part.column("text"), keys)
                if not len(b.token):
                    continue
                order = np.lexsort((rank[b.token], b.line))
                line, template, overlap = alone(index, b.line[order], rank[b.token[order]], num, den)
                at = np.searchsorted(b.line, line)
                doc, number = b.doc[at], b.number[at]
                pos, token, lines, docs_of = b.all
                more = wrapped(index, lengths, pos, rank[token], lines, docs_of, set(zip(line.tolist(), template.tolist())), num, den)
                if more:
                    d, n, k, c = np.array(more).T
                    doc, number, template, overlap = np.append(doc, d), np.append(number, n - b.begin[d]), np.append(template, k), np.append(overlap, c)
                if len(doc):
                    yield pa.record_batch([part.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), names.take(pa.array(template)), pa.array(overlap.astype(np.int32)), pa.array(overlap / index.size[template])], ["doc_id", "line_no", "template", "overlap", "containment"])

    return docs.mapInArrow(find, FOUND)


_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> ''))"
LICENSE_SQL = f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
b AS (SELECT doc_id, line_no, {_SET.format("line")} AS s FROM l),
t AS (SELECT name, {_SET.format("text")} AS s FROM (VALUES {", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)}) AS v(name, text)),
p AS (SELECT doc_id, line_no, name, len(list_intersect(b.s, t.s)) AS o, len(t.s) AS m FROM b CROSS JOIN t)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, name AS template, CAST(o AS INTEGER) AS overlap, o / m AS containment FROM p WHERE o * {THRESHOLD[1]} >= m * {THRESHOLD[0]}
"""
