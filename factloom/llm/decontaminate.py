"""Benchmark decontamination by winnowing.

Every text is a sequence of tokens. The hashes of its runs of K tokens are
taken, and of each window of W consecutive hashes the smallest is kept (the
rightmost of equals). Two texts that share a run of at least K + W - 1 tokens
share such a fingerprint, so the fingerprints that training and test texts have
in common, extended to both sides as far as the tokens agree, give every
maximal shared span of that length.

A test side of at most BROADCAST_BYTES, which is checked, travels to the tasks, and
the training side is passed over once and not shuffled. Beyond that fingerprints
are joined by their hashes, and only texts that have one in common with an item
are brought together with it.

Defined results: null and empty texts, and texts of less than K + W - 1 tokens,
have no spans. Each row counts for itself: repeated rows give repeated results,
and a null id is carried along. Columns other than the id and the text are
ignored by ``leaks`` and kept unchanged by ``drop_leaks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernels as K_

K = 5
W = 9
#: Bytes of test texts, at most, that travel to the tasks; more are met by joining fingerprints.
BROADCAST_BYTES = 16 << 20
LEAK_SCHEMA = "doc_id long, item_id long, doc_start int, item_start int, n_tokens int"


def winnow(g: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Indices of the hashes kept. g: hashes of several texts; first: each text's first, one more at the end."""
    if not len(g):
        return np.zeros(0, np.int64)
    counts = np.diff(first)
    keep = np.zeros(len(g), bool)
    if len(g) >= w:
        windows = np.lib.stride_tricks.sliding_window_view(g, w)[:, ::-1]
        inside = np.zeros(len(g), bool)
        starts = K_.ragged(first[:-1], np.maximum(counts - w + 1, 0))
        inside[starts] = True
        inside = inside[: len(windows)]
        best = np.arange(len(windows)) + (w - 1) - windows.argmin(axis=1)
        keep[best[inside]] = True
    for i in np.flatnonzero((counts > 0) & (counts < w)):
        own = g[first[i] : first[i + 1]]
        keep[first[i + 1] - 1 - own[::-1].argmin()] = True
    return np.flatnonzero(keep)


def fingerprints(tokens: K_.Tokens, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of its first token) of the fingerprints of all texts."""
    g = K_.grams(tokens.h, k)
    counts = np.maximum(np.diff(tokens.first) - k + 1, 0)
    at = K_.ragged(tokens.first[:-1], counts)  # runs that don't cross from one text to the next
    bounds = np.concatenate([[0], np.cumsum(counts)])
    kept = winnow(g[at], bounds, w)
    return g[at[kept]], at[kept]


def spans(h: np.ndarray, first: np.ndarray, p: np.ndarray, doc: np.ndarray, other: np.ndarray, others: np.ndarray, q: np.ndarray, item: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, item, start in text, start in item, tokens) of the maximal shared spans of so many tokens that the hits (p, q) lie in.

    h, other: tokens of all texts and items; first, others: where each begins. Of the
    hits on a diagonal only the first is extended, then the first beyond the span
    found, and so on.
    """
    order = np.lexsort((p, p - q, item, doc))
    p, q, doc, item = p[order], q[order], doc[order], item[order]
    new = np.ones(len(p), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1])
    diagonal = np.cumsum(new) - 1
    last = np.append(np.flatnonzero(new)[1:], len(p))
    found = []
    at = np.flatnonzero(new)
    while len(at):
        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for way, reach in ((-1, left), (1, right)):
            live = np.arange(len(at))
            step = 0
            while len(live):
                step += way
                i, j = p[at[live]] + step, q[at[live]] + step
                d, b = doc[at[live]], item[at[live]]
                ok = (i >= first[d]) & (i < first[d + 1]) & (j >= others[b]) & (j < others[b + 1])
                live, i, j = live[ok], i[ok], j[ok]
                live = live[h[i] == other[j]]
                reach[live] += 1
        n = left + right + 1
        long = n >= least
        start = at[long]
        found.append(np.stack([doc[start], item[start], p[start] - left[long] - first[doc[start]], q[start] - left[long] - others[item[start]], n[long]]))
        # the next hit of the diagonal behind the span's end
        behind = np.searchsorted(diagonal * _FAR + p, diagonal[at] * _FAR + p[at] + right, side="right")
        at = behind[behind < last[diagonal[at]]]
    rows = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
    return tuple(rows)


_FAR = 1 << 33


class TestIndex:
    """Fingerprints of the test texts, sorted, with the texts' tokens."""

    def __init__(self, texts: list, k: int, w: int):
        self.k, self.w = k, w
        tokens = K_.tokenise(pa.array(texts, pa.string()))
        self.h, self.doc, self.first = tokens.h, tokens.doc, tokens.first
        fp, at = fingerprints(tokens, k, w)
        order = np.argsort(fp, kind="stable")
        self.fp, self.at = fp[order], at[order]
        self.mask = np.zeros(1 << 20, bool)
        self.mask[self.fp & np.uint64((1 << 20) - 1)] = True

    def spans(self, tokens: K_.Tokens) -> tuple[np.ndarray, ...]:
        """(text, item, start in text, start in item, tokens) of all maximal shared spans of at least k + w - 1 tokens."""
        fp, at = fingerprints(tokens, self.k, self.w)
        likely = self.mask[fp & np.uint64((1 << 20) - 1)]
        fp, at = fp[likely], at[likely]
        low = np.searchsorted(self.fp, fp, side="left")
        count = np.searchsorted(self.fp, fp, side="right") - low
        p = np.repeat(at, count)
        q = self.at[K_.ragged(low, count)]
        return spans(tokens.h, tokens.first, p, tokens.doc[p], self.h, self.first, q, self.doc[q], self.k + self.w - 1)


def named(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(name, text, h0, h1): the texts' names and two hashes."""
    text = F.col("text").cast("string")
    return rows.select(F.col(key).cast("long").alias(name), text.alias("text"), *(F.xxhash64(text, F.lit(seed)).alias(f"h{seed}") for seed in (0, 1))).where("text is not null")


def small(benchmark: DataFrame, most: int) -> bool:
    return (benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) <= most


def met(docs: DataFrame, items: DataFrame, k: int, w: int) -> DataFrame:
    """(h0, h1, i0, i1, doc_start, item_start, n_tokens): the spans that texts share with items, both known by their hashes.

    Fingerprints are joined by their hashes; a filter of fixed size keeps those back
    that no item has. Then the pairs' texts are joined in and their hits extended.
    """

    def prints(some: np.ndarray | None):
        def run(batches):
            for batch in batches:
                for part in K_.chunks(batch):
                    t = K_.tokenise(part.column("text"))
                    fp, at = fingerprints(t, k, w)
                    doc = t.doc[at]
                    if some is not None:
                        likely = some[(fp >> np.uint64(64 - _FILTER)).astype(np.int64)]
                        fp, doc = fp[likely], doc[likely]
                    both = np.unique(np.stack([doc, fp.view(np.int64)]), axis=1)
                    yield pa.record_batch([part.column("h0").take(pa.array(both[0])), part.column("h1").take(pa.array(both[0])), pa.array(both[1])], ["h0", "h1", "fp"])

        return run

    texts, tests = (x.select("h0", "h1", "text").dropDuplicates(["h0", "h1"]) for x in (docs, items))
    have = tests.mapInArrow(prints(None), "h0 long, h1 long, fp long").select(F.col("h0").alias("i0"), F.col("h1").alias("i1"), "fp")
    slots = have.select(F.shiftrightunsigned("fp", 64 - _FILTER).cast("int").alias("slot")).distinct().toArrow()
    some = np.zeros(1 << _FILTER, bool)
    some[slots["slot"].to_numpy()] = True
    pairs = docs.select("h0", "h1", "text").mapInArrow(prints(some), "h0 long, h1 long, fp long").join(have, "fp").select("h0", "h1", "i0", "i1").distinct()

    def extend(batches):
        for batch in batches:
            for part in K_.chunks(batch):
                for row in range(part.num_rows):
                    own = part.slice(row, 1)
                    t = K_.tokenise(own.column("text"))
                    doc, _, start, at, n = TestIndex(own.column("item").to_pylist(), k, w).spans(t)
                    if len(doc):
                        yield pa.record_batch([*(own.column(c).take(pa.array(doc)) for c in ("h0", "h1", "i0", "i1")), *(pa.array(x.astype(np.int32)) for x in (start, at, n))], ["h0", "h1", "i0", "i1", "doc_start", "item_start", "n_tokens"])

    sides = pairs.join(texts, ["h0", "h1"]).join(tests.select(F.col("h0").alias("i0"), F.col("h1").alias("i1"), F.col("text").alias("item")), ["i0", "i1"])
    return sides.select("h0", "h1", "i0", "i1", "text", "item").mapInArrow(extend, "h0 long, h1 long, i0 long, i1 long, doc_start int, item_start int, n_tokens int")


_FILTER = 22


def leaks(documents: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens): all maximal spans of k + w - 1 or more tokens that a document shares with a test item."""
    if not small(benchmark, broadcast_bytes):
        docs, items = named(documents, "doc_id", "doc_id"), named(benchmark, "item_id", "item_id")
        found = met(docs, items, k, w)
        found = found.join(docs.drop("text"), ["h0", "h1"]).join(items.select("item_id", F.col("h0").alias("i0"), F.col("h1").alias("i1")), ["i0", "i1"])
        return found.select("doc_id", "item_id", "doc_start", "item_start", "n_tokens")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").collect()
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]

    def find(batches):
        index, names = TestIndex(texts, k, w), pa.array(ids, pa.int64())
        for batch in batches:
            for part in K_.chunks(batch):
                doc, item, start, at, n = index.spans(K_.tokenise(part.column("text")))
                if len(doc):
                    yield pa.record_batch([part.column("doc_id").take(pa.array(doc)), names.take(pa.array(item)), *(pa.array(x.astype(np.int32)) for x in (start, at, n))], ["doc_id", "item_id", "doc_start", "item_start", "n_tokens"])

    return docs.mapInArrow(find, LEAK_SCHEMA)


def drop_leaks(documents: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without those that share a span with a test item."""
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    if not small(benchmark, broadcast_bytes):
        bad = met(named(documents, "doc_id", "doc_id"), named(benchmark, "item_id", "item_id"), k, w).select("h0", "h1").distinct()
        text = F.col("text").cast("string")
        keyed = documents.select(whole.alias("r"), *(F.when(text.isNotNull(), F.xxhash64(text, F.lit(seed))).alias(f"h{seed}") for seed in (0, 1)))
        return keyed.join(bad, ["h0", "h1"], "left_anti").select(*(F.col("r").getField(c).alias(c) for c in documents.columns))
    texts = [r[0] for r in benchmark.select(F.col("text").cast("string")).where("text is not null").collect()]

    def make():
        index = TestIndex(texts, k, w)

        def keep(own: pa.Array) -> np.ndarray:
            clean = np.ones(len(own), bool)
            clean[index.spans(K_.tokenise(own))[0]] = False
            return clean

        return keep

    return K_.filtered(documents, make)


#: The same spans as runs, on a diagonal, of shared windows of K + W - 1 tokens.
LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS t FROM benchmark),
dg AS (SELECT doc_id, i, array_to_string(t[i : i + {K + W - 2}], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - {K + W - 3})) AS i FROM d)),
bg AS (SELECT item_id, j, array_to_string(t[j : j + {K + W - 2}], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - {K + W - 3})) AS j FROM b)),
m AS (SELECT doc_id, item_id, i, j, i - j AS diag FROM dg JOIN bg USING (g)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS run FROM m)
SELECT doc_id, item_id, CAST(min(i) - 1 AS INTEGER) AS doc_start, CAST(min(j) - 1 AS INTEGER) AS item_start, CAST(count(*) + {K + W - 2} AS INTEGER) AS n_tokens
FROM r GROUP BY doc_id, item_id, diag, run
"""
