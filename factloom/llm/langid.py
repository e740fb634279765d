"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams of a text, N of 1 to
ORDER letters, most frequent first, equals in code point order. Words are
lower-cased runs of letters with a blank before and after; an n-gram lies within
a padded word and isn't a lone blank. A language's profile counts all documents
that are labelled with it; the distance of a document from a language is the sum
over its own profile of how far each n-gram is out of place there, PROFILE for
one that the language lacks. The nearest language is taken, of equals the first
by name.

N-grams of up to three letters fit a 64-bit number exactly, so nothing is hashed.

Defined results: texts without letters, and null ones, have no language and no
distance; rows without a label don't count for profiles; repeated rows count
each time. With no labelled row no document has a language. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import kernels as K

ORDER = 3
PROFILE = 300
FOUND = "doc_id long, language string, distance long, n_ngrams int"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        table[codes] = pc.utf8_is_alpha(pa.array([chr(c) for c in codes])).to_numpy(zero_copy_only=False)
        _letters.append(table)
    return _letters[0]


def ngrams(texts: pa.Array, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length (text, n-gram as a number) of all n-grams, by text, with repetitions. A blank is code point 32; shorter n-grams have leading zeros."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    raw, offsets = K.string_bytes(lowered)
    lead = (raw & 0xC0) != 0x80
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum(lead)])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before[offsets]))
    letter = letter_table()[codes]
    # a blank before and after each word: non-letters become blanks, and each text begins and ends with one
    n = len(codes)
    place = np.arange(n) + 2 * doc + 1
    out = np.full(n + 2 * (len(offsets) - 1), 32, np.uint64)
    out[place[letter]] = codes[letter]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(before[offsets]) + 2)
    blank = out == 32
    found = []
    for k in range(1, order + 1):
        m = len(out) - k + 1
        if m <= 0:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        value = np.zeros(m, np.uint64)
        inner = np.zeros(m, bool)
        for j in range(k):
            value = (value << np.uint64(21)) | out[j : j + m]
            if 0 < j < k - 1:
                inner |= blank[j : j + m]
        # no blank within, not of blanks alone, and from one text
        ok = ~inner & (owner[:m] == owner[k - 1 :])
        ok &= ~blank[:m] if k == 1 else ~(blank[:m] & blank[k - 1 :]) if k == 2 else ok
        found.append((owner[:m][ok], value[ok]))
    return found


def text_order(gram: np.ndarray) -> np.ndarray:
    """A number that sorts as the n-gram's text does: letters first to last, a shorter one before its continuations."""
    size = 1 + (gram >> np.uint64(21) > 0) + (gram >> np.uint64(42) > 0)
    return gram << (np.uint64(21) * (3 - size).astype(np.uint64))


def gram_counts(found: list[tuple[np.ndarray, np.ndarray]], texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, n-gram, count), by doc; equal n-grams of a doc once."""
    ends = [np.searchsorted(doc, np.arange(texts + 1)) for doc, _ in found]
    docs, grams, counts = [], [], []
    for d in range(texts):
        own = np.sort(np.concatenate([gram[e[d] : e[d + 1]] for e, (_, gram) in zip(ends, found)] or [np.zeros(0, np.uint64)]))
        if len(own):
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            docs.append(np.full(len(cuts), d))
            grams.append(own[cuts])
            counts.append(np.diff(np.append(cuts, len(own))))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(grams), np.concatenate(counts)


def profiles(documents: DataFrame, order: int = ORDER, profile: int = PROFILE) -> DataFrame:
    """(language, gram, rank from 0) of each label's profile, over all labelled documents."""

    def count(batches):
        total: dict[str, list] = {}
        for batch in batches:
            for part in K.chunks(batch):
                codes = pc.dictionary_encode(part.column("lang"))
                doc, gram = (np.concatenate(x) for x in zip(*ngrams(part.column("text"), order)))
                label = codes.indices.to_numpy(zero_copy_only=False)[doc]
                for k, name in enumerate(codes.dictionary.to_pylist()):
                    own = np.sort(gram[label == k])
                    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
                    total.setdefault(name, []).append((own[cuts], np.diff(np.append(cuts, len(own)))))
                    if len(total[name]) > 8:
                        total[name] = [merged(total[name])]
        for name, lists in total.items():
            gram, n = merged(lists)
            yield pa.record_batch([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(text_order(gram).view(np.int64)), pa.array(n)], ["language", "gram", "place", "n"])

    def merged(lists: list) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([g for g, _ in lists]), return_inverse=True)
        return keys, np.bincount(where, weights=np.concatenate([n for _, n in lists]), minlength=len(keys)).astype(np.int64)

    rows = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "language string, gram long, place long, n long").groupBy("language", "gram", "place").agg(F.sum("n").alias("n"))
    # the bound on the row number lets each task send on no more than a profile of a language
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "place")))
    return ranked.where(F.col("rank") <= profile).select("language", "gram", (F.col("rank") - 1).alias("rank"))


def identify(documents: DataFrame, order: int = ORDER, profile: int = PROFILE) -> DataFrame:
    """(doc_id, language, distance, n_ngrams) of every document; n_ngrams is the length of its profile."""
    known = profiles(documents, order, profile).toArrow()  # as many rows as languages times the profile's length
    names = sorted(set(known["language"].to_pylist()))
    gram, rank, label = known["gram"].to_numpy().view(np.uint64), known["rank"].to_numpy(), known["language"].to_numpy(zero_copy_only=False)
    keys = np.unique(gram)
    places = np.full((max(1, len(keys)), len(names)), -1, np.int64)
    for k, name in enumerate(names):
        places[np.searchsorted(keys, gram[label == name]), k] = rank[label == name]

    def run(batches):
        for batch in batches:
            for part in K.chunks(batch):
                doc, gram, n = gram_counts(ngrams(part.column("text"), order), part.num_rows)
                best = np.lexsort((text_order(gram), -n, doc))
                doc, gram = doc[best], gram[best]
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                rank = np.arange(len(doc)) - first[doc]
                keep = rank < profile
                doc, gram, rank = doc[keep], gram[keep], rank[keep]
                at = K.lookup(keys, gram)
                there = np.where((at >= 0)[:, None], places[at], -1)
                away = np.where(there >= 0, np.abs(there - rank[:, None]), profile)
                distance = np.stack([np.bincount(doc, weights=c, minlength=part.num_rows) for c in away.T], axis=1).astype(np.int64) if names else np.zeros((part.num_rows, 1), np.int64)
                size = np.bincount(doc, minlength=part.num_rows)
                nearest = distance.argmin(axis=1)
                none = (size == 0) | (len(names) == 0)
                language = pa.array(np.array([*names, ""], object)[nearest], pa.string(), mask=none)
                yield pa.record_batch([part.column("doc_id"), language, pa.array(distance.min(axis=1), mask=none), pa.array(size.astype(np.int32))], ["doc_id", "language", "distance", "n_ngrams"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, FOUND)


LANGUAGE_SQL = f"""
WITH w AS (SELECT doc_id, lang, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL]+'), lambda x: x <> '')) || ' ' AS w FROM documents),
g AS (SELECT doc_id, lang, substr(w, i, n) AS g FROM (SELECT doc_id, lang, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM w, (SELECT unnest(range(1, {ORDER + 1})) AS n)) WHERE substr(w, i, n) <> ' '),
c AS (SELECT doc_id, lang, g, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS r FROM c QUALIFY r < {PROFILE}),
l AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS r FROM (SELECT lang, g, sum(n) AS n FROM c WHERE lang IS NOT NULL GROUP BY lang, g) QUALIFY r < {PROFILE}),
d AS (SELECT p.doc_id, a.lang, sum(CASE WHEN l.r IS NULL THEN {PROFILE} ELSE abs(l.r - p.r) END) AS distance FROM p CROSS JOIN (SELECT DISTINCT lang FROM l) a LEFT JOIN l ON l.lang = a.lang AND l.g = p.g GROUP BY ALL),
b AS (SELECT doc_id, lang, distance, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS k FROM d),
s AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)
SELECT t.doc_id, b.lang AS language, CAST(b.distance AS BIGINT) AS distance, CAST(coalesce(s.n, 0) AS INTEGER) AS n_ngrams
FROM documents t LEFT JOIN b ON b.doc_id = t.doc_id AND b.k = 1 LEFT JOIN s ON s.doc_id = t.doc_id
"""
