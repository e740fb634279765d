"""Vectorised text kernels that the operators share.

They work on Arrow string arrays a few megabytes at a time, so that memory
doesn't depend on the partition's size. A token is a maximal run of ASCII
letters or digits and non-ASCII characters of the lower-cased text; it's known
by a 64-bit hash of its bytes. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 2 << 20

_P = 0x9E3779B97F4A7C55
_P_INVERSE = pow(_P, -1, 1 << 64)
_WORD = np.zeros(256, bool)
for _range in (range(48, 58), range(97, 123), range(128, 256)):
    _WORD[list(_range)] = True
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _table(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_LOW = 4096
_low = {name: _table(base, _LOW) for name, base in (("up", _P), ("down", _P_INVERSE))}
_high = {name: _table(pow(base, _LOW, 1 << 64), _LOW) for name, base in (("up", _P), ("down", _P_INVERSE))}


_block = _table(_P, 1 << 17)


def power(at: np.ndarray, name: str = "up") -> np.ndarray:
    """The hash's base, or its inverse, to the powers given, modulo 2**64: a product from two tables of fixed size, with a third for texts beyond 16 MB."""
    out = _low[name][at & (_LOW - 1)] * _high[name][(at >> 12) & (_LOW - 1)]
    if len(at) and int(at.max()) >> 24:
        base = pow(_P if name == "up" else _P_INVERSE, 1 << 24, 1 << 64)
        out *= _table(base, (int(at.max()) >> 24) + 1)[at >> 24]
    return out


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash over bytes or hashes, block by block so that little else is held."""
    out = np.zeros(len(raw) + 1, np.uint64)
    for lo in range(0, len(raw), len(_block)):
        own = raw[lo : lo + len(_block)].astype(np.uint64)
        own += np.uint64(1)
        own *= _block[: len(own)]
        own *= np.uint64(pow(_P, lo, 1 << 64))
        own[:1] += out[lo : lo + 1]
        np.cumsum(own, out=out[lo + 1 : lo + 1 + len(own)])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, from their prefix sums."""
    return mix((prefix[end] - prefix[start]) * power(start, "down") + (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix steps)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, one row at least."""
    size = size or CHUNK_BYTES
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live on from stage to stage."""
    if _trim is not None:
        _trim(0)


def filtered(documents: DataFrame, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The documents whose texts a test lets through, with all their columns, whatever these are called. make: gives the test, once a task."""
    names = [f"c{n}" for n in range(len(documents.columns))]
    text = names[documents.columns.index("text")]
    plain = documents.toDF(*names)

    def run(batches):
        keep = make()
        for batch in batches:
            for part in chunks(batch, text):
                yield part.filter(pa.array(keep(part.column(text))))

    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


@dataclass
class Tokens:
    """Tokens of several texts, in order: hash, text's index, byte span in the lower-cased bytes."""

    h: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray
    first: np.ndarray  # first token of each text, one more at the end
    prefix: np.ndarray  # prefix sums of the polynomial hash

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans."""
        return span_hash(self.prefix, start, end)


def tokenise(texts: pa.Array) -> Tokens:
    raw, offsets = string_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(raw)
    word = _WORD[raw]
    edge = np.empty(n, bool)  # the first byte of a token, then the last
    if n:
        edge[0] = word[0]
        np.greater(word[1:], word[:-1], out=edge[1:])
        cut = offsets[:-1][offsets[:-1] < n]
        edge[cut] = word[cut]
    start = np.flatnonzero(edge)
    if n:
        edge[-1] = word[-1]
        np.greater(word[:-1], word[1:], out=edge[:-1])
        cut = offsets[1:][offsets[1:] > 0] - 1
        edge[cut] = word[cut]
    end = np.flatnonzero(edge) + 1
    del word, edge
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    tokens = Tokens(np.zeros(0, np.uint64), doc, start, end, raw, offsets, first, prefix_sums(raw))
    tokens.h = tokens.span_hash(start, end)
    return tokens


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    up = power(np.arange(k))
    for j in range(k):
        out += h[j : j + n] * up[j]
    return mix(out)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(shift, counts) + np.repeat(starts, counts)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of the wanted values in sorted, distinct keys; -1 if absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)
