"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut into words, each a run of word marks with what follows, and each
distinct word of a chunk is segmented once. Many words advance together, the
longest first, so that those that have ended drop off: at each place, for each piece length, the hash of the substring that
ends there is looked up among the sorted hashes of the pieces; a candidate
counts if it may follow the best piece of the prefix before it; the maximum over
the lengths is stored as the backpointer.

Which piece may follow which depends on the model's kind. In a unigram model any
may, and the maximum is of the summed scores. In a merge (BPE) model that sum
would not be what the model's own merging yields; there a piece may follow
another if merging the two together gives just these two back, which holds for
exactly one last piece of every prefix (each piece that is part of a merge
result must itself be reachable). So for both kinds the ids are the library's.

A long word, as texts without blanks are, is first cut wherever no piece spans
two neighbouring characters; its parts are then words like any other.

Characters that no piece covers are given as the bytes' pieces. Texts are used
as they are, with the dummy prefix; special tokens aren't added, and their
strings are ordinary text.

Defined results: a null text has null ids, an empty one none. Long texts are
encoded whole. Repeated rows count for themselves; other columns are ignored.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernels as K

#: Where the model file is; a cluster gives its own path.
MODEL_PATH = os.environ.get("FACTLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Bytes of text segmented at once.
CHUNK = 2 << 20
#: Words of more characters are cut, where no piece spans the seam, into parts that are segmented as words are.
LONG = 24
_AT_ONCE = 1 << 17
ENCODED = "doc_id long, ids array<int>, n_tokens int, round_trip boolean"


class Pieces:
    """A model's pieces, sorted by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.score = np.array([model.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = np.full(256, model.unk_id(), np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.text[i][3:5], 16)] = i
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids) if model.is_byte(int(i))}
        self.unknown = n  # stands for a character without piece
        self.merges = merges(path)
        self.rank = {self.text[i]: i for i in plain}
        self.longest = max(len(self.text[i]) for i in plain)
        codes, lengths = codepoints([self.text[i] for i in plain])
        h = np.array([code_hash(codes[s : s + m]) for s, m in zip(np.cumsum(lengths) - lengths, lengths)], np.uint64)
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array(plain, np.int64)[order]
        kept = set(plain)
        texts = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(MARK, " ").encode() if i in kept else b"" for i, t in enumerate(self.text)]
        self.pool = np.frombuffer(b"".join(texts), np.uint8)  # all pieces' bytes, end to end
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.mask = np.zeros(1 << 18, bool)
        self.mask[(self.keys >> np.uint64(46)).astype(np.int64)] = True
        # tables of the merging kind: a piece's hash and length, its place in the order of merges, and the two parts of its last merge
        self.hash = np.zeros(n + 1, np.uint64)
        self.hash[self.ids] = self.keys
        self.length = np.array([len(t) for t in self.text] + [1])
        self.power = np.ones(self.longest + 1, np.uint64)
        self.power[1:] = np.multiply.accumulate(np.full(self.longest, _BASE, np.uint64))
        self.order = np.full(n + 1, -1)
        if self.merges:
            self.tabulate(plain)
        self.cached = np.full(1 << 20, -1)
        self.verdict = np.zeros(1 << 20, bool)

    def tabulate(self, plain: list[int]) -> None:
        ranked = sorted(plain, key=lambda i: (len(self.text[i]) > 1, -self.score[i], i))
        self.order[ranked] = np.arange(len(ranked))
        self.left, self.right = np.arange(len(self.text) + 1), np.arange(len(self.text) + 1)
        values, times = np.unique(self.score[plain], return_counts=True)
        same = set(values[times > 1].tolist())
        self.slow = np.zeros(len(self.text) + 1, bool)  # pieces of equal scores merge from the left: these are tried out
        self.whole = np.zeros(len(self.text) + 1, bool)  # pieces that merging yields at all
        for i in plain:
            parts = self.merged(self.text[i], last=True)
            self.slow[i] = self.score[i] in same and len(self.text[i]) > 1
            self.whole[i] = len(parts) <= 2 and "".join(parts) == self.text[i] and (len(parts) == 1 or parts[0] + parts[1] in self.rank)
            if len(parts) == 2 and all(x in self.rank for x in parts):
                self.left[i], self.right[i] = self.rank[parts[0]], self.rank[parts[1]]
            elif len(parts) == 2:
                self.slow[i] = True
        self.whole[self.unknown] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 if there are none."""
        out = np.full(len(h), -1)
        likely = np.flatnonzero(self.mask[(h >> np.uint64(46)).astype(np.int64)])
        at = K.lookup(self.keys, h[likely])
        out[likely] = np.where(at >= 0, self.ids[at], -1)
        return out

    def merged(self, text: str, last: bool = False) -> list[str]:
        """What repeatedly merging the neighbours of the best score, the leftmost of equals, makes of a text; last: before two parts become one."""
        parts = list(text)
        while len(parts) > 1 + last:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                k = self.rank.get(parts[i] + parts[i + 1])
                if k is not None and self.score[k] > best:
                    best, at = self.score[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces that stand side by side stay as they are, by undoing their merges in turn.

        Both arose by merges; wherever the neighbours on the two sides of the seam
        could have merged before one of them did, they would have.
        """
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40)
        while len(live):
            joined = self.find(self.hash[a] * self.power[np.minimum(self.length[b], self.longest)] + self.hash[b])
            too_long = self.length[a] + self.length[b] > self.longest
            rank = np.where((joined >= 0) & ~too_long, self.order[joined], 1 << 41)
            lost = rank < limit
            out[live[lost]] = False
            first = self.order[a] > self.order[b]  # the side that merged later is taken apart, the other if that can't be
            can_a, can_b = self.left[a] != a, self.left[b] != b
            use_a = np.where(first, can_a, can_a & ~can_b)
            use_b = ~use_a & can_b
            limit = np.where(use_a, self.order[a], np.where(use_b, self.order[b] + 1, limit))
            a, b = np.where(use_a, self.right[a], a), np.where(use_b, self.left[b], b)
            on = ~lost & (use_a | use_b)
            live, a, b, limit = live[on], a[on], b[on], limit[on]
        return out

    def judge(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        found = self.whole[piece] & ((before < 0) | self.whole[before])
        pair = np.flatnonzero(found & (before >= 0) & (before != self.unknown) & (piece != self.unknown))
        slow = self.slow[before[pair]] | self.slow[piece[pair]]
        found[pair[~slow]] = self.apart(before[pair[~slow]], piece[pair[~slow]])
        for k in pair[slow].tolist():
            parts = [self.text[before[k]], self.text[piece[k]]]
            found[k] = self.merged("".join(parts)) == parts
        return found

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the pieces stay apart and whole when the model merges them. before: -1 at a word's start."""
        width = len(self.text) + 2
        key = (before + 1) * width + piece
        slot = (K.mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        hit = self.cached[slot] == key
        out = self.verdict[slot]
        if not hit.all():
            new, where = np.unique(key[~hit], return_inverse=True)
            found = self.judge(new // width - 1, new % width)
            out[~hit] = found[where]
            slot = (K.mix(new.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
            slot, one = np.unique(slot, return_index=True)
            self.cached[slot], self.verdict[slot] = new[one], found[one]
        return out


def merges(path: str) -> bool:
    """Whether the model file says that it's of the merging kind (trainer_spec.model_type = BPE)."""
    with open(path, "rb") as f:
        data = f.read()

    def fields(lo: int, hi: int):
        while lo < hi:
            key, lo = varint(lo)
            if key & 7 == 0:
                value, lo = varint(lo)
                yield key >> 3, value, None
            elif key & 7 == 2:
                n, lo = varint(lo)
                yield key >> 3, lo, lo + n
                lo += n
            else:
                lo += 8 if key & 7 == 1 else 4

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    for number, lo, hi in fields(0, len(data)):
        if number == 2 and hi is not None:  # the trainer's part; field 3 is the kind: 1 unigram, 2 merges
            return any(n == 3 and end is None and value == 2 for n, value, end in fields(lo, hi))
    return False


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


_BASE = 0xD6E8FEB86659FD93


def code_hash(codes: np.ndarray) -> int:
    h = 0
    for c in codes.tolist():
        h = (h * _BASE + c + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def viterbi(p: Pieces, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last pieces, backpointers) at every place of words, a column of code points each; the longest come first, and what lies below a word's end doesn't count."""
    length, n = words.shape
    prefix = np.zeros((length + 1, n), np.uint64)
    base = np.uint64(_BASE)
    for i in range(length):
        prefix[i + 1] = prefix[i] * base + words[i] + np.uint64(1)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    last = np.full((length + 1, n), -1, np.int64)
    back = np.zeros((length + 1, n), np.int64)
    least = p.score.min() - 1e10
    reach = np.searchsorted(-lengths, -np.arange(length + 1), side="right")  # words of so many characters at least
    for i in range(1, length + 1):
        m = reach[i]
        for size in range(1, min(i, p.longest) + 1):
            j = i - size
            piece = p.find(prefix[i, :m] - prefix[j, :m] * p.power[size])
            if size == 1:
                piece = np.where(piece < 0, p.unknown, piece)
            at = np.flatnonzero((piece >= 0) & (best[j, :m] > -np.inf))
            own = piece[at]
            if p.merges:
                at = at[p.may_follow(last[j, at], own)]
                own = piece[at]
                value = np.full(len(at), float(size))
            else:
                value = best[j, at] + np.where(own == p.unknown, least, p.score[np.minimum(own, len(p.score) - 1)])
            better = value > best[i, at]
            at, own = at[better], own[better]
            best[i, at], last[i, at], back[i, at] = value[better], own, j
    return last, back


def seams(p: Pieces, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, word) of the parts of words: long ones are cut wherever no piece spans two neighbouring characters.

    Neither a best segmentation nor a merge crosses such a place.
    """
    long = np.flatnonzero(lengths > LONG)
    if not len(long):
        return starts, lengths, np.arange(len(starts))
    at = K.ragged(starts[long], lengths[long])
    own = codes[at].astype(np.uint64) + np.uint64(1)
    word = np.repeat(long, lengths[long])
    spanned = np.zeros(len(own) + 1, np.int32)
    h = own
    for size in range(2, min(p.longest, len(own)) + 1):
        h = h[:-1] * np.uint64(_BASE) + own[size - 1 :]
        hit = np.flatnonzero(p.find(h) >= 0)
        hit = hit[word[hit] == word[hit + size - 1]]
        spanned += np.bincount(hit + 1, minlength=len(spanned))[: len(spanned)].astype(np.int32)
        spanned -= np.bincount(hit + size, minlength=len(spanned))[: len(spanned)].astype(np.int32)
    free = np.cumsum(spanned)[:-1] == 0
    free[0] = True
    free[1:] |= word[1:] != word[:-1]
    begin = np.flatnonzero(free)
    part_start, part_word = at[begin], word[begin]
    part_length = np.diff(np.append(begin, len(own)))
    short = np.flatnonzero(lengths <= LONG)
    part_start, part_length, part_word = (np.concatenate(x) for x in ((starts[short], part_start), (lengths[short], part_length), (short, part_word)))
    order = np.lexsort((part_start, part_word))
    return part_start[order], part_length[order], part_word[order]


def segment(p: Pieces, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, ids of each word)."""
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts, lengths, word_of = seams(p, codes, np.cumsum(lengths) - lengths, lengths)
    counts = np.zeros(len(words), np.int64)
    found = []
    order = np.argsort(-lengths, kind="stable")[: np.count_nonzero(lengths)]
    k = 0
    while k < len(order):
        length = int(lengths[order[k]])
        own = order[k : k + max(1, (1 << 17) // length)]
        k += len(own)
        chars = codes[np.minimum(starts[own] + np.arange(length)[:, None], len(codes) - 1)].astype(np.uint64)
        last, back = viterbi(p, chars, lengths[own])
        at = lengths[own].copy()
        live = np.arange(len(own))
        step = 0
        while len(live):
            piece, j = last[at[live], live], back[at[live], live]
            whole = piece != p.unknown
            found.append((own[live[whole]], np.full(int(whole.sum()), step), piece[whole]))
            for w, i in zip(live[~whole].tolist(), at[live[~whole]].tolist()):
                raw = chr(int(chars[i - 1, w])).encode("utf-8", "replace")
                found.append((np.full(len(raw), own[w]), step + np.arange(len(raw))[::-1] / 8, p.byte_ids[list(raw)].astype(np.int64)))
            at[live] = j
            live = live[j > 0]
            step += 1
    if not found:
        return np.zeros(0, np.int32), counts
    part, step, piece = (np.concatenate(x) for x in zip(*found))
    counts = np.bincount(word_of[part], minlength=len(words))
    return piece[np.lexsort((-step, part))].astype(np.int32), counts


def encode(p: Pieces, texts: pa.Array, seen: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, ids of each text); nulls have none."""
    seen = Words() if seen is None else seen
    marked = pc.replace_substring(pc.fill_null(texts, ""), " ", MARK)
    marked = pc.if_else(pc.equal(pc.binary_length(marked), 0), marked, pc.binary_join_element_wise(MARK, marked, ""))
    raw, offsets = K.string_bytes(marked)
    mark = np.frombuffer(MARK.encode(), np.uint8)
    is_mark = np.zeros(len(raw), bool)
    if len(raw) >= 3:
        is_mark[:-2] = (raw[:-2] == mark[0]) & (raw[1:-1] == mark[1]) & (raw[2:] == mark[2])
    # a word begins with a mark that no mark precedes, and with a text
    begin = is_mark.copy()
    begin[3:] &= ~is_mark[:-3]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(begin)
    bounds = np.append(start, len(raw)).astype(np.int64)
    word, first, counts, ids = seen.of(p, raw, bounds)
    flat = ids[K.ragged(first[word], counts[word])]
    per_word = np.concatenate([[0], np.cumsum(counts[word])])
    return flat, np.diff(per_word[np.searchsorted(start, offsets)])


class Words:
    """The words that a task has segmented, known by their hashes: so many at most, then it begins anew."""

    MOST = 1 << 19

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of(self, p: Pieces, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(word's index, then of all words known: first id, ids, and the ids end to end)."""
        h = K.span_hash(K.prefix_sums(raw), bounds[:-1], bounds[1:])
        keys, one, where = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.MOST:
            self.clear()
        new = np.flatnonzero(K.lookup(self.keys, keys) < 0)
        if len(new):
            # the new words' bytes, each word once
            at, size = bounds[one[new]], bounds[one[new] + 1] - bounds[one[new]]
            data = raw[K.ragged(at, size)]
            words = pa.Array.from_buffers(pa.large_string(), len(new), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(data)])
            ids, counts = segment(p, words)
            all_ = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_)
            first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
            self.keys, self.first, self.counts = all_[order], first[order], np.concatenate([self.counts, counts])[order]
            self.ids = np.concatenate([self.ids, ids])
        return np.searchsorted(self.keys, keys)[where], self.first, self.counts, self.ids


def spelled(p: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of ids, so many for each text: pieces' characters and bytes, without the dummy prefix."""
    size = p.sizes[ids]
    parts = [p.pool[K.ragged(p.firsts[ids[k : k + _AT_ONCE]], size[k : k + _AT_ONCE])] for k in range(0, len(ids), _AT_ONCE)]
    raw = np.concatenate([*parts, np.zeros(0, np.uint8)])
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
    lead = ends[:-1][np.diff(ends) > 0]
    lead = lead[raw[lead] == 32]
    keep = np.ones(len(raw), bool)
    keep[lead] = False
    gone = np.append(0, np.cumsum(~keep))
    return raw[keep], ends - gone[ends]


def same_texts(raw: np.ndarray, offsets: np.ndarray, other: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the texts are equal, byte by byte."""
    size = np.diff(offsets)
    ok = size == np.diff(others)
    if not ok.all():
        raw, other = raw[np.repeat(ok, size)], other[np.repeat(ok, np.diff(others))]
    rows = np.flatnonzero(ok)
    wrong = np.searchsorted(np.cumsum(size[rows]), np.flatnonzero(raw != other), side="right")
    ok[rows[wrong]] = False
    return ok


def encoded(documents: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): each text's piece ids, and whether decoding them gives the text back."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p = pieces(path)  # read on the driver; the tasks get the tables, of the vocabulary's size

    def run(batches):
        seen = Words()
        for batch in batches:
            for part in K.chunks(batch, size=CHUNK):
                texts = part.column("text")
                ids, counts = encode(p, texts, seen)
                missing = pc.is_null(texts)
                ok = pc.if_else(missing, pa.scalar(None, pa.bool_()), pa.array(same_texts(*spelled(p, ids, counts), *K.string_bytes(texts))))
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                lists = pc.if_else(missing, pa.scalar(None, lists.type), lists)
                sizes = pc.if_else(missing, pa.scalar(None, pa.int32()), pa.array(counts.astype(np.int32)))
                yield pa.record_batch([part.column("doc_id"), lists, sizes, ok], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(run, ENCODED)


def decoded(tokens: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): null ids, or a null among them, have a null text; ids that the model lacks spell nothing, and bytes that aren't UTF-8 become replacement marks."""
    p = pieces(path)

    def texts_of(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        holes = pc.is_null(flat).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.append(0, np.cumsum(counts))
        torn = np.diff(np.append(0, np.cumsum(holes))[ends]) > 0
        known = (ids >= 0) & (ids < len(p.sizes))
        raw, offsets = spelled(p, ids[known], np.diff(np.append(0, np.cumsum(known))[ends]))
        blobs = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
        try:
            texts = blobs.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([b.decode("utf-8", "replace") for b in blobs.to_pylist()], pa.string())
        return pc.if_else(pc.or_(pc.is_null(lists), pa.array(torn)), pa.scalar(None, pa.string()), texts)

    def run(batches):
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // CHUNK)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
                if hi > lo:
                    own = batch.slice(lo, hi - lo)
                    yield pa.record_batch([own.column("doc_id"), texts_of(own.column("ids"))], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
