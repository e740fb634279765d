"""Near-duplicate documents by Order MinHash.

A document's k-mers are its runs of K tokens (with marks before the first and
after the last, so that short texts have some), each labelled with how often it
has occurred so far. For each of SKETCHES hash functions the LENGTH k-mers with
the smallest hashes are kept and put in text order; two documents of high edit
similarity likely agree on one such sequence at least. Documents that do are
candidates, and those whose token sequences have an edit similarity
1 - distance / longer length of SIMILARITY or more, found by an alignment within
a band that the threshold gives, are linked. Groups are connected components.

Candidates whose tokens, counted by classes of hashes, differ by more than the
threshold's number of edits are dropped before their texts are fetched; that
bound is exact.

Texts with the same token sequence are collapsed first. Of the documents that
share a sketch, first all are compared with the smallest id; then, in order to
lose no link, all pairs that aren't in the same component by then. Hence no
limit on the size of a bucket, and thousands of copies cost thousands of
comparisons, not millions. Where more than FEW documents of a bucket lie outside
its largest component, as where unlike texts share a line, only those meet that
also share one of their rarest tokens: with at most e edits, e + 1 tokens of
each can't all be missing from the other. That is exact too, whatever order the
tokens are put in; theirs is by how many such documents have them. Buckets are
met by joins, which Spark splits where one is hot; none is gathered into a row.

Defined results: null texts and texts without tokens are in no group, nor are
rows without id. Of rows with the same id, the one whose text's hash is smallest
counts. Long texts are sketched and aligned whole. Other columns are ignored by
``groups`` and kept unchanged by ``drop_copies``, which keeps of each group the
smallest id, and of rows with the same id one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernels as K_
from factloom.llm.components import components
from factloom.llm.linededup import TOKEN
from factloom.session import cut

#: With these, isolated pairs of just SIMILARITY become candidates in 0.94 of cases or more, whatever their length.
K = 3
LENGTH = 2
SKETCHES = 40
SIMILARITY = 0.75
FILTER_BITS = 22
#: Documents of a bucket outside its largest component that all its documents are compared with directly.
FEW = 32
#: Tokens are counted, to tell rare ones, in 2**RARE_BITS classes of hashes.
RARE_BITS = 20
_EDGE = np.uint64(0xA24BAED4963EE407)


def sequences(t: K_.Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each text): occurrence-labelled k-mers in text order. Texts without tokens have none."""
    counts = np.diff(t.first)
    some = counts > 0
    padded = np.where(some, counts + 2 * (k - 1), 0)
    starts = np.cumsum(padded) - padded
    h = np.full(int(padded.sum()), _EDGE, np.uint64)
    at = K_.ragged(starts[some] + k - 1, counts[some])
    h[at] = t.h
    h[K_.ragged((starts + counts + k - 1)[some], np.full(int(some.sum()), k - 1))] = ~_EDGE
    g = K_.grams(h, k)
    n = np.where(some, counts + k - 1, 0)
    g = g[K_.ragged(starts, n)] if len(g) else g
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    own = K_.mix(g ^ (doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    low = np.uint64((1 << max(1, len(g).bit_length())) - 1)
    key = np.sort((own & ~low) | np.arange(len(g), dtype=np.uint64))
    order = (key & low).astype(np.int64)
    again = np.zeros(len(g), bool)
    again[1:] = own[order[1:]] == own[order[:-1]]
    run = np.arange(len(g))
    begin = np.maximum.accumulate(np.where(again, 0, run)) if len(g) else run
    label = np.empty(len(g), np.uint64)
    label[order] = (run - begin).astype(np.uint64)
    return np.where(label > 0, K_.mix(g + label * np.uint64(0xC2B2AE3D27D4EB4F)), g), first


def sketches(e: np.ndarray, first: np.ndarray, length: int, count: int) -> np.ndarray:
    """A column of hashed ordered sequences for each hash function; 0 rows for texts without k-mers stay 0."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), count), np.uint64)
    if not len(some):
        return out
    begin, size = first[:-1][some], n[some]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    seeds = K_.mix(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    for s, seed in enumerate(seeds):
        v = e * seed
        v ^= v >> np.uint64(29)
        at = []
        for _ in range(length):
            least = np.minimum.reduceat(v, begin)
            place = np.flatnonzero(v == np.repeat(least, size))
            text = np.searchsorted(begin, place, side="right") - 1
            one = np.full(len(begin), -1)
            one[text[::-1]] = place[::-1]  # the first of equals
            one[least == top] = -1  # fewer k-mers than asked for
            at.append(one)
            v[one[one >= 0]] = top
        at = np.sort(np.stack(at), axis=0)  # text order
        h = np.full(len(begin), s, np.uint64)
        for one in at:
            h = K_.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(one >= 0, e[one], np.uint64(0)))
        out[some, s] = h
    return out


def sequence_hash(t: K_.Tokens) -> np.ndarray:
    """Hash of each text's token sequence."""
    return K_.span_hash(K_.prefix_sums(t.h), t.first[:-1], t.first[1:])


#: A text of less than LONG_TEXT tokens counts them in BAG classes of hashes, a longer one in eight times as many.
BAG, LONG_TEXT = 128, 1024


def bags(t: K_.Tokens) -> list[bytes]:
    """How many tokens of each class every text has."""
    out: list[bytes] = []
    size = np.diff(t.first)
    for lo in range(0, len(size), 2048):
        n = min(2048, len(size) - lo)
        own = slice(t.first[lo], t.first[lo + n])
        counts = np.bincount((t.doc[own] - lo) * BAG + (t.h[own] & np.uint64(BAG - 1)).astype(np.int64), minlength=n * BAG).reshape(n, BAG)
        out += [row.tobytes() for row in counts.astype("<u2")]
    for i in np.flatnonzero(size >= LONG_TEXT):
        h = t.h[t.first[i] : t.first[i + 1]] & np.uint64(8 * BAG - 1)
        out[i] = np.bincount(h.astype(np.int64), minlength=8 * BAG).astype("<u4").tobytes()
    return out


def bag(blob: pa.Buffer) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * BAG else "<u4").astype(np.int64)


def plausible(pairs: DataFrame, bagged: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that may be similar: of tokens of some class that a side has more of than the other, each costs an edit. bagged: (id, bag)."""

    def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = np.floor((1 - similarity) * np.maximum(x.sum(axis=1), y.sum(axis=1)) + 1e-9)
        d = x - y
        return np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1)) <= most

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                short = pc.and_(*(pc.equal(pc.binary_length(part.column(c)), 2 * BAG) for c in ("x", "y"))).to_numpy(zero_copy_only=False)
                ok = np.ones(part.num_rows, bool)
                sides = (part.column(c).filter(pa.array(short)) for c in ("x", "y"))
                ok[short] = possible(*(np.frombuffer(b"".join(side.to_pylist()), "<u2").reshape(-1, BAG).astype(np.int32) for side in sides))
                for k in np.flatnonzero(~short):
                    x, y = (bag(part.column(c)[int(k)].as_buffer()) for c in ("x", "y"))
                    if len(x) != len(y):
                        x, y = x.reshape(-1, BAG).sum(axis=0), y.reshape(-1, BAG).sum(axis=0)
                    ok[k] = possible(x[None], y[None])[0]
                yield part.select(["a", "b"]).filter(pa.array(ok))

    x, y = (bagged.select(F.col("id").alias(a), F.col("bag").alias(b)) for a, b in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def signatures(documents: DataFrame, k: int, length: int, count: int) -> DataFrame:
    """(doc_id, pick, whole, size, sketches, bag) of the documents with an id and tokens."""

    def run(batches):
        for batch in batches:
            for part in K_.chunks(batch):
                t = K_.tokenise(part.column("text"))
                own = sketches(*sequences(t, k), length, count)
                some = np.flatnonzero(np.diff(t.first))
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * count).astype(np.int32)), pa.array(own[some].view(np.int64).ravel()))
                counted = bags(t)
                yield pa.record_batch([part.column("doc_id").take(pa.array(some)), part.column("pick").take(pa.array(some)), pa.array(sequence_hash(t)[some].view(np.int64)), pa.array(np.diff(t.first)[some]), lists, pa.array([counted[i] for i in some], pa.binary())], ["doc_id", "pick", "whole", "size", "sketches", "bag"])

    return documents.mapInArrow(run, "doc_id long, pick long, whole long, size long, sketches array<long>, bag binary")


def strip_common(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences without the beginning and the end that they share."""
    n = min(len(x), len(y))
    off = np.flatnonzero(x[:n] != y[:n])
    at = int(off[0]) if len(off) else n
    x, y = x[at:], y[at:]
    n = min(len(x), len(y))
    if n:
        off = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
        at = int(off[0]) if len(off) else n
        x, y = x[: len(x) - at], y[: len(y) - at]
    return x, y


def bag_distance(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the edit distance: tokens that the other side lacks, of the side with more of them."""
    names, index = np.unique(np.concatenate([x, y]), return_inverse=True)
    d = np.bincount(index[: len(x)], minlength=len(names)) - np.bincount(index[len(x) :], minlength=len(names))
    return int(max(d[d > 0].sum(), -d[d < 0].sum()))


def band(xs: list[np.ndarray], ys: list[np.ndarray], h: int) -> np.ndarray:
    """Edit distances as far as they're at most h (else something larger), of several pairs at once, within h of the diagonal."""
    far = np.int32(1 << 29)
    n, m = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    rows = int(n.max())
    width = 2 * h + 1
    X = np.zeros((len(xs), rows), np.uint64)
    Y = np.zeros((len(ys), max(rows, int(m.max())) + width + h + 1), np.uint64)
    for p, (x, y) in enumerate(zip(xs, ys)):
        X[p, : len(x)] = x
        Y[p, h : h + len(y)] = y  # column j - 1 is at h + j - 1
    c = np.arange(width, dtype=np.int32)
    previous = np.tile(np.where(c >= h, c - h, far).astype(np.int32), (len(xs), 1))
    out = np.full(len(xs), far, np.int64)
    end = m - n + h  # within the band, or farther apart than h
    inside = (end >= 0) & (end < width)
    done = inside & (n == 0)
    out[done] = previous[done, end[done]]
    for i in range(1, rows + 1):
        now = previous + (Y[:, i - 1 : i - 1 + width] != X[:, i - 1 : i])
        np.minimum(now[:, :-1], previous[:, 1:] + 1, out=now[:, :-1])
        if i <= h:
            now[:, : h - i] = far
            now[:, h - i] = i
        now = (np.minimum.accumulate(now - c, axis=1) + c).astype(np.int32)
        done = np.flatnonzero(inside & (n == i))
        if len(done):
            out[done] = now[done, end[done]]
        previous = now
    return out


def similar(xs: list[np.ndarray], ys: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each pair of token sequences has the similarity. Bands widen until they decide."""
    ok = np.zeros(len(xs), bool)
    most = np.array([int(np.floor((1 - similarity) * max(len(x), len(y)) + 1e-9)) for x, y in zip(xs, ys)], np.int64)
    left = []
    short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    least: dict[int, int] = {}
    for p, (x, y) in enumerate(zip(xs, ys)):
        if abs(len(x) - len(y)) > most[p]:
            continue
        x, y = strip_common(x, y)
        if not len(x) or not len(y):
            ok[p] = max(len(x), len(y)) <= most[p]
        elif (d := bag_distance(x, y)) <= most[p]:
            short[p], least[p] = (x, y), d
            left.append(p)
    h = 16
    while left:
        again = [p for p in left if least[p] > h]
        left = sorted((p for p in left if least[p] <= h), key=lambda p: len(short[p][0]))
        size = max(1, (1 << 15) // (2 * h + 1))
        for k in range(0, len(left), size):
            own = left[k : k + size]
            d = band([short[p][0] for p in own], [short[p][1] for p in own], h)
            for p, far in zip(own, d):
                if far <= h:
                    ok[p] = far <= most[p]
                elif h < most[p]:
                    again.append(p)
        left, h = again, min(4 * h, max([most[p] for p in again], default=h))
    return ok


def texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the wanted (id, whole), from a pass that a filter of fixed size thins out before the join."""
    slots = wanted.select(F.col("id").bitwiseAND((1 << FILTER_BITS) - 1).cast("int").alias("slot")).distinct().toArrow()
    some = np.zeros(1 << FILTER_BITS, bool)
    some[slots["slot"].to_numpy()] = True

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(some[batch.column("doc_id").to_numpy() & ((1 << FILTER_BITS) - 1)]))
            for part in K_.chunks(batch):
                whole = sequence_hash(K_.tokenise(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), pa.array(whole.view(np.int64)), part.column("text")], ["id", "whole", "text"])

    found = documents.mapInArrow(run, "id long, whole long, text string")
    return found.join(wanted, ["id", "whole"], "left_semi").dropDuplicates(["id"]).select("id", "text")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def run(batches):
        for batch in batches:
            sides = batch.select(["a", "b"])
            length = np.maximum(*(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y")))
            cuts = np.flatnonzero(np.diff(np.cumsum(length) // K_.CHUNK_BYTES)) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [batch.num_rows]])):
                if hi > lo:
                    x, y = (K_.tokenise(batch.column(c).slice(lo, hi - lo)) for c in ("x", "y"))
                    ok = similar(*([t.h[t.first[p] : t.first[p + 1]] for p in range(hi - lo)] for t in (x, y)), similarity)
                    yield sides.slice(lo, hi - lo).filter(pa.array(ok))

    x, y = (texts.select(F.col("id").alias(a), F.col("text").alias(b)) for a, b in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def rarest(t: K_.Tokens, level: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each text): of each text one token more than it may lose, those of the lowest level, by number of occurrence."""
    size = np.diff(t.first)
    own, _ = sequences(t, 1)
    order = np.lexsort((own, level[(t.h & np.uint64((1 << RARE_BITS) - 1)).astype(np.int64)], t.doc))
    n = np.minimum(size, np.floor((1 - similarity) * size + 1e-9).astype(np.int64) + 1)
    return own[order[K_.ragged(t.first[:-1], n)]], np.append(0, np.cumsum(n))


def rare_tokens(texts: DataFrame, similarity: float) -> DataFrame:
    """(id, tokens) of (id, text): of each text so many of its rarest tokens that similar ones share one of theirs."""
    slots = 1 << RARE_BITS

    def count(batches):
        for batch in batches:
            for part in K_.chunks(batch):
                slot, n = np.unique((K_.tokenise(part.column("text")).h & np.uint64(slots - 1)).astype(np.int32), return_counts=True)
                yield pa.record_batch([pa.array(slot), pa.array(n)], ["slot", "n"])

    counted = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(slots, np.uint8)
    level[counted["slot"].to_numpy()] = np.log2(counted["n"].to_numpy()) * 6

    def run(batches):
        for batch in batches:
            for part in K_.chunks(batch):
                own, first = rarest(K_.tokenise(part.column("text")), level, similarity)
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(own.view(np.int64)))], ["id", "tokens"])

    return texts.mapInArrow(run, "id long, tokens array<long>")


def outside(seen: DataFrame) -> DataFrame:
    """(key, main, strays) of the keys whose members (key, id, root) have several roots: the commonest, and how many members have others."""
    own = seen.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("top"))
    return own.where("m > top.n").select("key", F.col("top.root").alias("main"), (F.col("m") - F.col("top.n")).alias("strays"))


def across(seen: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: members (key, id, size, root, main) of a key with different roots and near sizes. Those of the commonest root don't meet each other."""
    x, y = (seen.select("key", "main", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "size", "root"))) for side in "xy")
    pairs = x.where("root_x <> main").join(y.drop("main"), "key").where("root_x <> root_y and (root_y = main or id_x < id_y)")
    pairs = pairs.where(f"least(size_x, size_y) >= {similarity} * greatest(size_x, size_y)")
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def groups(documents: DataFrame, similarity: float = SIMILARITY, k: int = K, length: int = LENGTH, count: int = SKETCHES) -> DataFrame:
    """(doc_id, group_id) of every document in a group of two or more; group_id is the group's smallest id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    docs = docs.withColumn("pick", F.xxhash64("text"))
    signed = cut(signatures(docs, k, length, count))
    one = signed.groupBy("doc_id").agg(F.min(F.struct("pick", "whole", "size", "sketches", "bag")).alias("s")).select("doc_id", "s.*")
    same = cut(one.groupBy("whole").agg(F.min(F.struct("doc_id", "size", "sketches", "bag")).alias("r"), F.count("*").alias("n")))
    keyed = same.select(F.struct(F.col("r.doc_id").alias("id"), F.col("r.size").alias("size"), "whole").alias("d"), F.explode("r.sketches").alias("key"))
    marks = [F.bit_xor(F.xxhash64("d.id", F.lit(seed))).alias(f"x{seed}") for seed in (0, 1)]
    keys = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("d").alias("p"), *marks).where("m > 1")
    # equal sets of members, as near-equal copies have, count once; they're known by their number, smallest member and 128 bits of hash
    keys = keys.groupBy("m", "p", "x0", "x1").agg(F.min("key").alias("key")).select("key", "p")
    members = cut(keyed.join(keys, "key").select("key", "p", F.col("d").alias("q")))
    bagged = same.select(F.col("r.doc_id").alias("id"), F.col("r.bag").alias("bag"))

    def near(a: str, b: str):
        return F.expr(f"least({a}.size, {b}.size) >= {similarity} * greatest({a}.size, {b}.size)")

    stars = members.where("p.id <> q.id").where(near("p", "q")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    stars = cut(plausible(stars, bagged, similarity))
    named = same.select(F.col("r.doc_id").alias("id"), "whole")

    def checked(pairs: DataFrame) -> DataFrame:
        """The similar ones of plausible pairs; only their texts are fetched."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(named, "id")
        return cut(verified(pairs, cut(texts_of(docs, wanted)), similarity))

    links = checked(stars)
    roots = components(links)

    # the pairs of a bucket that the first comparisons leave apart
    seen = members.select("key", "q.*").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "size", "whole", F.coalesce("root", "id").alias("root"))
    seen = cut(seen.join(outside(seen), "key"))
    rest = across(seen.where(F.col("strays") <= FEW), similarity)
    many = seen.where(F.col("strays") > FEW)
    if not many.isEmpty():
        rare = rare_tokens(cut(texts_of(docs, many.select("id", "whole").distinct())), similarity)
        spread = many.join(rare, "id").select("key", "id", "size", "root", F.explode("tokens").alias("token"))
        spread = spread.select(F.xxhash64("key", "token").alias("key"), "id", "size", "root")
        rest = rest.union(across(spread.join(outside(spread), "key"), similarity)).distinct()
    rest = rest.join(stars, ["a", "b"], "left_anti")
    more = checked(cut(plausible(rest, bagged, similarity)))
    if not more.isEmpty():
        roots = components(links.union(more))
    ids = signed.groupBy("doc_id").agg(F.min(F.struct("pick", "whole")).alias("s")).select("doc_id", "s.whole")
    copies = ids.join(same.select("whole", F.col("r.doc_id").alias("of"), "n"), "whole")
    linked = copies.join(roots, F.col("of") == F.col("node"), "left").where("root is not null or n > 1")
    return linked.select("doc_id", F.coalesce("root", "of").alias("group_id"))


def drop_copies(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, but of each group only the one with the smallest id, and of rows with the same id the one that counts (without tokens in any: that whose hash is smallest)."""
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    rows = documents.select(whole.alias("r"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    extra = groups(documents, similarity).where("doc_id <> group_id").select(F.col("doc_id").alias("id"))
    left = rows.join(extra, "id", "left_anti")
    again = rows.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    if not again.isEmpty():
        order = F.struct(~F.coalesce(F.lower("text").rlike(TOKEN), F.lit(False)), F.xxhash64("text"), F.xxhash64(F.to_json("r")))
        repeated = left.join(again, "id", "left_semi").groupBy("id").agg(F.min_by("r", order).alias("r"))
        left = left.join(again, "id", "left_anti").select("r").union(repeated.select("r"))
    return left.select(*(F.col("r").getField(c).alias(c) for c in documents.columns))
