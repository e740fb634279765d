"""Line deduplication as an exact set-similarity self-join.

A line is the set of its tokens. It's removed if any line at an earlier place in
the corpus, places being ordered by (doc_id, line number, row), has a Jaccard
similarity of at least THRESHOLD with it; equal lines included, whether or not
the earlier line is itself removed. So the result depends neither on the order
of processing nor on the partitions.

1. A pass counts tokens into 2**RARITY_BITS counters: a total order of all tokens
   by rarity, of fixed size. (Any total order keeps the prefix filter exact;
   rarity only makes it sharp.)
2. A pass gives each line's set hash, place and, of its first n - ceil(tn) + 1
   tokens in that order, a record with size, position and parities of the set, the
   more of them the larger it is. Records are packed, routed by token and never
   hold the text. Of equal sets, a task passes on one record, so a line
   that's everywhere isn't a hot key.
3. Per token, records meet: equal sets collapse to their first place; others
   become candidates if they pass the length, prefix, positional and parity
   filters, all of which are exact.
4. A pass gathers the first places and the tokens of the sets that are candidates.
   These are verified on their tokens, the earliest partner of each line first,
   the rest only for lines that it doesn't decide.

Tokens and sets are told apart by 64-bit hashes.

Defined results: null texts and lines without tokens are never removed. Every
row has its own places: rows without id, and rows that share an id, are told
apart by a hash of their text. Only rows equal in id and text are one place, so
they don't remove each other's lines; of equal rows without id all but one, whose
hash is smallest, are copies of it. Null ids come last and come out as null. Very
long lines are lines like any other. Other columns are ignored by
``repeated_lines`` and kept unchanged by ``strip_lines``, but for n_chars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernels as K
from factloom.session import cut

#: The Jaccard threshold as a fraction.
THRESHOLD = (4, 5)
RARITY_BITS = 17
#: The filter of the verifying pass; when it's full, it lets more lines through, which the join then drops.
FILTER_BITS = 22
#: Bytes of records that a task gathers before it passes them on.
FLUSH_BYTES = 24 << 20

TOKEN = "[0-9a-z\\x{80}-\\x{10FFFF}]"
NO_ID = np.iinfo(np.int64).max
#: Lines of at most so many tokens have records with so many words of 64 parities; more tokens would fill fewer parities up.
PARITIES = ((40, 1), (128, 2), (np.iinfo(np.int64).max, 8))
PREFIX = tuple(np.dtype([("token", "<u4"), ("set", "<u8"), ("n", "u1" if most < 256 else "<u4"), ("i", "u1" if most < 256 else "<u4"), ("odd", "<u8", words)]) for most, words in PARITIES)
PLACE = np.dtype([("set", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("row", "<i8")])
FOUND = "kind int, a long, b long, line int, row long"
DUPLICATE, CANDIDATE = 0, 1
#: Kinds of packed records: places by set, repeated places, then prefix tokens by the lines' size.
KINDS = (PLACE, PLACE, *PREFIX)


def ceil_of(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-n * num // den)


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)


class Lines:
    """The lines of several texts that have tokens, each with its distinct tokens in order of rarity."""

    def __init__(self, texts: pa.Array, rank: np.ndarray | None):
        t = K.tokenise(texts)
        newlines = np.zeros(len(t.raw) + 1, np.int64)
        np.cumsum(t.raw == 10, out=newlines[1:])
        line = newlines[t.start] + t.doc  # each text begins another line
        bucket = (t.h >> np.uint64(64 - RARITY_BITS)).astype(np.int64)
        major = bucket if rank is None else rank[bucket]
        order = self._order(line, major, t.h)
        line, h = line[order], t.h[order]
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        order, line, self.h = order[new], line[new], h[new]
        begins = np.ones(len(line), bool)
        begins[1:] = line[1:] != line[:-1]
        self.first = np.append(np.flatnonzero(begins), len(line))
        self.n = np.diff(self.first)
        head = order[self.first[:-1]]
        self.doc = t.doc[head]
        self.line = (newlines[t.start[head]] - newlines[t.offsets[self.doc]]).astype(np.int32)
        at = self.first[:-1]
        if len(at):
            self.set = K.mix(np.add.reduceat(K.mix(self.h + np.uint64(1)), at) + self.n.astype(np.uint64))
        else:
            self.set = np.zeros(0, np.uint64)

    @staticmethod
    def _order(line: np.ndarray, major: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Order by (line, rarity, hash)."""
        n = len(h)
        if not n:
            return np.zeros(0, np.int64)
        low, high = n.bit_length(), int(line[-1]).bit_length()
        if low + high + RARITY_BITS > 63:
            return np.lexsort((h, major, line))
        key = np.sort((line << (low + RARITY_BITS)) | (major << low) | np.arange(n))
        order = key & ((1 << low) - 1)
        key >>= low
        same = np.zeros(n, bool)
        same[1:] = (key[1:] == key[:-1]) & (h[order[1:]] != h[order[:-1]])
        if same.any():  # several tokens of a line in one counter: order them by hash
            runs = np.isin(key, key[same])
            own = order[runs]
            order[runs] = own[np.lexsort((h[own], key[runs]))]
        return order


def rarity(documents: DataFrame) -> np.ndarray:
    """Rank of each counter, rarest first: fixed in size, whatever the corpus."""

    def count(batches):
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for part in K.chunks(batch):
                h = K.tokenise(part.column("text")).h
                total += np.bincount((h >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counts = documents.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << RARITY_BITS, np.int64)
    total[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(total, kind="stable")] = np.arange(len(total))
    return rank


def packed(records: np.ndarray, part: np.ndarray, kind: int):
    """A row (partition, kind, bytes) for each partition."""
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for own, where in zip(np.split(records, cuts), part[np.concatenate([[0], cuts])] if len(part) else ()):
        yield int(where), kind, own.tobytes()


def squeezed(records: np.ndarray, part: np.ndarray, kind: int):
    """As packed, with the records' bytes in planes and compressed: sorted tokens and small numbers then take little."""
    for where, _, data in packed(records, part, kind):
        planes = np.frombuffer(data, np.uint8).reshape(-1, records.dtype.itemsize).T
        yield where, kind, len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def expanded(blob: pa.Buffer, dtype: np.dtype) -> np.ndarray:
    size = int.from_bytes(blob[:8].to_pybytes(), "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], size), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def distinct(records, order: np.ndarray) -> np.ndarray:
    """The order without records whose token and set are as before."""
    token, name = records["token"][order], records["set"][order]
    new = np.ones(len(order), bool)
    new[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
    return order[new]


def different(places: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (places["doc"] != others["doc"]) | (places["line"] != others["line"]) | (places["row"] != others["row"])


def sketch(parts: int, rank: np.ndarray, num: int, den: int):
    """The second pass: packed records of lines and of prefix tokens."""

    def flush(places: list, prefixes: list):
        rows = []
        if places:
            all_ = np.concatenate(places)
            all_ = all_[np.lexsort((all_["row"], all_["line"], all_["doc"], all_["set"]))]
            new = np.ones(len(all_), bool)
            new[1:] = all_["set"][1:] != all_["set"][:-1]
            later = all_[~new & different(all_, all_[np.flatnonzero(new)[np.cumsum(new) - 1]])]
            rows += squeezed(all_[new], (all_["set"][new] % np.uint64(parts)).astype(np.int64), 0)
            rows += squeezed(later, (K.mix(later["doc"].view(np.uint64)) % np.uint64(parts)).astype(np.int64), 1)
        for kind, dtype in enumerate(PREFIX, 2):
            own = [x for x in prefixes if x.dtype == dtype]
            if own:
                all_ = np.concatenate(own)
                all_ = all_[distinct(all_, np.lexsort((all_["set"], all_["token"])))]
                rows += squeezed(all_, (all_["token"] % np.uint32(parts)).astype(np.int64), kind)
        places.clear(), prefixes.clear()
        for part, kind, data in rows:
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["part", "kind", "data"])

    def run(batches):
        places: list[np.ndarray] = []
        prefixes: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for chunk in K.chunks(batch):
                lines = Lines(chunk.column("text"), rank)
                place = np.empty(len(lines.n), PLACE)
                place["set"], place["doc"], place["line"] = lines.set, ids_of(chunk)[lines.doc], lines.line
                place["row"] = chunk.column("row").to_numpy()[lines.doc]
                places.append(place)
                at = lines.first[:-1]
                keep = lines.n - ceil_of(lines.n, num, den) + 1
                keep[(ceil_of(lines.n, num, den) >= lines.n) & (lines.n * den // num <= lines.n)] = 0  # so small that only equal sets match
                for (_, words), dtype, of in zip(PARITIES, PREFIX, np.split(np.argsort(lines.n, kind="stable"), np.searchsorted(np.sort(lines.n), [m for m, _ in PARITIES[:-1]], side="right"))):
                    of = of[keep[of] > 0]
                    if not len(of):
                        continue
                    odd = parities(lines, of, words)
                    which = np.repeat(np.arange(len(of)), keep[of])
                    token = K.ragged(at[of], keep[of])
                    line = of[which]
                    prefix = np.empty(len(token), dtype)
                    prefix["token"] = (lines.h[token] >> np.uint64(8)).astype(np.uint32)
                    prefix["set"], prefix["n"], prefix["i"] = lines.set[line], lines.n[line], token - at[line]
                    prefix["odd"] = odd[which]
                    prefixes.append(prefix)
                    size += prefix.nbytes
                size += place.nbytes
                if size > FLUSH_BYTES:
                    yield from flush(places, prefixes)
                    size = 0
        yield from flush(places, prefixes)

    return run


def parities(lines: Lines, of: np.ndarray, words: int) -> np.ndarray:
    """For each of the lines, of so many times 64 bits, whether an odd number of its tokens have that bit."""
    h = lines.h[K.ragged(lines.first[of], lines.n[of])]
    at = np.cumsum(lines.n[of]) - lines.n[of]
    one = np.uint64(1) << (h & np.uint64(63))
    word = (h >> np.uint64(6)) & np.uint64(words - 1)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == np.uint64(w), one, np.uint64(0)), at) for w in range(words)], axis=1)


def folded(odd: np.ndarray, words: int) -> np.ndarray:
    """Parities of fewer bits, from those of more."""
    odd = odd.reshape(len(odd), odd.shape[1] // words, words)
    return np.bitwise_xor.reduce(odd, axis=1)


def candidates(kinds: list[np.ndarray], num: int, den: int):
    """Pairs of sets that share a prefix token and pass all filters. kinds: records by the lines' size."""
    columns = {c: np.concatenate([k[c].astype(t) for k in kinds]) for c, t in (("token", np.uint32), ("set", np.uint64), ("n", np.int64), ("i", np.int64))}
    order = distinct(columns, np.lexsort((columns["set"], columns["n"], columns["token"])))
    token, size, at, name = (columns[c][order] for c in ("token", "n", "i", "set"))
    odd = [k["odd"].reshape(len(k), words) for k, (_, words) in zip(kinds, PARITIES)]
    levels = []  # of each number of words: where the records that have them begin, and their parities
    begin = 0
    for level, (_, words) in enumerate(PARITIES):
        levels.append((begin, np.concatenate([folded(x, words) for x in odd[level:]])))
        begin += len(odd[level])
    del odd, columns
    short = at <= size - ceil_of(size, 2 * num, num + den)  # prefix of the smaller side
    live = np.arange(len(order))
    step = 0
    while len(live):
        step += 1
        live = live[live + step < len(order)]
        j = live + step
        live = live[(token[live] == token[j]) & (size[live] * den >= size[j] * num)]  # sizes ascend within a token
        i = live[short[live]]
        j = i + step
        need = ceil_of(size[i] + size[j], num, num + den)
        ok = np.minimum(at[i], at[j]) + 1 + np.minimum(size[i] - at[i], size[j] - at[j]) - 1 >= need
        i, j, need = i[ok], j[ok], need[ok]
        # a token that only one side has flips a parity: there are as many such tokens at least
        most = size[i] + size[j] - 2 * need
        for begin, odd in levels:
            a, b = order[i] - begin, order[j] - begin
            both = np.flatnonzero((a >= 0) & (b >= 0))
            far = np.bitwise_count(odd[a[both]] ^ odd[b[both]]).sum(axis=1, dtype=np.int64) > most[both]
            ok = np.ones(len(i), bool)
            ok[both[far]] = False
            i, j, most = i[ok], j[ok], most[ok]
        if len(i):
            yield np.minimum(name[i], name[j]), np.maximum(name[i], name[j])


PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def meet(parts: int, num: int, den: int):
    """The third pass, per partition of tokens and sets: packed places of repeated lines, and packed candidate pairs, which are routed by the pair."""

    def pairs(found: list):
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        out = np.empty(both.shape[1], PAIR)
        out["a"], out["b"] = both
        return packed(out, (K.mix(out["a"] ^ K.mix(out["b"])) % np.uint64(parts)).astype(np.int64), CANDIDATE)

    def repeated(places: np.ndarray):
        return packed(places, (K.mix(places["doc"].view(np.uint64)) % np.uint64(parts)).astype(np.int64), DUPLICATE)

    def sent(rows):
        for part, kind, data in rows:
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["part", "kind", "data"])

    def run(batches):
        data: tuple[list, ...] = tuple([] for _ in KINDS)
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("data")):
                data[kind].append(expanded(blob.as_buffer(), KINDS[kind]))
        if data[0]:
            places = np.concatenate(data[0])
            places = places[np.lexsort((places["row"], places["line"], places["doc"], places["set"]))]
            new = np.ones(len(places), bool)
            new[1:] = places["set"][1:] != places["set"][:-1]
            lead = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
            yield from sent(repeated(places[different(places, lead)]))
            del places, lead
        for places in data[1]:
            yield from sent(repeated(places))
        if any(data[2:]):
            kinds = [np.concatenate([*own, np.zeros(0, dtype)]) for own, dtype in zip(data[2:], PREFIX)]
            for own in data:
                own.clear()
            held: list = []
            size = 0
            for a, b in candidates(kinds, num, den):
                held.append(np.stack([a, b]))
                size += len(a)
                if size > 1 << 20:
                    held = [np.unique(np.concatenate(held, axis=1), axis=1)]
                    size = 0
                    if held[0].shape[1] > 1 << 20:
                        yield from sent(pairs(held))
                        held = []
            if held:
                yield from sent(pairs(held))

    return run


def unite(batches):
    """(kind, a, b, line, row): each place of a repeated line, and each pair, once."""
    own: tuple[list, list] = ([], [])
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("data")):
            own[kind].append(np.frombuffer(blob.as_buffer(), (PLACE, PAIR)[kind]).copy())
    for kind, lists in enumerate(own):
        if not lists:
            continue
        all_ = np.concatenate(lists)
        names = ("doc", "line", "row") if kind == DUPLICATE else ("a", "b")
        all_ = all_[np.lexsort([all_[c] for c in names])]
        new = np.zeros(len(all_), bool)
        new[:1] = True
        for c in names:
            new[1:] |= all_[c][1:] != all_[c][:-1]
        all_ = all_[new]
        for k in range(0, len(all_), 1 << 17):
            x = all_[k : k + (1 << 17)]
            none = np.zeros(len(x), np.int64)
            columns = [x["doc"], none, x["line"], x["row"]] if kind == DUPLICATE else [x["a"].view(np.int64), x["b"].view(np.int64), none.astype(np.int32), none]
            yield pa.record_batch([pa.array(np.full(len(x), kind, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["kind", "a", "b", "line", "row"])


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Which of 2**FILTER_BITS slots the column's values fall into: of fixed size."""
    slots = ids.select((F.col(column).bitwiseAND((1 << FILTER_BITS) - 1)).cast("int").alias("slot")).distinct().toArrow()
    out = np.zeros(1 << FILTER_BITS, bool)
    out[slots["slot"].to_numpy()] = True
    return out


def firsts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, place, tokens) of the wanted sets: their first places and sorted tokens, from a pass that a filter of fixed size thins out before the join."""
    some = bitmap(wanted, "set")
    low = (1 << FILTER_BITS) - 1

    def run(batches):
        for batch in batches:
            for chunk in K.chunks(batch):
                lines = Lines(chunk.column("text"), None)
                doc, row = ids_of(chunk)[lines.doc], chunk.column("row").to_numpy()[lines.doc]
                own = np.flatnonzero(some[(lines.set & np.uint64(low)).astype(np.int64)])
                own = own[np.lexsort((row[own], lines.line[own], doc[own], lines.set[own]))]
                new = np.ones(len(own), bool)
                new[1:] = lines.set[own[1:]] != lines.set[own[:-1]]
                own = own[new]
                if len(own):
                    blobs = [np.sort(lines.h[lines.first[i] : lines.first[i + 1]]).tobytes() for i in own]
                    yield pa.record_batch([pa.array(lines.set[own].view(np.int64)), pa.array(doc[own]), pa.array(lines.line[own]), pa.array(row[own]), pa.array(blobs, pa.binary())], ["set", "doc", "line", "row", "tokens"])

    found = documents.mapInArrow(run, "set long, doc long, line int, row long, tokens binary")
    own = found.join(wanted, "set", "left_semi").groupBy("set").agg(F.min(F.struct("doc", "line", "row", "tokens")).alias("f"))
    return own.select("set", F.struct("f.doc", "f.line", "f.row").alias("place"), F.col("f.tokens").alias("tokens"))


def verified(pairs: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (early, late) whose sets reach the threshold."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                ok[k] = shared * den >= num * (len(both) - shared)
            yield batch.select(["early", "late"]).filter(pa.array(ok))

    x, y = (tokens.select(F.col("at").alias(a), F.col("tokens").alias(b)) for a, b in (("early", "x"), ("late", "y")))
    return pairs.select("early", "late").join(x, "early").join(y, "late").select("early", "late", "x", "y").mapInArrow(run, "early long, late long")


def row_key(documents: DataFrame) -> Column:
    """What tells rows without id, and rows with the same id, apart; 0 where the id does."""
    again = documents.where("doc_id is not null").groupBy(F.col("doc_id").cast("long")).count().where("count > 1")
    text = F.xxhash64(F.col("text").cast("string"))
    return F.when(F.col("doc_id").cast("long").isNull(), text).otherwise(F.lit(0).cast("long")) if again.isEmpty() else text


def repeated_places(documents: DataFrame, key: Column, threshold: tuple[int, int]) -> DataFrame:
    """(doc_id, row, line_no): the repeated lines' places, row being the key; rows equal in id and text are one."""
    num, den = threshold
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("row")).where("text is not null")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    packed_ = docs.mapInArrow(sketch(parts, rarity(docs), num, den), "part int, kind int, data binary")
    met = packed_.repartitionById(parts, F.col("part")).select("kind", "data").mapInArrow(meet(parts, num, den), "part int, kind int, data binary")
    found = cut(met.repartitionById(parts, F.col("part")).select("kind", "data").mapInArrow(unite, FOUND))

    pairs = found.where(F.col("kind") == CANDIDATE).select("a", "b")
    firsts = firsts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct())
    # numbers in the order of the places: what is joined below is narrow
    firsts = cut(firsts.repartitionByRange("place").sortWithinPartitions("place").withColumn("at", F.monotonically_increasing_id()))
    for side in ("a", "b"):
        pairs = pairs.join(firsts.select(F.col("set").alias(side), F.col("at").alias(f"{side}_at")), side).drop(side)
    pairs = cut(pairs.select(F.least("a_at", "b_at").alias("early"), F.greatest("a_at", "b_at").alias("late")))
    tokens = firsts.select("at", "tokens")

    nearest = pairs.groupBy("late").agg(F.min("early").alias("early"))
    sure = cut(verified(nearest, tokens, num, den))
    open_ = pairs.join(nearest, ["early", "late"], "left_anti").join(sure.select("late"), "late", "left_anti")
    removed = sure.select("late").union(verified(open_, tokens, num, den).select("late")).distinct()
    near = firsts.join(removed, firsts["at"] == removed["late"], "left_semi").select("place.doc", "place.line", "place.row")
    same = found.where(F.col("kind") == DUPLICATE).select(F.col("a").alias("doc"), "line", "row")
    return same.union(near).distinct().select(F.when(F.col("doc") != int(NO_ID), F.col("doc")).alias("doc_id"), "row", F.col("line").alias("line_no"))


def repeated_lines(documents: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, line_no): all lines, counted from 0, that repeat an earlier line; once for each place."""
    removed = repeated_places(documents, row_key(documents), threshold).select("doc_id", "line_no")
    copies = documents.where("doc_id is null and text is not null").groupBy("text").count().where("count > 1")
    if copies.isEmpty():
        return removed
    lines = copies.select("count", F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line")).where(F.lower("line").rlike(TOKEN))
    return removed.union(lines.select(F.lit(None).cast("long"), "line_no", F.explode(F.sequence(F.lit(2), "count"))).select(F.lit(None).cast("long"), "line_no"))


def strip_lines(documents: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The documents without their repeated lines.

    A document all of whose lines with tokens are removed says nothing new and is
    dropped; one that had none is kept as it is. n_chars, if there, follows the text.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    rows = documents.select(whole.alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not rows.where("doc_id is null").isEmpty():
        named = F.col("doc_id").isNotNull() | F.col("text").isNull() | ~F.lower("text").rlike(TOKEN)
        first = F.min_by("r", F.xxhash64(F.to_json("r"))).alias("r")
        rows = rows.where(named).unionByName(rows.where(~named).groupBy("text").agg(first).select("r", F.lit(None).cast("long").alias("doc_id"), "text"))
    key = row_key(rows)
    removed = repeated_places(rows, key, threshold).groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone"))
    removed = removed.select(F.col("doc_id").alias("doc"), F.col("row"), "gone")
    joined = rows.withColumn("key", key).join(removed, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("row")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i)), "\n")
    joined = joined.select("r", "gone", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"))

    def column(c: str) -> Column:
        was = F.col("r").getField(c)
        if c == "text":
            return F.when(F.col("gone").isNull(), was).otherwise(F.col("kept").cast(documents.schema[c].dataType)).alias(c)
        if c == "n_chars":
            return F.when(F.col("gone").isNull(), was).otherwise(F.length("kept").cast(documents.schema[c].dataType)).alias(c)
        return was.alias(c)

    return joined.where(F.col("gone").isNull() | F.lower("kept").rlike(TOKEN)).select(*map(column, documents.columns))


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(line), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> ''))"
#: The same lines by a prefix join on strings, verified on all tokens.
LINES_SQL = f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
t AS (SELECT doc_id, line_no, list_sort({_TOKENS}) AS s FROM l),
p AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM t WHERE len(s) > 0),
u AS (SELECT s, min(place) AS place FROM p GROUP BY s),
x AS (SELECT place, unnest(s) AS w FROM u),
f AS (SELECT w, count(*) AS df FROM x GROUP BY w),
r AS (SELECT place, w, row_number() OVER (PARTITION BY place ORDER BY df, w) AS i, count(*) OVER (PARTITION BY place) AS n FROM x JOIN f USING (w)),
k AS (SELECT place, w, n FROM r WHERE i <= n - CAST(ceil(n * {THRESHOLD[0]} / {THRESHOLD[1]}.0) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.place AS early, b.place AS late FROM k a JOIN k b ON a.w = b.w AND a.place < b.place AND least(a.n, b.n) * {THRESHOLD[1]} >= greatest(a.n, b.n) * {THRESHOLD[0]}),
v AS (SELECT DISTINCT late FROM c JOIN u a ON a.place = early JOIN u b ON b.place = late
      WHERE len(list_intersect(a.s, b.s)) * {sum(THRESHOLD)} >= {THRESHOLD[0]} * (len(a.s) + len(b.s)))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM p JOIN u USING (s) WHERE p.place > u.place OR u.place IN (SELECT late FROM v)
"""
