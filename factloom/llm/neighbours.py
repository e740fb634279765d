"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector by several Gaussian projections, made
orthogonal within a table, shifted and cut into cells of WIDTH standard
deviations. The queries are the rows whose id is divisible by EVERY, searched for
among all rows. A query visits buckets in the order of estimated success: by the
sum, over the projections, of the logarithm of the probability that a near row
falls into the cell, less BALANCE times that for any row (a bucket that holds
much of everything costs more). The best buckets by such a sum are found exactly,
projection by projection. The candidates of all tables are merged and ranked by
exact distance.

The number of projections follows the rows (about 4 rows for each of 2**hashes
buckets), that of visited buckets is 2**(GROWTH * hashes), so the share of rows
that a query looks at falls as rows are added. The index is fitted on the SAMPLE
rows whose ids have the smallest hashes: means and deviations of the
projections, how near neighbours are, which buckets are hot. All rows are
indexed.

Rows travel packed to the partitions of their buckets; of equal vectors each task
sends on those of the k + 1 smallest ids, and the rows of a hot bucket are spread
over several partitions by id. A partition holds its rows and lets the queries
pass by in portions. A bucket's distances are one matrix product in single
precision, and every row that its rounding may put among the k nearest ids is
ranked by exact distance.

Defined results: rows whose vector is null, has nulls or isn't finite, or has
another length than most, and rows without id, are neither queries nor
neighbours. A row isn't its own neighbour, nor is another row with the same id;
repeated ids count once as neighbours, at their smallest distance, and as
queries at the smallest of their rows' distances. Equal distances go by id. A
query whose buckets held less than k others is searched for among all rows, so
there are less than k neighbours only with less than k others. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernels as K_
from factloom.llm.linededup import packed
from factloom.session import cut

K = 10
EVERY = 20
TABLES = 4
WIDTH = 3.0
BALANCE = 0.7
GROWTH = 0.72
SAMPLE = 2000
#: Cells of a projection, the outermost ones open.
CELLS = 6
#: Queries searched for in one pass over all rows, where their buckets hold too little.
BLOCK = 4096
#: Bytes of queries and visits that a partition searches for at once.
PORTION = 48 << 20
SEED = 20240229


def vectors(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.where(F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf'))"))


def matrix(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, size)


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 3 digits."""
    return 0.5 * (1 + np.tanh(0.7978845608 * (x + 0.044715 * x**3)))


class Index:
    """Projections, cells and visits. sample: rows that the index is fitted on; rows: how many are indexed."""

    def __init__(self, sample: np.ndarray, rows: int, hashes: int, tables: int, probes: int, parts: int):
        size = sample.shape[1]
        rng = np.random.default_rng(SEED)
        self.hashes = hashes or int(np.clip(round(np.log2(max(rows, 2))) - 2, 2, min(30, size)))
        self.probes = probes or int(np.ceil(2 ** (GROWTH * self.hashes)))
        _, one = np.unique(sample, axis=0, return_index=True)  # copies tell nothing of the others' spread
        self.centre = sample[one].mean(axis=0)
        own = sample[one] - self.centre
        self.scale = float(np.sqrt((own * own).sum(axis=1).mean())) or 1.0
        self.a = [np.linalg.qr(rng.normal(size=(size, min(self.hashes, size))))[0] for _ in range(tables)]
        self.b = rng.uniform(0, 1, (tables, self.hashes))
        self.deviation = [np.maximum((own @ a).std(axis=0), 1e-9 * self.scale) for a in self.a]
        self.edges = (np.arange(CELLS + 1) - CELLS // 2)[None, None] - self.b[:, :, None]
        self.edges = self.edges * WIDTH
        self.edges[:, :, 0], self.edges[:, :, -1] = -40, 40
        self.near = self.nearness(own)
        width = np.maximum(normal(self.edges[:, :, 1:]) - normal(self.edges[:, :, :-1]), 1e-9)
        self.cost = BALANCE * np.log(width)
        #: hot buckets and over how many partitions each is spread
        self.hot, self.spread = [], []
        for t in range(tables):
            names, count = np.unique(self.bucket(self.cells(sample, t), t), return_counts=True)
            wide = count * parts > 2 * max(1, len(sample)) if len(sample) >= 100 else np.zeros(len(count), bool)
            self.hot.append(names[wide])
            self.spread.append(np.ceil(count[wide] / max(1, len(sample)) * parts).astype(np.int64))

    def nearness(self, own: np.ndarray) -> float:
        """The correlation of a row with its nearest in the sample, such as three in four rows reach."""
        if len(own) < 3:
            return 0.5
        few = own[np.random.default_rng(SEED).permutation(len(own))[: 1 << 9]]
        d = (few * few).sum(axis=1)[:, None] + (own * own).sum(axis=1)[None] - 2 * few @ own.T
        least = np.partition(d, 1, axis=1)[:, 1]
        return float(np.clip(1 - np.quantile(least, 0.75) / (2 * self.scale**2), 0.3, 0.98))

    def places(self, v: np.ndarray, table: int) -> np.ndarray:
        return (v.astype(np.float64) - self.centre) @ self.a[table] / self.deviation[table]

    def cells(self, v: np.ndarray, table: int) -> np.ndarray:
        return np.clip(np.floor(self.places(v, table) / WIDTH + self.b[table]) + CELLS // 2, 0, CELLS - 1).astype(np.int64)

    def bucket(self, cells: np.ndarray, table: int) -> np.ndarray:
        h = np.full(len(cells), table + 1, np.uint64)
        for c in cells.T:
            h = h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
        return K_.mix(h)

    def visits(self, v: np.ndarray, table: int) -> np.ndarray:
        """The buckets to visit, a row for each query: the best by the sum of their cells' scores."""
        z = self.places(v, table)
        edge = (self.edges[table][None] - self.near * z[:, :, None]) / np.sqrt(1 - self.near**2)
        score = np.log(np.maximum(normal(edge[:, :, 1:]) - normal(edge[:, :, :-1]), 1e-12)) - self.cost[table]
        best, key = np.zeros((len(v), 1)), np.full((len(v), 1), table + 1, np.uint64)
        for j in range(score.shape[1]):
            best = (best[:, :, None] + score[:, j, None, :]).reshape(len(v), -1)
            key = (key[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, CELLS + 1, dtype=np.uint64)).reshape(len(v), -1)
            if best.shape[1] > self.probes:
                top = np.argpartition(-best, self.probes - 1, axis=1)[:, : self.probes]
                best, key = np.take_along_axis(best, top, axis=1), np.take_along_axis(key, top, axis=1)
        return K_.mix(key)

    def spreads(self, buckets: np.ndarray, table: int) -> np.ndarray:
        out = np.ones(len(buckets), np.int64)
        at = K_.lookup(self.hot[table], buckets)
        out[at >= 0] = self.spread[table][at[at >= 0]]
        return out


HIT = np.dtype([("id", "<i8"), ("d", "<f8"), ("near", "<i8")])


def best_of(hits: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each id, in order; of a neighbour met several times the smallest distance counts."""
    hits = hits[np.lexsort((hits["d"], hits["near"], hits["id"]))]
    new = np.ones(len(hits), bool)
    new[1:] = (hits["id"][1:] != hits["id"][:-1]) | (hits["near"][1:] != hits["near"][:-1])
    hits = hits[new]
    hits = hits[np.lexsort((hits["near"], hits["d"], hits["id"]))]
    return hits[ranks(hits) < k]


def ranks(hits: np.ndarray) -> np.ndarray:
    """Places from 0 within each id's run."""
    first = np.flatnonzero(np.append(True, hits["id"][1:] != hits["id"][:-1])) if len(hits) else np.zeros(0, np.int64)
    return np.arange(len(hits)) - np.repeat(first, np.diff(np.append(first, len(hits))))


def apart(group: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Rows of each group that can count: of equal vectors, whose distances are all equal, those of the k + 1 smallest ids, once each."""
    odd = K_.mix(np.arange(1, v.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    h = (np.ascontiguousarray(v).view(np.uint32) * odd).sum(axis=1)
    order = np.lexsort((ids, h, group))
    same = np.zeros(len(ids), bool)
    same[1:] = (group[order[1:]] == group[order[:-1]]) & (h[order[1:]] == h[order[:-1]]) & (v[order[1:]] == v[order[:-1]]).all(axis=1)
    new = ~same
    new[1:] |= ids[order[1:]] != ids[order[:-1]]
    place = np.cumsum(new)
    place -= place[np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))]
    return np.sort(order[new & (place <= k)])


class Members:
    """A partition's rows by bucket, centred and in single precision."""

    def __init__(self, records: np.ndarray, index: Index, k: int):
        order = np.lexsort((records["id"], records["bucket"]))
        self.bucket, self.id, self.v = records["bucket"][order], records["id"][order], np.ascontiguousarray(records["v"][order])
        self.names, first = np.unique(self.bucket, return_index=True)
        self.first = np.append(first, len(order))
        self.index, self.k = index, k
        self.flat = ((self.v - index.centre) / index.scale).astype(np.float32)
        self.norm = np.einsum("ij,ij->i", self.flat, self.flat)
        self.far = np.sqrt(np.maximum.reduceat(self.norm, first)) if len(first) else np.zeros(0)

    def search(self, q: np.ndarray, visit: np.ndarray) -> np.ndarray:
        """The best hits of queries (id, v) with their visits (bucket, row)."""
        k, size = self.k, self.v.shape[1]
        own = ((q["v"] - self.index.centre) / self.index.scale).astype(np.float32)
        reach = np.einsum("ij,ij->i", own, own)
        bound = np.full(len(q), np.inf)  # no row farther away than this is among a query's k nearest
        at = K_.lookup(self.names, visit["bucket"])
        place, row = at[at >= 0], visit["row"][at >= 0]
        count = np.diff(self.first)
        order = np.lexsort((row, place, -count[place]))  # large buckets first: they bound the rest
        place, row = place[order], row[order]
        cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        held: list = []
        n = 0
        for lo, hi in zip(cuts, np.append(cuts[1:], len(place))):
            b = place[lo]
            s, e = int(self.first[b]), int(self.first[b + 1])
            ids, rows = self.id[s:e], self.flat[s:e]
            distinct = e - s == 1 or bool((ids[1:] != ids[:-1]).all())
            step = max(1, (4 << 20) // (e - s))
            for c in range(lo, hi, step):
                who = row[c : min(hi, c + step)]
                d = self.norm[s:e][None] + reach[who][:, None] - 2 * (own[who] @ rows.T)
                d[q["id"][who][:, None] == ids[None]] = np.inf
                slack = (size + 16) * 2.0**-22 * (self.far[b] + np.sqrt(reach[who])) ** 2 + 1e-30
                if e - s > k and distinct:
                    bound[who] = np.minimum(bound[who], np.partition(d, k - 1, axis=1)[:, k - 1] + slack)
                i, j = np.nonzero(d <= (bound[who] + slack)[:, None])
                finite = d[i, j] < np.inf
                i, j = i[finite], j[finite] + s
                for g in range(0, len(i), 1 << 15):
                    x, y = who[i[g : g + (1 << 15)]], j[g : g + (1 << 15)]
                    found = np.empty(len(x), HIT)
                    found["id"], found["near"] = x, self.id[y]
                    found["d"] = ((q["v"][x].astype(np.float64) - self.v[y]) ** 2).sum(axis=1)
                    held.append(found)
                    n += len(x)
            if n > 1 << 19:
                held = [best_of(np.concatenate(held), k)]
                n = len(held[0])
                last = held[0][ranks(held[0]) == k - 1]
                limit = last["d"] / self.index.scale**2
                bound[last["id"]] = np.minimum(bound[last["id"]], limit + (size + 16) * 2.0**-22 * (np.sqrt(limit) + 2 * np.sqrt(reach[last["id"]])) ** 2)
        hits = best_of(np.concatenate(held), k) if held else np.zeros(0, HIT)
        hits["d"] = np.sqrt(hits["d"])
        hits["id"] = q["id"][hits["id"]]
        return hits


def fitted(rows: DataFrame, size: int, parts: int, sample: int, hashes: int, tables: int, probes: int) -> Index:
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().combine_chunks()
    batch = some.to_batches()[0] if some.num_rows else None
    v = matrix(batch, size)[1] if batch is not None else np.zeros((1, size))
    return Index(v.astype(np.float64), rows.count(), hashes, tables, probes, parts)


def nearest(df: DataFrame, k: int = K, every: int = EVERY, hashes: int = 0, tables: int = TABLES, probes: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance) of the k nearest others found for every row whose id is divisible by every. hashes and probes: by the rows if 0."""
    rows = vectors(df)
    spark = df.sparkSession
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 1
    rows = rows.where(F.size("v") == size)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    index = fitted(rows, size, parts, sample, hashes, tables, probes)
    member = np.dtype([("bucket", "<u8"), ("id", "<i8"), ("v", "<f4", size)])
    query = np.dtype([("id", "<i8"), ("v", "<f4", size)])
    visit = np.dtype([("bucket", "<u8"), ("row", "<u4")])

    def groups(part: np.ndarray):
        order = np.argsort(part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(own):
                yield int(part[own[0]]), own

    def route(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                ids, v = matrix(whole.slice(at, 8192), size)
                out: list = []
                targets, buckets, who = [], [], []
                kept = apart(np.zeros(len(ids), np.int8), ids, v, k)
                asked = np.flatnonzero(ids % every == 0)
                for t in range(tables):
                    records = np.empty(len(kept), member)
                    records["bucket"], records["id"], records["v"] = index.bucket(index.cells(v[kept], t), t), ids[kept], v[kept]
                    salt = K_.mix(records["id"].view(np.uint64)) % index.spreads(records["bucket"], t).astype(np.uint64)
                    out += [(p, 0, records[o].tobytes(), b"") for p, o in groups(((records["bucket"] + salt) % np.uint64(parts)).astype(np.int64))]
                    if len(asked):
                        own = index.visits(v[asked], t)
                        row, own = np.repeat(np.arange(len(asked)), own.shape[1]), own.ravel()
                        times = index.spreads(own, t)
                        salt = K_.ragged(np.zeros(len(own), np.int64), times).astype(np.uint64)
                        row, own = np.repeat(row, times), np.repeat(own, times)
                        targets.append(((own + salt) % np.uint64(parts)).astype(np.int64))
                        buckets.append(own)
                        who.append(row)
                if len(asked):
                    part, bucket, row = np.concatenate(targets), np.concatenate(buckets), np.concatenate(who)
                    for p, own in groups(part):
                        names, local = np.unique(row[own], return_inverse=True)
                        q = np.empty(len(names), query)
                        q["id"], q["v"] = ids[asked[names]], v[asked[names]]
                        r = np.empty(len(own), visit)
                        r["bucket"], r["row"] = bucket[own], local
                        out.append((p, 1, q.tobytes(), r.tobytes()))
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary())], ["part", "kind", "a", "b"])

    def search(batches):
        """Rows come before queries."""
        records, portion, held = [], [], 0
        members: Members | None = None

        def flush():
            n, rows_ = 0, []
            for q, r in portion:
                r = r.copy()
                r["row"] += n
                n += len(q)
                rows_.append(r)
            hits = members.search(np.concatenate([q for q, _ in portion]), np.concatenate(rows_))
            portion.clear()
            yield from sent(hits, parts)

        for batch in batches:
            for kind, a, b in zip(batch.column("kind").to_pylist(), batch.column("a"), batch.column("b")):
                if kind == 0:
                    own = np.frombuffer(a.as_buffer(), member)
                    records.append(own.copy())
                    continue
                if members is None:
                    if not records:
                        return
                    members = Members(collapsed(np.concatenate(records), k), index, k)
                    records.clear()
                portion.append((np.frombuffer(a.as_buffer(), query).copy(), np.frombuffer(b.as_buffer(), visit).copy()))
                held += sum(x.nbytes for x in portion[-1])
                if held > PORTION:
                    yield from flush()
                    held = 0
        if portion:
            yield from flush()

    def merge(batches):
        hits, n = [], 0
        for batch in batches:
            for x in batch.column("hits"):
                hits.append(np.frombuffer(x.as_buffer(), HIT).copy())
                n += len(hits[-1])
                if n > 4 << 20:
                    hits = [best_of(np.concatenate(hits), k)]
                    n = 0
        if hits:
            found = best_of(np.concatenate(hits), k)
            rank = ranks(found) + 1
            for c in range(0, len(found), 1 << 16):
                o = slice(c, c + (1 << 16))
                yield pa.record_batch([pa.array(np.ascontiguousarray(found["id"][o])), pa.array(rank[o].astype(np.int32)), pa.array(np.ascontiguousarray(found["near"][o])), pa.array(np.ascontiguousarray(found["d"][o]))], ["vec_id", "rank", "neighbour_id", "distance"])

    def merged(hits: DataFrame) -> DataFrame:
        return hits.repartitionById(parts, F.col("part")).select("hits").mapInArrow(merge, "vec_id long, rank int, neighbour_id long, distance double")

    routed = rows.mapInArrow(route, "part int, kind int, a binary, b binary").repartitionById(parts, F.col("part")).sortWithinPartitions("kind")
    found = cut(merged(routed.select("kind", "a", "b").mapInArrow(search, "part int, hits binary")))
    # queries whose buckets held less than k others: these few are searched for among all rows, a block at a time
    short = rows.where(F.col("id") % every == 0).join(found.where(F.col("rank") == k), F.col("id") == F.col("vec_id"), "left_anti").select("id", "v")
    block: list = []
    for row in short.toLocalIterator():
        block.append((row["id"], row["v"]))
        if len(block) == BLOCK:
            found = found.join(named(spark, block), "vec_id", "left_anti").unionAll(merged(rows.mapInArrow(scan(block, index, size, k, parts), "part int, hits binary")))
            block = []
    if block:
        found = found.join(named(spark, block), "vec_id", "left_anti").unionAll(merged(rows.mapInArrow(scan(block, index, size, k, parts), "part int, hits binary")))
    return found


def named(spark, block: list) -> DataFrame:
    return spark.createDataFrame([(i,) for i, _ in block], "vec_id long")


def sent(hits: np.ndarray, parts: int):
    for part, _, data in packed(hits, (K_.mix(hits["id"].view(np.uint64)) % np.uint64(parts)).astype(np.int64), 0):
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "hits"])


def scan(block: list, index: Index, size: int, k: int, parts: int):
    """The hits of a block of queries among all of a task's rows."""
    q = np.array([(i, v) for i, v in block], np.dtype([("id", "<i8"), ("v", "<f4", size)]))

    def run(batches):
        hits = np.zeros(0, HIT)
        every_one = np.zeros(len(q), np.dtype([("bucket", "<u8"), ("row", "<u4")]))
        every_one["row"] = np.arange(len(q))
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                ids, v = matrix(whole.slice(at, 8192), size)
                records = np.zeros(len(ids), np.dtype([("bucket", "<u8"), ("id", "<i8"), ("v", "<f4", size)]))
                records["id"], records["v"] = ids, v
                hits = best_of(np.concatenate([hits, Members(records, index, k).search(q, every_one)]), k)
        yield from sent(hits, parts)

    return run


def collapsed(records: np.ndarray, k: int) -> np.ndarray:
    """Records of several tasks without the equal vectors that can't count, bucket by bucket (equal vectors share their buckets)."""
    out = []
    for bits in range(64):  # by parts of the bucket's hash, to need little memory
        own = records[(records["bucket"] >> np.uint64(58)) == bits]
        if len(own):
            out.append(own[apart(own["bucket"], own["id"], own["v"], k)])
    return np.concatenate(out) if out else records
