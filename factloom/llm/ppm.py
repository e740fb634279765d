"""Code lengths of documents by prediction by partial matching (PPM) over bytes.

The model is a trie of the contexts of up to ORDER bytes with the counts of the
bytes that followed. A byte is coded in its longest context if it was seen there;
else an escape is coded and the next shorter context tried, without the bytes
that the longer one had (symbol exclusion), down to equal shares of what is left
of the 256. An escape in a context with T occurrences of D bytes left has
probability D / (T + D), a byte with n occurrences n / (T + D) (method C).

The models are pretrained on the whole corpus in two halves, and each half is
scored with the other's model, so no document tells its own counts. The halves go
by the hash of the text, so that exact copies don't tell on each other either.

Since the bytes seen in a context are a subset of those seen in each shorter
one, the cost of a byte in a context is a function of a few sums over the trie's
levels, so each (ORDER + 1)-gram of the corpus has one cost per model:

1. Documents are spread over buckets of about BUCKET_BYTES; each counts its grams.
2. Counts are added up, and level by level, from the shortest, joined into costs.
3. Each bucket gets back the costs of its own grams and sums them by document.

No task needs the whole trie, and nothing is broadcast or sent to the driver.

Defined results: a null text has null bytes and bits; an empty one 0 bits and no
rate. A text begins in a context of zero bytes. Repeated rows count each time and
get equal bits, null ids come out as null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import kernels as K
from factloom.session import cut

ORDER = 4
BUCKET_BYTES = 24 << 20
SCORED = "doc_id long, n_bytes long, bits double, bits_per_byte double"


def byte_grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, first of each text): every byte with the order bytes before it, as a number; a text begins after zero bytes."""
    raw, offsets = K.string_bytes(texts)
    counts = np.diff(offsets)
    padded = np.zeros(len(raw) + order * len(counts), np.uint64)
    shift = order * np.arange(1, len(counts) + 1)
    padded[np.arange(len(raw)) + np.repeat(shift, counts)] = raw
    grams = padded.copy()
    for j in range(1, order + 1):
        grams[j:] |= padded[:-j] << np.uint64(8 * j)
    return grams[np.arange(len(raw)) + np.repeat(shift, counts)], offsets


def halves(texts: pa.Array) -> np.ndarray:
    """0 or 1 by the text's hash."""
    raw, offsets = K.string_bytes(texts)
    return (K.span_hash(K.prefix_sums(raw), offsets[:-1], offsets[1:]) >> np.uint64(63)).astype(np.int64)


def counter(order: int):
    """Grams of a bucket's documents with their counts in either half."""

    def run(table: pa.Table) -> pa.Table:
        totals: tuple[list, list] = ([], [])
        bucket = table["bucket"][0].as_py()
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for part in K.chunks(batch):
                grams, first = byte_grams(part.column("text"), order)
                half = np.repeat(halves(part.column("text")), np.diff(first))
                for m in (0, 1):
                    own = np.sort(grams[half == m])
                    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
                    totals[m].append((own[cuts], np.diff(np.append(cuts, len(own)))))
        keys = np.unique(np.concatenate([k for side in totals for k, _ in side] or [np.zeros(0, np.uint64)]))
        n = np.zeros((2, len(keys)), np.int64)
        for m in (0, 1):
            for k, c in totals[m]:
                n[m, np.searchsorted(keys, k)] += c
        return pa.table({"bucket": pa.array(np.full(len(keys), bucket, np.int32)), "gram": pa.array(keys.view(np.int64)), "n0": pa.array(n[0]), "n1": pa.array(n[1])})

    return run


def costs(counts: DataFrame, order: int) -> DataFrame:
    """(gram, b0, b1): the bits of each gram's last byte after the others, under either model. counts: (gram, n0, n1), each gram once."""

    def level(k: int) -> DataFrame:
        key = F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("g")
        return counts.groupBy(key).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def in_context(df: DataFrame) -> DataFrame:
        over = Window.partitionBy(F.shiftright("g", 8))
        for m in ("0", "1"):
            df = df.withColumn(f"t{m}", F.sum(f"n{m}").over(over)).withColumn(f"d{m}", F.sum((F.col(f"n{m}") > 0).cast("long")).over(over))
            if f"low_n{m}" in df.columns:
                df = df.withColumn(f"e{m}", F.sum(F.when(F.col(f"n{m}") > 0, F.col(f"low_n{m}")).otherwise(0)).over(over))
        return df

    def coded(n, t, d, after):
        """Bits of a byte seen n times among t of d different ones, or else of the escape and what comes after."""
        return F.when(n > 0, F.log2((t + d) / n)).when(t > 0, F.log2((t + d) / d) + after).otherwise(after)

    # a<m>: bits once this level has been escaped from
    low = in_context(level(0))
    low = low.select("g", *(c for m in "01" for c in (f"n{m}", f"t{m}", f"d{m}")), *(F.log2(256 - F.col(f"d{m}")).alias(f"a{m}") for m in "01"))
    for k in range(1, order + 1):
        names = [f"{c}{m}" for m in "01" for c in "ntda"]
        below = low.select(F.col("g").alias("low_g"), *(F.col(c).alias(f"low_{c}") for c in names))
        df = in_context(level(k).join(below, F.col("g").bitwiseAND((1 << 8 * k) - 1) == F.col("low_g")))
        after = [coded(F.col(f"low_n{m}"), F.col(f"low_t{m}") - F.col(f"e{m}"), F.col(f"low_d{m}") - F.col(f"d{m}"), F.col(f"low_a{m}")).alias(f"a{m}") for m in "01"]
        low = df.select("g", *(c for m in "01" for c in (f"n{m}", f"t{m}", f"d{m}")), *after)
    return low.select(F.col("g").alias("gram"), *(coded(F.col(f"n{m}"), F.col(f"t{m}"), F.col(f"d{m}"), F.col(f"a{m}")).cast("float").alias(f"b{m}") for m in "01"))


def summer(order: int):
    """Bits of a bucket's documents from its grams' costs; each half under the other's model."""

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        index = pd.Index(bits["gram"].to_numpy())
        cost = np.stack([bits["b1"].to_numpy(), bits["b0"].to_numpy()])
        out = []
        for batch in docs.combine_chunks().to_batches():
            for part in K.chunks(batch):
                texts = part.column("text")
                grams, first = byte_grams(texts, order)
                half = np.repeat(halves(texts), np.diff(first))
                sums = np.zeros(len(grams) + 1)
                np.cumsum(cost[half, index.get_indexer(grams.view(np.int64))], out=sums[1:])
                n, total = np.diff(first), sums[first[1:]] - sums[first[:-1]]
                missing = texts.is_null().to_numpy(zero_copy_only=False)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out.append(pa.table({"doc_id": part.column("doc_id"), "n_bytes": pa.array(n, mask=missing), "bits": pa.array(total, mask=missing), "bits_per_byte": pa.array(total / n, mask=missing | (n == 0))}))
        empty = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("bits", pa.float64()), ("bits_per_byte", pa.float64())])
        return pa.concat_tables(out) if out else empty.empty_table()

    return run


def code_lengths(documents: DataFrame, order: int = ORDER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // bucket_bytes
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    counts = cut(docs.select("bucket", "text").groupBy("bucket").applyInArrow(counter(order), "bucket int, gram long, n0 long, n1 long"))
    bits = costs(cut(counts.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))), order)
    own = counts.select("bucket", "gram").join(bits, "gram")
    return docs.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(summer(order), SCORED)
