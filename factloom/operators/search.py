"""Retrieval: postings, multi-field BM25, type-aware scores, filters, caches and metrics.

Queries come as rows (query_id, text), so many are answered in one plan. The query
side is distinct (query, token) pairs; postings are joined by token, and the best
of each query are taken by a window over that query's matches alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import tokens

K1, B = 1.2, 0.75
BOOSTS = {"title": 3.0, "tags": 2.0, "keywords": 2.0, "domain_tags": 1.5, "body": 1.0, "id": 1.0}


def field_text(facts: DataFrame, c: str) -> Column:
    return F.concat_ws(" ", c) if facts.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")


def tokenised(facts: DataFrame, key: str, fields) -> DataFrame:
    """(key, field, ts, length): a row for each field of each fact, from one scan."""

    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), tokens(field_text(facts, c)).alias("ts")) for c in fields)))
    return facts.select(F.col(key).alias("key"), each.alias("f")).select("key", "f.field", "f.ts", F.size("f.ts").alias("length"))


def postings(facts: DataFrame, key: str, fields, wanted: DataFrame | None = None) -> DataFrame:
    """(field, token, key, tf, length); only of the wanted tokens (token), if given, which are then picked out before anything is shuffled."""
    rows = tokenised(facts, key, fields).select("key", "field", "length", F.explode("ts").alias("token"))
    if wanted is not None:
        rows = rows.join(wanted, "token", "left_semi")
    return rows.groupBy("field", "token", "key", "length").agg(F.count("*").alias("tf"))


def token_stats(post: DataFrame) -> DataFrame:
    """(field, token, df, total) of postings."""
    return post.groupBy("field", "token").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def corpus_stats(facts: DataFrame, key: str, fields) -> DataFrame:
    """(field, token, df, total), without postings: each fact's tokens and its distinct tokens are counted within the tasks, so what is shuffled follows the vocabulary."""
    rows = tokenised(facts, key, fields)
    ways = F.array(F.struct(F.array_distinct("ts").alias("ts"), F.lit(1).alias("d"), F.lit(0).alias("t")), F.struct(F.col("ts"), F.lit(0).alias("d"), F.lit(1).alias("t")))
    rows = rows.select("field", F.explode(ways).alias("w")).select("field", F.explode("w.ts").alias("token"), "w.d", "w.t")
    return rows.groupBy("field", "token").agg(F.sum("d").alias("df"), F.sum("t").alias("total"))


def field_sizes(facts: DataFrame, key: str, fields) -> DataFrame:
    """(field, all, n): tokens of all facts, and their number; a row for each field."""
    rows = tokenised(facts, key, fields)
    return rows.groupBy("field").agg(F.sum("length").alias("all"), F.count("*").alias("n"))


def asked_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token): each token of a query once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("token"))


def score(asked: DataFrame, post: DataFrame, stats: DataFrame, sizes: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """(query_id, key, bm25) from postings, (field, token, df) and field sizes. asked: (query_id, token), and the only field to look in if there's a column for it."""
    # a row for each field: their number doesn't depend on the data
    weighed = post.join(stats.select("field", "token", "df"), ["field", "token"]).join(F.broadcast(sizes), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") * F.col("n") / F.col("all")))
    boost = F.coalesce(*(F.when(F.col("field") == f, F.lit(float(w))) for f, w in boosts.items()))
    hit = asked.join(weighed.select("token", "field", "key", (boost * idf * norm).alias("part")), "token")
    if "only" in asked.columns:
        hit = hit.where("only is null or only = field")
    return hit.groupBy("query_id", "key").agg(F.round(F.sum("part"), 6).alias("bm25"))


#: (query, token) pairs that travel to the tasks, at most; beyond that, postings are joined. Scores at once, in a task.
MOST_ASKED, SCORES = 200_000, 2_000_000


def bm25(queries: DataFrame, facts: DataFrame, key: str, boosts: dict[str, float] | None = None, most: int = 0) -> DataFrame:
    """(query_id, key, bm25) of all facts that share a token with a query; a token of the query counts once.

    Without stored postings: facts are tokenised once for the postings of the
    queries' tokens, which is all that is shuffled, and once for the fields' sizes.
    Where only the so many best of each query are needed (most), only these leave
    a task, unless facts share a key, whose scores are sums over tasks.
    """
    boosts = boosts or BOOSTS
    asked = asked_tokens(queries)
    if most and min(boosts.values()) > 0:
        pairs = asked.limit(MOST_ASKED + 1).toArrow()
        if 0 < pairs.num_rows <= MOST_ASKED and facts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return _local_best(pairs, asked, facts, key, boosts, most)
    post = postings(facts, key, boosts, asked.select("token").distinct())
    stats = post.groupBy("field", "token").agg(F.count("*").alias("df"))
    return score(asked, post, stats, field_sizes(facts, key, boosts), boosts)


def _local_best(pairs: pa.Table, asked: DataFrame, facts: DataFrame, key: str, boosts: dict[str, float], most: int) -> DataFrame:
    """bm25() of facts with different keys: the best of each query within each task."""
    wanted = pairs["token"].combine_chunks().unique()
    # an empty token, which no text has, stands for the fact itself
    rows = tokenised(facts, key, boosts).select("field", "length", F.explode(F.array_union(F.array_distinct("ts"), F.array(F.lit("")))).alias("token"))
    known = F.broadcast(facts.sparkSession.createDataFrame([(t,) for t in ["", *wanted.to_pylist()]], "token string"))
    stats = rows.join(known, "token", "left_semi").groupBy("field", "token").agg(F.count("*").alias("df"), F.sum("length").alias("all")).collect()
    n, all_ = ({r["field"]: r[c] for r in stats if r["token"] == ""} for c in ("df", "all"))
    places = {t: i for i, t in enumerate(wanted.to_pylist())}
    idf = np.zeros((len(boosts), len(places)))
    for r in stats:
        if r["token"]:
            at, df = list(boosts).index(r["field"]), r["df"]
            idf[at, places[r["token"]]] = float(boosts[r["field"]]) * np.log(1 + (n[r["field"]] - df + 0.5) / (df + 0.5))
    ratio = [n[f] / all_[f] if all_.get(f) else 0.0 for f in boosts]
    columns = [tokens(field_text(facts, f)).alias(f"ts{i}") for i, f in enumerate(boosts)]
    rows = facts.select(F.col(key).alias("key"), *columns)
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, bm25 double"
    return rows.mapInArrow(_scorer(pairs, wanted, idf, ratio, most), kinds)


def _scorer(pairs: pa.Table, wanted: pa.Array, idf: np.ndarray, ratio: list[float], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes facts as (key, tokens of each field), gives (query_id, key, bm25) of the best."""
    coded = pairs["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    query, token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.index_in(pairs["token"].combine_chunks(), wanted).to_numpy(zero_copy_only=False)
    query, asks = query[np.argsort(token, kind="stable")], np.bincount(token, minlength=len(wanted))
    begin, ids, many = np.cumsum(asks) - asks, coded.dictionary, len(coded.dictionary)

    def top(held: list[pa.Table], floor: np.ndarray) -> list[pa.Table]:
        """The best of each query; the scores of the last of them go to the floor."""
        all_ = pa.concat_tables(held)
        all_ = all_.take(pc.sort_indices(all_, [("query", "ascending"), ("bm25", "descending"), ("key", "ascending")], null_placement="at_start"))
        q = all_["query"].to_numpy()
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff([*first, len(q)]))
        all_, q, rank = all_.filter(pa.array(rank < most)), q[rank < most], rank[rank < most]
        floor[q[rank == most - 1]] = all_["bm25"].to_numpy()[rank == most - 1]
        return [all_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        floor, waiting = np.full(many, -1.0), 0
        for batch in batches:
            parts = []
            for at, each in enumerate(batch.columns[1:]):
                length = each.value_lengths().to_numpy(zero_copy_only=False)
                place = pc.index_in(each.flatten(), wanted).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(length)), length)
                pair, tf = np.unique((doc * len(wanted) + place)[place >= 0], return_counts=True)
                doc, place = pair // len(wanted), pair % len(wanted)
                parts.append((doc, place, idf[at, place] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] * ratio[at])))))
            doc, place, part = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(doc, kind="stable")
            doc, place, part = doc[order], place[order], part[order]
            wide = max(1, SCORES // many)
            # as many facts at once as have SCORES pairs with queries, by number and by shared tokens
            shared = np.cumsum(asks[place])
            at = 0
            while at < len(doc):
                end = min(np.searchsorted(doc, doc[at] + wide), np.searchsorted(shared, (shared[at - 1] if at else 0) + SCORES) + 1)
                end = np.searchsorted(doc, doc[min(end, len(doc)) - 1], side="right")
                d, p, x = doc[at:end] - doc[at], place[at:end], part[at:end]
                count = asks[p]
                q = query[np.arange(count.sum()) + np.repeat(begin[p] - (np.cumsum(count) - count), count)]
                sums = np.bincount(np.repeat(d, count) * many + q, np.repeat(x, count))
                hit = np.flatnonzero(sums > 0)
                value = np.floor(sums[hit] * 1e6 + 0.5) / 1e6
                better = value >= floor[hit % many]
                hit, value = hit[better], value[better]
                held.append(pa.table({"query": hit % many, "bm25": value, "key": batch.column(0).take(pa.array(hit // many + doc[at]))}))
                waiting += len(hit)
                if waiting > 4 * most * many or waiting > SCORES:
                    held, waiting = top(held, floor), 0
                at = end
        if held:
            for b in top(held, floor)[0].combine_chunks().to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_arrays([ids.take(b["query"]), b["key"], b["bm25"]], names=["query_id", "key", "bm25"])

    return run


def best(hits: DataFrame, score: str, k: int) -> DataFrame:
    """The k best of each query, equals by key, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "key")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def freshness(now: Column, updated: Column) -> Column:
    days = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(updated)) / 86400
    return F.when(updated.isNull() | (days <= 0), 1.0).otherwise(1 + 0.5 * F.exp(-days / 30))


def compound(hits: DataFrame, now: Column) -> DataFrame:
    """Adds norm and score. hits: (query_id, key, bm25) with the facts' own columns, and adjacency if events have an anchor."""
    top = F.max("bm25").over(Window.partitionBy("query_id"))
    base = F.col("norm") * F.col("confidence") * F.col("importance")
    adjacency = F.coalesce("adjacency", F.lit(1.0)) if "adjacency" in hits.columns else F.lit(1.0)
    expired = F.coalesce(F.col("valid_until") < now, F.lit(False))
    score = F.when(F.col("fact_type") == "state", F.when(expired, 0.0).otherwise(base * freshness(now, F.col("updated_at"))))
    score = score.when(F.col("fact_type") == "event", base * F.col("recency") * adjacency).otherwise(base)
    return hits.withColumn("norm", F.when(top > 0, F.col("bm25") / top).otherwise(0.0)).withColumn("score", score)


def thresholds(hits: DataFrame, least: float, gap: float) -> DataFrame:
    """Rows that reach the least score; of a query whose best is less than gap ahead of its second, only the best."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("bm25"), "key")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = hits.where(F.col("score") >= least).withColumn("rank", F.row_number().over(by))
    ranked = ranked.withColumn("s1", F.first("score").over(whole)).withColumn("s2", F.nth_value("score", 2).over(whole))
    return ranked.where((F.col("rank") == 1) | F.col("s2").isNull() | (F.col("s1") - F.col("s2") >= gap)).drop("s1", "s2")


def search(queries: DataFrame, facts: DataFrame, now: Column, k: int = 10, least: float = 0.85, gap: float = 0.1, boosts=None) -> DataFrame:
    """Ranked hits: twice k by BM25, scored by fact type, filtered, cut at k."""
    found = best(bm25(queries, facts, "id", boosts, 2 * k), "bm25", 2 * k).drop("rank")
    own = facts.select(F.col("id").alias("key"), "title", "fact_type", "confidence", "importance", "recency", "valid_until", "updated_at")
    return thresholds(compound(found.join(own, "key"), now), least, gap).where(F.col("rank") <= k)


def exact_lookup(queries: DataFrame, cached: DataFrame, generation: int, now: Column, seconds: int) -> DataFrame:
    """(query_id, entry) of the queries whose text was asked before, the newest of several. cached: (entry, text, generation, at)."""
    held = cached.where((F.col("generation") == generation) & (F.unix_timestamp(now) - F.unix_timestamp("at") <= seconds))
    held = held.groupBy(F.md5("text").alias("mark")).agg(F.max_by("entry", F.struct("at", "entry")).alias("entry"))
    return queries.select("query_id", F.md5("text").alias("mark")).join(held, "mark").select("query_id", "entry")


#: Entries, at most, that each query is compared with in its own row. In a join by tokens, rows of a token are dealt to so many.
FEW_HELD, DEALS = 256, 16


def _lookup_few(queries: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """fuzzy_lookup() among few entries, all of which travel to each query: nothing is kept or shuffled for a pair. Queries are shuffled once, as they may come in a few large pieces."""
    ts = F.array_distinct(tokens("text"))
    one = held.where("entry is not null").select("at", "entry", ts.alias("ts")).agg(F.collect_list(F.struct("at", "entry", "ts")).alias("held"))
    asked = queries.select("query_id", "text").repartition("query_id").select("query_id", ts.alias("own")).join(F.broadcast(one))

    def near(h: Column) -> Column:
        both = F.size(F.array_intersect("own", h["ts"]))
        all_ = F.size("own") + F.size(h["ts"]) - both
        alike = F.when(all_ == 0, 1.0).otherwise(F.round(both / F.greatest(all_, F.lit(1)), 6))
        return F.struct(alike.alias("similarity"), h["at"].alias("at"), h["entry"].alias("entry"))

    found = asked.select("query_id", F.array_max(F.transform("held", near)).alias("b")).where(F.col("b.similarity") >= least)
    best = F.max(F.struct("b.similarity", "b.at", "b.entry")).alias("b")  # a query may have been asked in several rows
    return found.groupBy("query_id").agg(best).select("query_id", F.col("b.entry").alias("entry"), "b.similarity")


def fuzzy_lookup(queries: DataFrame, cached: DataFrame, least: float, generation: int, now: Column, seconds: int) -> DataFrame:
    """(query_id, entry, similarity) of the most similar text asked before, of equals the newest. Texts without tokens are alike."""
    held = cached.where((F.col("generation") == generation) & (F.unix_timestamp(now) - F.unix_timestamp("at") <= seconds))
    few = held.select("entry").limit(FEW_HELD + 1).count() <= FEW_HELD
    if few and least > 0:
        return _lookup_few(queries, held, least)
    near = token_jaccard(queries.select(F.col("query_id").alias("id"), "text"), held.select(F.col("entry").alias("id"), "text"), least)
    empty = [df.where(F.size(tokens("text")) == 0) for df in (queries, held)]
    alike = empty[0].select(F.col("query_id").alias("left_id"), F.lit(True).alias("on")).join(empty[1].agg(F.max_by("entry", F.struct("at", "entry")).alias("right_id")).where("right_id is not null").withColumn("on", F.lit(True)), "on")
    pairs = near.unionByName(alike.select("left_id", "right_id", F.lit(1.0).alias("similarity"))).join(held.select(F.col("entry").alias("right_id"), "at"), "right_id")
    best = F.max_by(F.struct("right_id", "similarity"), F.struct("similarity", "at", "right_id")).alias("b")
    return pairs.groupBy(F.col("left_id").alias("query_id")).agg(best).select("query_id", F.col("b.right_id").alias("entry"), "b.similarity")


def token_jaccard(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, similarity) of rows (id, text) whose token sets reach it: met by shared tokens, so no cross product."""

    def sets(df, side):
        return df.select(F.col("id").alias(f"{side}_id"), F.array_distinct(tokens("text")).alias("ts")).select(f"{side}_id", F.size("ts").alias(f"{side}_n"), F.explode("ts").alias("token"))

    # rows of a common token aren't all of one task
    deal = F.pmod(F.xxhash64("left_id"), F.lit(DEALS)).cast("int")
    dealt = sets(right, "right").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    shared = sets(left, "left").withColumn("deal", deal).join(dealt, ["token", "deal"]).groupBy("left_id", "right_id", "left_n", "right_n").agg(F.count("*").alias("both"))
    return shared.select("left_id", "right_id", F.round(F.col("both") / (F.col("left_n") + F.col("right_n") - F.col("both")), 6).alias("similarity")).where(F.col("similarity") >= least)


def metrics(hits: DataFrame, wanted: DataFrame, unwanted: DataFrame | None = None) -> DataFrame:
    """(tier, p3, r5, mrr, violations) from ranked hits (query_id, key, rank) and judgements (query_id, tier, key); violations counts the hits that are unwanted (query_id, key)."""
    judged = wanted.select("query_id", "key", F.lit(True).alias("good")).distinct()
    all_ = wanted.groupBy("query_id", "tier").agg(F.count_distinct("key").alias("n"))
    found = hits.join(judged, ["query_id", "key"])
    own = found.groupBy("query_id").agg(F.sum((F.col("rank") <= 3).cast("int")).alias("in3"), F.sum((F.col("rank") <= 5).cast("int")).alias("in5"), F.min(F.when(F.col("rank") <= 5, F.col("rank"))).alias("first"))
    per = all_.join(own, "query_id", "left")
    bad = F.lit(0).cast("long")
    if unwanted is not None:
        per = per.join(hits.join(unwanted.select("query_id", "key").distinct(), ["query_id", "key"], "left_semi").groupBy("query_id").agg(F.count("*").alias("bad")), "query_id", "left")
        bad = F.coalesce("bad", F.lit(0))
    return per.groupBy("tier").agg(F.avg(F.coalesce("in3", F.lit(0)) / 3).alias("p3"), F.avg(F.coalesce("in5", F.lit(0)) / F.col("n")).alias("r5"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.sum(bad).alias("violations"))
