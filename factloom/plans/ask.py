"""Answering queries from a compiled generation, many in one plan.

The tiers follow each other: words (BM25, with the ontology's terms), scores by
fact type, a second scoring with the best hit as the causal anchor, causal and
temporal hits where a query has their signal words. What a tier finds is merged
into what there is.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.config import Config
from factloom.functions import text as T
from factloom.operators import graph, ontology, search, temporal
from factloom.plans import store
from factloom.session import cut

WORDS, CAUSAL, TEMPORAL, ANSWER = 2, 24, 25, 3
#: So many tokens of queries are looked up in the postings by value, which skips what holds none of them; more are joined.
MOST_LOOKED_UP = 2000
SHOWN = ("title", "source_path", "fact_type", "confidence", "importance", "recency", "tags", "domain_tags", "keywords", "related", "caused_by", "causes", "maturity", "access_count", "update_count")


@dataclass(frozen=True)
class Tables:
    facts: DataFrame
    postings: DataFrame
    stats: DataFrame
    sizes: DataFrame
    edges: DataFrame | None
    log: DataFrame | None
    terms: DataFrame | None


def opened(spark: SparkSession, out: str, config: Config, delta: bool = False) -> Tables:
    """The tables of the last generation. A graph or log that isn't there leaves its tier out; an ontology that can't be read is none."""
    at = store.generation(spark, out)
    if not at:
        raise store.IndexNotFound(out)

    def perhaps(read):
        try:
            return read()
        except AnalysisException:
            return None

    terms = None
    if config.ontology:
        terms = perhaps(lambda: ontology.read(spark, config.ontology))
        terms = None if terms is None or terms.isEmpty() else terms
    own = [store.table(spark, out, name, at) for name in ("facts", "postings", "token_stats", "field_sizes")]
    return Tables(*own, perhaps(lambda: store.table(spark, out, "edges", at)), perhaps(lambda: store.log(spark, out, at, delta)), terms)


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, token, field): what a query asks for. ``field:word`` asks in that field only.

    A query with a field that there isn't, or with an open quotation mark, can't be
    parsed and asks for titles that have the whole of it as a token.
    """
    names = "|".join(search.BOOSTS)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    broken = F.exists(words, lambda w: w.contains(":") & ~w.rlike(f"^[+-]?({names}):.")) | (F.length(F.regexp_replace("text", '[^"]', "")) % 2 == 1)
    rows = queries.select("query_id", "text", F.coalesce(broken, F.lit(False)).alias("broken"), words.alias("words"))
    good = rows.where("not broken").select("query_id", F.explode("words").alias("w"))
    field = F.nullif(F.regexp_extract("w", f"^[+-]?({names}):", 1), F.lit(""))
    good = good.select("query_id", F.explode(T.tokens(F.regexp_replace("w", f"^[+-]?({names}):", ""))).alias("token"), field.alias("field"))
    return good.distinct().unionByName(rows.where("broken").select("query_id", F.col("text").alias("token"), F.lit("title").alias("field")))


def found(tables: Tables, queries: DataFrame) -> DataFrame:
    """(query_id, key, bm25) from the stored postings, of which only those of the queries' tokens are read."""
    asked = parsed(queries)
    tokens = asked.select("token").distinct()
    some = [r[0] for r in tokens.limit(MOST_LOOKED_UP + 1).collect()]
    if len(some) <= MOST_LOOKED_UP:
        post, stats = (x.where(F.col("token").isin(some)) for x in (tables.postings, tables.stats))
    else:
        post, stats = (x.join(tokens, "token", "left_semi") for x in (tables.postings, tables.stats))
    asked = asked.withColumnRenamed("field", "only")
    return search.score(asked, post, stats, tables.sizes, search.BOOSTS)


def scored(hits: DataFrame, now: Column, k: int, config: Config) -> DataFrame:
    return search.thresholds(search.compound(hits, now), config.score_threshold, config.score_gap).where(F.col("rank") <= k)


def causal(queries: DataFrame, anchors: DataFrame, hits: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(query_id, key, score) that the causal tier finds from the anchors (query_id, anchor): 0.7 to the hops.

    Causes or effects of the anchor; where neither is asked for, those hits that a path leads to.
    """
    asked = queries.where(T.is_causal("text")).select("query_id", T.causal_pattern("text").alias("way")).join(anchors, "query_id")
    out = None
    for backward in (True, False):
        own = asked.where(F.col("way") == "backward" if backward else F.col("way") != "backward")
        near = graph.reachable(own.select(F.col("anchor").alias("src")), edges, hops, backward)
        rows = own.join(near, F.col("anchor") == F.col("src")).select("query_id", "way", F.col("node").alias("key"), F.pow(F.lit(graph.DECAY), "hops").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    chained = out.where("way = 'chain'").join(hits.select("query_id", "key"), ["query_id", "key"], "left_semi")
    return out.where("way <> 'chain'").unionByName(chained).drop("way")


def temporally(queries: DataFrame, log: DataFrame, now: Column, parity: bool = False) -> DataFrame:
    """(query_id, key, event_ts, place) that the temporal tier finds: states that hold now, records since a year, or all of them; place is the order.

    Each query gets every record it asks for. The queries are few and broadcast; a
    fact's records count once for a query, the newest, unless parity is asked for.
    """
    asked = queries.where(T.signal("text", T.TEMPORAL_SIGNALS)).select("query_id", T.temporal_pattern("text").alias("way"), T.since_year("text").alias("year"))
    current = temporal.current_state(log, now, parity)
    start = F.coalesce(F.make_date(F.col("year"), F.lit(1), F.lit(1)).cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))
    parts = [
        asked.where("way = 'current'").join(current, F.lit(True)),
        asked.where("way = 'since'").join(log, F.col("event_ts") >= start),
        asked.where("way = 'history'").join(log, F.lit(True)),
    ]
    rows = None
    for part in parts:
        own = part.select("query_id", F.col("id").alias("key"), "event_ts", "kind")
        rows = own if rows is None else rows.unionByName(own)
    return rows if parity else rows.groupBy("query_id", "key").agg(F.max("event_ts").alias("event_ts"), F.max_by("kind", "event_ts").alias("kind"))


def ask(spark: SparkSession, out: str, queries: DataFrame, now: datetime, k: int = 10, config: Config | None = None, parity: bool = False) -> DataFrame:
    """Ranked hits of the queries (query_id, text) in the last committed generation.

    (query_id, rank, key, score, bm25, tier and what of SHOWN the fact has.) bm25 is
    relative to the query's best. The tier is that of the whole query: the last that
    found anything. parity: as the tiers were first conceived, that is, events that no
    path leads to from the anchor count nothing even if they have no edges at all,
    causal hits are neither filled in nor compared with others, and the log is the
    last compile's alone.
    """
    config = config or Config()
    tables = opened(spark, out, config, parity)
    at = F.lit(now).cast("timestamp")
    asked = queries.select("query_id", F.col("text").cast("string").alias("text"))
    words = asked if tables.terms is None else ontology.expanded_text(asked, tables.terms, config.expansion_depth)
    best = search.best(found(tables, words), "bm25", 2 * k).drop("rank")
    own = tables.facts.select(F.col("id").alias("key"), *SHOWN, "valid_until", "updated_at").dropDuplicates(["key"])
    first = cut(best.join(own, "key"))
    hits = scored(first, at, k, config)
    anchors = cut(hits.where("rank = 1").select("query_id", F.col("key").alias("anchor")))
    edges = tables.edges
    if edges is not None:
        events = first.where("fact_type = 'event'").select("query_id", "key").join(anchors, "query_id")
        pairs = events.select(F.col("anchor").alias("src"), F.col("key").alias("node")).distinct()
        near = graph.adjacency(pairs, tables.facts.select("id"), edges, config.causal_max_hops)
        if not parity:
            ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
            near = near.join(ends.withColumn("has", F.lit(True)), "node", "left").withColumn("adjacency", F.when(F.col("has").isNull(), 1.0).otherwise(F.col("adjacency"))).drop("has")
        joined = first.join(anchors, "query_id", "left").join(near, (F.col("anchor") == F.col("src")) & (F.col("key") == F.col("node")), "left")
        hits = scored(joined.drop("src", "node", "anchor"), at, k, config)
    hits = cut(hits.select("query_id", "key", F.col("norm").alias("bm25"), "score", F.col("rank").cast("long").alias("place"), F.lit(WORDS).alias("tier"), *SHOWN))
    blank = own.drop("valid_until", "updated_at")

    def filled(keys: DataFrame) -> DataFrame:
        """(query_id, key, score) rows with their facts' columns; a fact that has gone since leaves them null."""
        return keys.join(blank, "key", "left")

    reached = None  # the tiers beyond words that found anything for a query, whether or not it was new
    if edges is not None:
        more = cut(causal(asked, anchors, hits, edges, config.causal_max_hops)).withColumn("tier", F.lit(CAUSAL))
        reached = more.select("query_id", "tier")
        more = more if parity else filled(more.join(hits.select("query_id", "key"), ["query_id", "key"], "left_anti"))
        hits = hits.withColumn("block", F.lit(1)).unionByName(more.withColumn("block", F.lit(2)), allowMissingColumns=True)
    else:
        hits = hits.withColumn("block", F.lit(1))
    if tables.log is not None:
        timed = cut(temporally(asked, tables.log, at, parity))
        own_tier = timed.select("query_id", F.lit(TEMPORAL).alias("tier"))
        reached = own_tier if reached is None else reached.unionByName(own_tier)
        words_of = hits.where("block = 1").select("query_id", "key", "bm25", F.lit(True).alias("known"))
        timed_hits = filled(timed.join(words_of, ["query_id", "key"], "left").select("query_id", "key", (F.coalesce("bm25", F.lit(0.0)) + temporal.BOOST).alias("score"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.lit(TEMPORAL).alias("tier"), F.lit(0).alias("block"), "event_ts"))
        rest = hits.join(timed.select("query_id", "key").distinct(), ["query_id", "key"], "left_anti")
        hits = timed_hits.unionByName(rest, allowMissingColumns=True)
    else:
        hits = hits.withColumn("event_ts", F.lit(None).cast("timestamp"))
    return placed(hits, reached)


def placed(hits: DataFrame, reached: DataFrame | None) -> DataFrame:
    """Ranks over all blocks: temporal hits, those by words, causal ones; the tier becomes the query's, the last of those reached (query_id, tier)."""
    if reached is not None:
        last = reached.groupBy("query_id").agg(F.max("tier").alias("last"))
        hits = hits.join(last, "query_id", "left").withColumn("tier", F.greatest("tier", F.coalesce("last", F.lit(WORDS)))).drop("last")
    order = Window.partitionBy("query_id").orderBy("block", F.when(F.col("block") == 1, F.col("place")), F.desc("score"), F.desc_nulls_last("event_ts"), "key")
    whole = Window.partitionBy("query_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).withColumn("tier", F.max("tier").over(whole))
    return ranked.select("query_id", "rank", "key", "score", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "tier", *SHOWN)
