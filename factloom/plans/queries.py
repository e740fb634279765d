"""The engine's operators on whole tables, with the SQL they're checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import classify, governance, graph, ontology, search, temporal
from factloom.plans import ask as tiers
from factloom.plans import output
from factloom.session import cut
from factloom.sources import facts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.corpus_stats(read(spark, sf_dir, "documents"), "doc_id", ["text"]).select("token", "df", "total")


BOOSTS = {"text": 1.0, "source": 2.0}


def _found(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """The best documents for every benchmark item."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.best(search.bm25(asked, read(spark, sf_dir, "documents"), "doc_id", BOOSTS, most), "bm25", most)


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return _found(spark, sf_dir, 10)


def compound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by fact type, with threshold and gap, of every benchmark item; types go by language."""
    now = F.lit("2024-06-01").cast("timestamp")
    day = F.make_interval(days=F.pmod("n_chars", F.lit(400)).cast("int"))
    facts = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"),
        F.when(F.col("lang") == "fr", "state").when(F.col("lang") == "de", "event").otherwise("durable").alias("fact_type"),
        (0.5 + F.pmod("n_chars", F.lit(50)) / 100).alias("confidence"),
        F.lit(1.0).alias("importance"),
        F.lit(0.9).alias("recency"),
        (F.lit("2024-01-01").cast("timestamp") + day).alias("valid_until"),
        (F.lit("2023-12-01").cast("timestamp") + day).alias("updated_at"),
    )
    hits = _found(spark, sf_dir, 20).drop("rank").join(facts, "key")
    kept = search.thresholds(search.compound(hits, now), 0.5, 0.05).where(F.col("rank") <= 10)
    return kept.select("query_id", "key", "fact_type", F.round("score", 5).alias("score"), "rank")


def facts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts: the first eight words are the title, language and source the tags."""
    words = F.slice(F.split("text", " "), 1, 8)
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("id"), F.array_join(words, " ").alias("title"), F.col("text").alias("body"), F.array("lang").alias("tags"), F.array("source").alias("keywords"),
        F.array(F.concat(F.lit("lang:"), F.col("lang"))).alias("domain_tags"),
    )


def bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best facts for every benchmark item, over six fields with the engine's boosts."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.best(search.bm25(asked, facts_of(spark, sf_dir), "id", most=10), "bm25", 10)


def query_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What queries with fields, without, with an unknown field and with an open quotation mark ask for."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    shapes = [F.concat(F.lit("title:"), words[0], F.lit(" "), F.get(words, 1)), F.concat(F.lit("zz:"), words[0]), F.concat(F.lit('"'), words[0]), F.concat(words[0], F.lit(" +body:"), F.get(words, 1))]
    asked = read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.element_at(F.array(*shapes), (F.col("turn") % 4 + 1).cast("int")).alias("text"))
    return tiers.parsed(asked)


def fuzzy_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part the brand whose first part is named most alike."""
    parts = read(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    held = parts.groupBy(brand.alias("entry")).agg(F.concat_ws(" ", F.min("p_name"), F.min("p_type")).alias("text"))
    held = held.select("entry", "text", F.lit(3).alias("generation"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("entry") % 7)).alias("at"))
    asked = parts.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return search.fuzzy_lookup(asked, held, 0.5, 3, F.lit("2024-01-01 00:00:30").cast("timestamp"), 60)


def exact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the newest one of the same text, if it's new enough."""
    docs = read(spark, sf_dir, "documents")
    held = docs.select(F.col("doc_id").alias("entry"), "text", F.lit(1).alias("generation"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("doc_id") % 90)).alias("at"))
    return search.exact_lookup(docs.select(F.col("doc_id").alias("query_id"), "text"), held, 1, F.lit("2024-01-01 00:01:30").cast("timestamp"), 60)


def fact_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(read(spark, sf_dir, "documents"), "source", "text").select("doc_id", "fact_type", "type_confidence")


def query_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.is_causal("text").alias("causal"), T.signal("text", T.TEMPORAL_SIGNALS).alias("temporal"), T.causal_pattern("text").alias("causal_pattern"), T.temporal_pattern("text").alias("temporal_pattern"))


def since_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("What changed since ("), (1990 + F.col("o_orderkey") % 130).cast("string"), F.lit(")?"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.since_year(text).alias("year"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.slug(F.coalesce("text", F.lit(""))).alias("slug"))


def path_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.fnv1a64(F.concat("p_name", F.lit("/"), "p_brand")).alias("hash"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", output.excerpt("text").alias("excerpt"))


def fact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw facts, with faults of every kind put in."""
    n = F.col("doc_id")
    raw = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("/x/.brv/context-tree/"), "lang", F.lit("/"), n.cast("string"), F.lit(".md")).alias("source_path"), F.lit("h").alias("bytes"), F.col("text").alias("body"), F.when(n % 23 == 0, "yaml: broken").alias("parse_error"), (n % 29 == 0).alias("bare"),
        F.when(n % 7 == 0, "Bad Id!").when(n % 5 == 0, F.concat(F.lit(" Doc_"), n.cast("string"))).alias("id"), F.col("source").alias("title"), F.element_at(F.array(F.lit("Event"), F.lit("state"), F.lit("odd"), F.lit(None)), (n % 4 + 1).cast("int")).alias("fact_type"),
        F.when(n % 11 == 0, "soon").when(n % 2 == 0, "2024-02-03").alias("valid_until"), F.when(n % 3 == 0, "2024-01-02T03:04:05+0200").alias("created_at"), F.lit(None).cast("string").alias("updated_at"),
        F.array("lang", F.lit(" "), F.lit("x ")).alias("tags"), F.array().cast("array<string>").alias("keywords"), F.array(F.concat(F.lit(" Lang:"), F.upper("lang")), F.when(n % 17 == 0, "bad tag").otherwise("ok")).alias("domain_tags"), F.array().cast("array<string>").alias("related"),
        F.when(n % 19 == 0, F.array(F.concat("lang", F.lit("/"), n.cast("string")))).alias("caused_by"), F.lit(None).cast("array<string>").alias("causes"), (n % 13 / 10.0).cast("double").alias("confidence"),
        *(F.lit(None).cast("double").alias(c) for c in ("importance", "recency", "maturity")), F.when(n % 3 == 1, n).alias("event_sequence"), *(F.lit(None).cast("long").alias(c) for c in ("access_count", "update_count")),
    )
    made = facts.validate(raw)
    return made.select("source_path", "id", "confidence", "fact_type", F.array_join("tags", "|").alias("tags"), F.array_join("domain_tags", "|").alias("domain_tags"), "created_at", F.array_join("warnings", "; ").alias("warnings"), "error")


def customers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facts: each order causes another customer's, so the graph branches and has cycles, loops, repeated and dangling edges."""
    orders = read(spark, sf_dir, "orders").where("o_custkey is not null")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    key, custkey = F.col("o_orderkey"), F.col("o_custkey")
    out = orders.groupBy(custkey.alias("c_custkey")).agg(F.collect_list(name((key * 31 + custkey) % 2000)).alias("causes"), F.collect_list(F.when(F.col("o_orderpriority") == "1-URGENT", name(key % 1700))).alias("caused_by"))
    rows = read(spark, sf_dir, "customer").join(out, "c_custkey", "left")
    none = F.array().cast("array<string>")
    return rows.select(name(F.col("c_custkey")).alias("id"), F.coalesce("causes", none).alias("causes"), F.coalesce("caused_by", none).alias("caused_by"), F.lit(0.9).alias("confidence"), (0.5 + F.col("c_custkey") % 50 * F.lit(0.01)).alias("importance"), F.col("c_mktsegment").alias("fact_type"))


def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(customers_of(spark, sf_dir))


def causal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.report(customers_of(spark, sf_dir))


def causal_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.problems(customers_of(spark, sf_dir))


def causal_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers_of(spark, sf_dir)
    return graph.nodes(own, graph.edges(own))


def causal_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fingerprint(graph.edges(customers_of(spark, sf_dir)))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(graph.edges(customers_of(spark, sf_dir)))


def causal_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (customer, customer) within two hops, ahead."""
    edge = _edges(spark, sf_dir)
    return graph.reachable(edge.select("src"), edge, 2)


def causal_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (customer, customer) within two hops, back."""
    edge = _edges(spark, sf_dir)
    return graph.reachable(edge.select(F.col("dst").alias("src")), edge, 2, backward=True)


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest paths of up to two hops between all customers."""
    edge = _edges(spark, sf_dir)
    return graph.shortest_paths(edge.select("src"), edge, 2).select("src", "node", "hops", F.array_join("path", ">").alias("path"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("c"), (F.col("o_orderkey") % 2000).cast("string")).alias("node")).distinct()


def causal_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near orders' other customers are, ahead within two hops."""
    return graph.adjacency(_pairs(spark, sf_dir), customers_of(spark, sf_dir).select("id"), _edges(spark, sf_dir), 2)


def causal_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the causal tier finds if customers ask for causes, effects or connections, by segment."""
    kinds = F.when(F.col("c_mktsegment") == "BUILDING", "the root cause").when(F.col("c_mktsegment") == "MACHINERY", "all downstream").when(F.col("c_mktsegment") == "HOUSEHOLD", "because").otherwise("nothing")
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), kinds.alias("text"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("anchor"))
    hits = _pairs(spark, sf_dir).select(F.expr("cast(substring(src, 2) as bigint)").alias("query_id"), F.col("node").alias("key"))
    return tiers.causal(asked.select("query_id", "text"), asked.select("query_id", "anchor"), hits, _edges(spark, sf_dir), 1)


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    was = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("1-URGENT").alias("content_hash"))
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"))
    now = orders.agg(F.min("o_orderpriority").alias("content_hash"), F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"), F.max("o_orderdate").alias("valid_until"))
    return was, now


def manifest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between customers and their orders as two manifests."""
    return temporal.manifest_events(*_manifests(spark, sf_dir), F.lit("1998-01-01").cast("timestamp_ntz")).select("id", "kind", "event_ts")


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages before and after: those with an odd length were moved, those whose length is a multiple of four changed, of six touched."""
    pages = read(spark, sf_dir, "pages").select(F.concat_ws("#", "url", "page_id").alias("path"), "page_id", F.md5("html").alias("hash"), F.length("html").alias("n"))
    was = pages.select("path", F.col("page_id").alias("mtime"), "hash")
    now = pages.select(
        F.when(F.col("n") % 2 == 1, F.concat("path", F.lit("~"))).otherwise(F.col("path")).alias("path"),
        F.when((F.col("n") % 4 == 0) | (F.col("n") % 6 == 0), F.col("page_id") + 1).otherwise(F.col("page_id")).alias("mtime"),
        F.when(F.col("n") % 4 == 0, F.md5("hash")).otherwise(F.col("hash")).alias("hash"),
    )
    return temporal.changes(was, now)


def access_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("fact_id"), F.pmod("event_id", F.lit(4)).alias("gen"))
    return temporal.tally(log, 3)


def apply_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their events counted in, on top of what their orders counted before."""
    own = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 10 / 10.0).cast("double").alias("importance"), (F.col("c_custkey") % 3).alias("access_count"))
    before = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.count("*").alias("access_count"))
    made = temporal.apply_tally(own, access_tally(spark, sf_dir), before)
    return made.select("id", F.round("importance", 6).alias("importance"), "access_count")


def incremental_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after some have gone, some have changed and some have come, put together from what changed alone."""
    docs = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    was = docs.select(n.cast("string").alias("source_path"), F.md5("text").alias("hash"))
    now = docs.where(n % 10 != 3).select(n.cast("string").alias("source_path"), F.when(n % 10 == 4, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("hash"))
    now = now.unionByName(docs.where(n % 10 == 5).select(F.concat(F.lit("new/"), n.cast("string")).alias("source_path"), F.md5(F.concat(F.lit("?"), "text")).alias("hash")))
    sides = [x.select(F.col("source_path").alias("path"), F.col("hash").alias("mtime"), "hash") for x in (was, now)]
    changed = temporal.changes(*sides).select(F.col("path").alias("source_path"), "change")
    return temporal.apply_changes(was, changed, now.join(changed.select("source_path"), "source_path", "left_semi"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a temporal log of customers."""
    key = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp") + F.make_interval(years=F.lit(8))
    kind = F.when(F.col("o_orderstatus") == "F", "updated").when(F.col("o_orderstatus") == "P", "deleted").otherwise("created")
    until = F.when(key % 5 != 0, at + F.make_interval(days=(key % 2000).cast("int")))
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), kind.alias("kind"), at.alias("event_ts"), F.when(F.col("o_orderpriority") < "4", "state").otherwise("event").alias("fact_type"), until.alias("valid_until"), key.cast("int").alias("generation"))


LATE = "2007-01-01"


def temporal_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose last order is a state that holds."""
    return temporal.current_state(_log(spark, sf_dir), F.lit(LATE).cast("timestamp")).select("id", "generation", "kind")


def temporal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders that are a state that holds, each for itself."""
    return temporal.current_state(_log(spark, sf_dir), F.lit(LATE).cast("timestamp"), parity=True).select("id", "generation", "kind")


def temporal_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the temporal tier finds for a question of each kind: of now, since a year, since when nobody knows, of history, of nothing."""
    texts = F.array(*map(F.lit, ("what is current", "since 2005 or so", "since then", "their history", "none of it")))
    asked = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.element_at(texts, (F.col("r_regionkey") % 5 + 1).cast("int")).alias("text"))
    return tiers.temporally(asked, _log(spark, sf_dir), F.lit(LATE).cast("timestamp")).select("query_id", "key", F.date_format("event_ts", "yyyy-MM-dd").alias("day"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("key")).agg(F.max("l_discount").alias("bm25"), F.max("l_quantity").alias("score"))


def temporal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers found for orders, and those whose lines came back as the temporal tier's; some of these the orders hadn't."""
    back = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") + F.col("l_linenumber") % 2).alias("key")).distinct()
    return temporal.merge_temporal(back, _hits(spark, sf_dir))


def causal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As temporal_merge, with the causal tier's merge."""
    back = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") + F.col("l_linenumber") % 2).alias("key")).distinct()
    return graph.merge_causal(_hits(spark, sf_dir), back.withColumn("score", F.lit(0.7)), parity=False)


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines by quantity, judged by their status."""
    rows = read(spark, sf_dir, "lineitem")
    hits = search.best(_hits(spark, sf_dir), "score", 10)
    wanted = rows.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("tier"), F.col("l_suppkey").alias("key"))
    unwanted = rows.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("key"))
    made = search.metrics(hits, wanted, unwanted)
    return made.select("tier", *(F.round(c, 6).alias(c) for c in ("p3", "r5", "mrr")), "violations")


RULES = (
    governance.Rule("no-errors", "deny", "error", reason="errors stay"),
    governance.Rule("agents", "allow", agent="agent-1*", operations=("re*",), tags_deny=("purch*",)),
    governance.Rule("views", "allow", "view", tags_allow=("view", "public"), fact_types=("event",)),
    governance.Rule("clicks", "deny", "click", "agent-2"),
    governance.Rule("buyers", "allow", "purchase", "agent-0"),
)


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    agent = F.concat(F.lit("agent-"), F.pmod("user_id", F.lit(13)).cast("string"))
    asked = rows.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("access_type"), agent.alias("agent_id"), F.lit("read").alias("operation"), F.array("event_type").alias("domain_tags"), F.array(F.lit("event")).alias("fact_types"))
    return governance.evaluate(asked, RULES)


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of three lines, chained; then some are tampered with, some cut off and some have a wrong hash."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    n = F.col("event_id")
    rows = read(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", (F.row_number().over(by) - 1).alias("k"))
    logs = rows.groupBy(F.concat_ws("-", "user_id", F.floor(F.col("k") / 3)).alias("log")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    previous = F.lit(governance.NO_HASH)
    lines = []
    for at in range(3):
        line = F.concat(F.lit('{"v":'), F.get("ids", F.lit(at)).cast("string"), F.lit(',"prev_hash":"'), previous, F.lit('"}'))
        lines.append(line)
        previous = F.sha2(F.concat(line, F.lit("\n")), 256)
    whole = logs.select("log", F.posexplode(F.array(*lines)).alias("n", "line"), "ids").where("line is not null").withColumn("v", F.get("ids", F.col("n")))
    v = F.col("v")
    torn = F.when(v % 7 == 0, F.replace("line", F.lit('"v":'), F.lit('"v":1'))).when(v % 11 == 0, F.substring("line", 1, 20)).when(v % 13 == 0, F.replace("line", F.lit('"prev_hash":"'), F.lit('"prev_hash":"x'))).otherwise(F.col("line"))
    return governance.verify(whole.select("log", "n", torn.alias("line")))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as terms: the region is the parent, the next nation is related; regions have a zone as an equivalent."""
    k = F.col("n_nationkey")
    lists = "array<string>"
    nations = read(spark, sf_dir, "nation").select(F.lit("geo").alias("ns"), F.lower("n_name").alias("term"), F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("parent"), F.array(F.concat(F.lit("nation_"), ((k + 1) % 25).cast("string"))).alias("related"), F.array().cast(lists).alias("equivalent"))
    regions = read(spark, sf_dir, "region").select(F.lit("geo").alias("ns"), F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")).alias("term"), F.lit(None).cast("string").alias("parent"), F.array().cast(lists).alias("related"), F.array(F.concat(F.lit("zone_"), F.col("r_regionkey").cast("string"))).alias("equivalent"))
    return nations.unionByName(regions)


def ontology_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations, bare or with their namespace, expanded by two steps."""
    nation = F.concat(F.when(F.col("c_custkey") % 2 == 0, "geo:").otherwise(""), F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.concat_ws(" ", nation, "c_mktsegment").alias("text"))
    return ontology.expand(asked, _terms(spark, sf_dir), 2)


def ontology_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as tags: known, unknown, of another namespace, without one."""
    n = F.col("s_suppkey")
    tag = F.element_at(F.array(F.concat(F.lit("geo:Nation_"), (n % 30).cast("string")), F.concat(F.lit("other:"), n.cast("string")), F.concat(F.lit("nation_"), n.cast("string"))), (n % 3 + 1).cast("int"))
    return ontology.check_tags(read(spark, sf_dir, "supplier").select(tag.alias("tag")), _terms(spark, sf_dir))


_ALL = (
    token_stats, bm25_top, bm25_fields, query_syntax, compound_search, fuzzy_cache, exact_cache, fact_types, query_signals, since_years, slugs, path_hashes, excerpts, fact_checks,
    causal_edges, causal_report, causal_problems, causal_nodes, causal_fingerprint, causal_reach, causal_sources, shortest_paths, causal_adjacency, causal_tier, causal_merge,
    manifest_events, file_changes, incremental_facts, access_tally, apply_access, temporal_current, temporal_records, temporal_tier, temporal_merge, retrieval_metrics,
    policy, audit_chain, ontology_expansion, ontology_tags,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_TS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\pL\\pN]+'), lambda x: x <> '' AND strlen(x) <= 40)"
_BM25 = f"""p AS (
  SELECT field, key, token, len, count(*) AS tf FROM (
    SELECT 'text' AS field, doc_id AS key, len(ts) AS len, unnest(ts) AS token FROM (SELECT doc_id, {_TS.format("text")} AS ts FROM documents)
    UNION ALL SELECT 'source', doc_id, len(ts), unnest(ts) FROM (SELECT doc_id, {_TS.format("source")} AS ts FROM documents)) GROUP BY ALL),
df AS (SELECT field, token, count(*) AS df FROM p GROUP BY ALL),
total AS (SELECT field, sum(tf) AS size FROM p GROUP BY ALL),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TS.format("text")})) AS token FROM benchmark),
found AS (
  SELECT query_id, key, round(sum(CASE field WHEN 'text' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len * n / size)))), 6) AS bm25
  FROM q JOIN p USING (token) JOIN df USING (field, token) JOIN total USING (field), (SELECT count(*)::DOUBLE AS n FROM documents) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, key) AS place FROM found)"""


def _signal(text: str, words) -> str:
    edge = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
    own = ", ".join(f"'{w}'" for w in words if " " not in w)
    some = [f"list_has_any(list_transform(regexp_split_to_array({text}, '\\s+'), lambda w: regexp_replace(w, '{edge}', '', 'g')), [{own}])"] if own else []
    return "(" + " OR ".join([*some, *(f"contains({text}, '{w}')" for w in words if " " in w)]) + ")"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_RULES = ", ".join(f"({n}, '{r.name}', '{r.effect}', '{r.access_type}', '{r.agent}', {'NULL' if r.reason is None else repr(r.reason)}, {_list(r.operations)}, {_list(r.tags_allow)}, {_list(r.tags_deny)}, {_list(r.fact_types)})" for n, r in enumerate(RULES))
_GLOB = "(x = '*' OR x = {0} OR (x LIKE '%*' AND starts_with({0}, left(x, -1))))"


def _any(patterns: str, value: str) -> str:
    return f"len(list_filter({patterns}, lambda x: {_GLOB.format(value)})) > 0"


_GRAPH = """cs AS (SELECT 'c' || c_custkey AS id, c_custkey, c_mktsegment FROM customer),
dec AS (SELECT 'c' || o_custkey AS src, 'c' || ((o_orderkey * 31 + o_custkey) % 2000) AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'c' || (o_orderkey % 1700), 'c' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer)),
e AS (SELECT DISTINCT src, dst FROM dec WHERE src <> dst AND src IN (SELECT id FROM cs) AND dst IN (SELECT id FROM cs)),
two AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst),
hop AS (SELECT src, dst, min(h) AS h FROM (SELECT src, dst, 1 AS h FROM e UNION ALL SELECT src, dst, 2 FROM two) GROUP BY ALL)"""
_PAIRS = "SELECT DISTINCT 'c' || o_custkey AS src, 'c' || (o_orderkey % 2000) AS node FROM orders"
_WEIGHT = "CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.9::DOUBLE * (0.5::DOUBLE + (c_custkey % 50) * 0.01::DOUBLE))) * 65535) AS INTEGER)"
_LOG = f"""g AS (SELECT o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'updated' WHEN 'P' THEN 'deleted' ELSE 'created' END AS kind, o_orderdate + INTERVAL 8 YEAR AS ts,
  CASE WHEN o_orderpriority < '4' THEN 'state' ELSE 'event' END AS fact_type, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 8 YEAR + to_days(CAST(o_orderkey % 2000 AS INTEGER)) END AS until, CAST(o_orderkey AS INTEGER) AS generation FROM orders),
l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY generation DESC) = 1),
s AS (SELECT * FROM l WHERE kind <> 'deleted' AND fact_type = 'state' AND (until IS NULL OR until >= TIMESTAMP '{LATE}'))"""
_HITS = "h AS (SELECT l_orderkey AS query_id, l_suppkey AS key, max(l_discount) AS bm25, max(l_quantity) AS score FROM lineitem GROUP BY ALL)"
_BACK = "t AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey + l_linenumber % 2 AS key FROM lineitem WHERE l_returnflag = 'R')"
_FIELDS = {"title": "array_to_string(string_split(text, ' ')[1:8], ' ')", "tags": "lang", "keywords": "source", "domain_tags": "'lang:' || lang", "body": "text", "id": "'doc/' || doc_id"}
_BM25_FIELDS = f"""f AS ({" UNION ALL ".join(f"SELECT '{name}' AS field, {search.BOOSTS[name]}::DOUBLE AS boost, 'doc/' || doc_id AS key, {_TS.format(text)} AS ts FROM documents" for name, text in _FIELDS.items())}),
sizes AS (SELECT field, sum(len(ts)) AS size, count(*)::DOUBLE AS n FROM f GROUP BY field),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TS.format("text")})) AS token FROM benchmark),
p AS (SELECT field, boost, key, len(ts) AS len, unnest(ts) AS token FROM f),
c AS (SELECT field, boost, key, token, len, count(*) AS tf FROM p WHERE token IN (SELECT token FROM q) GROUP BY ALL),
df AS (SELECT field, token, count(*) AS df FROM c GROUP BY ALL),
found AS (SELECT query_id, key, round(sum(boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len * n / size)))), 6) AS bm25
  FROM q JOIN c USING (token) JOIN df USING (field, token) JOIN sizes USING (field) GROUP BY ALL)"""
ORACLE_SQL: dict[str, str] = {
    "token_stats": f"SELECT token, count(*) AS df, sum(tf)::BIGINT AS total FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TS.format('text')}) AS token FROM documents) GROUP BY ALL) GROUP BY token",
    "bm25_top": f"WITH {_BM25} SELECT query_id, key, bm25, place::INTEGER AS rank FROM ranked WHERE place <= 10",
    "compound_search": f"""WITH {_BM25}, h AS (
  SELECT query_id, key, bm25, bm25 / max(bm25) OVER (PARTITION BY query_id) * (0.5::DOUBLE + (n_chars % 50) / 100.0::DOUBLE) AS base,
    CASE lang WHEN 'fr' THEN 'state' WHEN 'de' THEN 'event' ELSE 'durable' END AS fact_type, n_chars % 400 AS days
  FROM ranked JOIN documents ON doc_id = key WHERE place <= 20),
s AS (SELECT *, CASE fact_type WHEN 'event' THEN base * 0.9::DOUBLE WHEN 'durable' THEN base ELSE CASE WHEN days < 152 THEN 0 ELSE base * CASE WHEN days < 183 THEN 1 + 0.5::DOUBLE * exp((days - 183) / 30.0::DOUBLE) ELSE 1.0 END END END AS score FROM h),
r AS (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS s1, nth_value(score, 2) OVER (PARTITION BY query_id ORDER BY score DESC, bm25 DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s2 FROM s WHERE score >= 0.5 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, bm25 DESC, key))
SELECT query_id, key, fact_type, round(score, 5) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10 AND (rank = 1 OR s2 IS NULL OR s1 - s2 >= 0.05)""",
    "fact_types": f"""WITH t AS (SELECT doc_id, lower(coalesce(source, '') || ' ' || coalesce(text, '')) AS x FROM documents),
k AS (SELECT doc_id, CASE WHEN regexp_matches(x, '{classify.DATE}') THEN 1 WHEN {_signal("x", classify.EVENT)} THEN 2 WHEN {_signal("x", classify.STATE)} THEN 3 WHEN {_signal("x", classify.DURABLE)} THEN 4 ELSE 5 END AS k FROM t)
SELECT doc_id, CASE WHEN k <= 2 THEN 'event' WHEN k = 3 THEN 'state' ELSE 'durable' END AS fact_type, ([0.9, 0.85, 0.85, 0.95, 0.4][k])::DOUBLE AS type_confidence FROM k""",
    "query_signals": f"""SELECT conv_id, turn, regexp_matches(x, '{"|".join(T.CAUSAL_SIGNALS)}') AS causal, {_signal("x", T.TEMPORAL_SIGNALS)} AS temporal,
CASE WHEN regexp_matches(x, 'caused by|root cause|upstream') THEN 'backward' WHEN regexp_matches(x, 'enables|downstream|consequence of') THEN 'forward' ELSE 'chain' END AS causal_pattern,
CASE WHEN contains(x, 'since') THEN 'since' WHEN regexp_matches(x, 'history|when did|what happened|changed') THEN 'history' ELSE 'current' END AS temporal_pattern
FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS x FROM conversations)""",
    "manifest_events": """WITH o AS (SELECT o_custkey AS id, min(o_orderpriority) AS h, max(o_orderdate) AS last, min(o_orderdate) AS first FROM orders GROUP BY 1)
SELECT c_custkey AS id, 'deleted' AS kind, TIMESTAMP '1998-01-01' AS event_ts FROM customer WHERE c_custkey NOT IN (SELECT id FROM o)
UNION ALL SELECT id, 'created', first FROM o WHERE id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT id, 'updated', last FROM o JOIN customer ON id = c_custkey WHERE h <> '1-URGENT'
UNION ALL SELECT id, 'expired', last FROM o WHERE last < TIMESTAMP '1998-01-01'""",
    "file_changes": """WITH p AS (SELECT url || '#' || page_id AS path, length(html) AS n, md5(html) AS h FROM pages)
SELECT path, CASE WHEN n % 4 = 0 THEN 'modified' ELSE 'touched' END AS change FROM p WHERE n % 4 = 0 OR n % 6 = 0
UNION ALL SELECT path, 'deleted' FROM p WHERE n % 2 = 1 UNION ALL SELECT path || '~', 'renamed' FROM p WHERE n % 2 = 1""",
    "access_tally": "SELECT CAST(user_id AS VARCHAR) AS fact_id, count(*) AS n FROM events WHERE event_id % 4 + 1 >= 3 AND user_id IS NOT NULL GROUP BY 1",
    "bm25_fields": f"WITH {_BM25_FIELDS} SELECT query_id, key, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, key)::INTEGER AS rank FROM found QUALIFY rank <= 10",
    "query_syntax": f"""WITH t AS (SELECT conv_id || ':' || turn AS query_id, turn % 4 AS k, string_split(coalesce(text, ''), ' ') AS w FROM conversations),
s AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(CASE k WHEN 0 THEN concat('title:', w[1], ' ', w[2]) WHEN 3 THEN concat(w[1], ' +body:', w[2]) END, '\\s+'), lambda x: x <> '')) AS w FROM t WHERE k IN (0, 3) AND length(regexp_replace(concat(w[1], w[2]), '[^:"]', '', 'g')) = 0),
p AS (SELECT query_id, nullif(regexp_extract(w, '^[+-]?(title|body):', 1), '') AS field, regexp_replace(w, '^[+-]?(title|body):', '') AS w, w AS whole FROM s)
SELECT DISTINCT query_id, unnest({_TS.format("w")}) AS token, field FROM p UNION ALL SELECT query_id, 'zz:' || w[1], 'title' FROM t WHERE k = 1 UNION ALL SELECT query_id, '"' || w[1], 'title' FROM t WHERE k = 2""",
    "fuzzy_cache": f"""WITH h AS (SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS entry, min(p_name) || ' ' || min(p_type) AS text FROM part GROUP BY 1),
x AS (SELECT p_partkey, list_distinct({_TS.format("p_name || ' ' || p_type")}) AS a FROM part), y AS (SELECT entry, entry % 7 AS ts, list_distinct({_TS.format("text")}) AS b FROM h),
s AS (SELECT p_partkey AS query_id, entry, ts, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM x, y)
SELECT query_id, entry, similarity FROM s WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ts DESC, entry DESC) = 1""",
    "exact_cache": "WITH h AS (SELECT text, max_by(doc_id, (doc_id % 90) * 1000000000000 + doc_id) AS entry FROM documents WHERE 90 - doc_id % 90 <= 60 AND text IS NOT NULL GROUP BY text) SELECT doc_id AS query_id, entry FROM documents JOIN h USING (text)",
    "since_years": "SELECT o_orderkey, CASE WHEN 1990 + o_orderkey % 130 BETWEEN 2000 AND 2100 THEN CAST(1990 + o_orderkey % 130 AS INTEGER) END AS year FROM orders",
    "slugs": r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')[1:6] AS w FROM conversations)
SELECT conv_id, turn, rtrim(left(rtrim(regexp_replace(regexp_replace(lower(array_to_string(w, '-')), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-'), 60), '-') AS slug FROM w""",
    "path_hashes": """WITH b AS (SELECT p_partkey, p_name || '/' || p_brand AS s FROM part),
h AS (SELECT p_partkey, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM b)
SELECT p_partkey, CAST(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END AS BIGINT) AS hash FROM h""",
    "excerpts": r"""WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\A\n*(## Raw Concept\n*)?', ''), '\A[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+\z', '') AS b FROM documents),
h AS (SELECT doc_id, b, left(b, 500) AS h, regexp_extract(left(b, 500), '(?s)\A(.*[.!?])', 1) AS s, regexp_extract(left(b, 500), '(?s)\A(.*) ', 1) AS w FROM b)
SELECT doc_id, CASE WHEN length(b) <= 500 THEN b WHEN s <> '' THEN s || '...' WHEN contains(h, ' ') THEN w || '...' ELSE h || '...' END AS excerpt FROM h""",
    "fact_checks": """WITH n AS (SELECT doc_id AS n, lang, CASE WHEN doc_id % 7 = 0 THEN 'bad id!' WHEN doc_id % 5 = 0 THEN 'doc_' || doc_id ELSE lang || '/' || doc_id END AS id,
  CASE doc_id % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'state' WHEN 2 THEN 'odd' END AS kind, CASE WHEN doc_id % 3 = 1 THEN doc_id END AS seq, (doc_id % 13 / 10.0)::DOUBLE AS confidence, CASE WHEN doc_id % 11 = 0 THEN 'soon' WHEN doc_id % 2 = 0 THEN '2024-02-03' END AS until FROM documents),
k AS (SELECT *, coalesce(kind IN ('event', 'state'), false) AS given FROM n)
SELECT '/x/.brv/context-tree/' || lang || '/' || n || '.md' AS source_path, id, confidence, CASE WHEN given THEN kind ELSE 'durable' END AS fact_type, lang || '|x ' AS tags,
  'lang:' || lang || '|' || CASE WHEN n % 17 = 0 THEN 'bad tag' ELSE 'ok' END AS domain_tags, CASE WHEN n % 3 = 0 THEN TIMESTAMP '2024-01-02 01:04:05' END AS created_at,
  array_to_string(list_filter([CASE WHEN n % 29 = 0 THEN 'no header' END, CASE WHEN confidence < 0.1 THEN 'confidence: very low' END, CASE WHEN NOT given THEN 'fact_type: taken as durable' END, CASE WHEN kind = 'event' AND seq IS NULL THEN 'event_sequence: missing' END,
    CASE WHEN seq IS NOT NULL AND (NOT given OR kind <> 'event') THEN 'event_sequence: not an event' END, CASE WHEN NOT given AND until IS NOT NULL THEN 'valid_until: durable' END], lambda x: x IS NOT NULL), '; ') AS warnings,
  CASE WHEN n % 23 = 0 THEN 'yaml: broken' WHEN n % 7 = 0 THEN 'id: invalid characters' WHEN confidence > 1 THEN 'confidence: outside [0, 1]' WHEN n % 11 = 0 THEN 'valid_until: not a time' WHEN n % 17 = 0 THEN 'domain_tags: invalid characters' WHEN n % 19 = 0 AND n % 5 <> 0 THEN 'caused_by: itself' END AS error FROM k""",
    "causal_edges": f"WITH {_GRAPH} SELECT src, dst, {_WEIGHT} AS weight FROM e JOIN cs ON id = src",
    "causal_report": f"WITH {_GRAPH}, n AS (SELECT count(*) AS n, count(*) FILTER (src = dst) AS loops, count(*) FILTER (src <> dst AND (src NOT IN (SELECT id FROM cs) OR dst NOT IN (SELECT id FROM cs))) AS gone FROM dec) SELECT (SELECT count(*) FROM e) AS edges, gone AS dangling, loops AS self_loops, n - (SELECT count(*) FROM e) - gone - loops AS duplicates FROM n",
    "causal_problems": f"WITH {_GRAPH} SELECT DISTINCT 'dangling' AS kind, src, dst FROM dec WHERE src <> dst AND (src NOT IN (SELECT id FROM cs) OR dst NOT IN (SELECT id FROM cs)) UNION ALL SELECT DISTINCT 'self_loop', src, dst FROM dec WHERE src = dst",
    "causal_nodes": f"WITH {_GRAPH} SELECT row_number() OVER (ORDER BY id) - 1 AS place, id, (0.5::DOUBLE + (c_custkey % 50) * 0.01::DOUBLE) AS importance, c_mktsegment AS fact_type, least(255, (SELECT count(*) FROM e WHERE src = id)) AS out_degree, least(255, (SELECT count(*) FROM e WHERE dst = id)) AS in_degree FROM cs",
    "causal_fingerprint": f"WITH {_GRAPH}, h AS (SELECT sha256(src || chr(0) || dst) AS h FROM e) SELECT count(*) AS edges, sum(('0x' || h[1:15])::BIGINT::HUGEINT)::HUGEINT::VARCHAR || '-' || sum(('0x' || h[16:30])::BIGINT::HUGEINT)::HUGEINT::VARCHAR AS fingerprint FROM h",
    "causal_reach": f"WITH {_GRAPH} SELECT src, dst AS node, h AS hops FROM hop",
    "causal_sources": f"WITH {_GRAPH} SELECT dst AS src, src AS node, h AS hops FROM hop",
    "shortest_paths": f"""WITH {_GRAPH}, w AS (SELECT DISTINCT src, src AS node, 0 AS hops, src AS path FROM e UNION ALL SELECT src, dst, 1, src || '>' || dst FROM e UNION ALL SELECT a.src, b.dst, 2, a.src || '>' || a.dst || '>' || b.dst FROM e a JOIN e b ON a.dst = b.src)
SELECT src, node, min(hops) AS hops, arg_min(path, (hops, string_split(path, '>'))) AS path FROM w GROUP BY src, node""",
    "causal_adjacency": f"""WITH {_GRAPH}, p AS ({_PAIRS})
SELECT p.src, p.node, CASE WHEN p.src NOT IN (SELECT id FROM cs) THEN 0 WHEN p.node NOT IN (SELECT id FROM cs) OR p.src = p.node THEN 1 WHEN h IS NULL THEN 0 ELSE pow(0.7::DOUBLE, h) END::DOUBLE AS adjacency FROM p LEFT JOIN hop ON hop.src = p.src AND hop.dst = p.node""",
    "causal_tier": f"""WITH {_GRAPH}, p AS ({_PAIRS}) SELECT c_custkey AS query_id, e.src AS key, 0.7::DOUBLE AS score FROM cs JOIN e ON e.dst = id WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, e.dst, 0.7::DOUBLE FROM cs JOIN e ON e.src = id WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT c_custkey, e.dst, 0.7::DOUBLE FROM cs JOIN e ON e.src = id JOIN p ON p.src = id AND p.node = e.dst WHERE c_mktsegment = 'HOUSEHOLD'""",
    "causal_merge": f"WITH {_HITS}, {_BACK} SELECT query_id, key, bm25, score, 2 AS tier FROM h UNION ALL SELECT query_id, key, NULL, 0.7::DOUBLE, 24 FROM t WHERE (query_id, key) NOT IN (SELECT (query_id, key) FROM h)",
    "temporal_merge": f"WITH {_HITS}, {_BACK} SELECT t.query_id, t.key, coalesce(bm25, 0) + 2.0::DOUBLE AS score, 0 AS block FROM t LEFT JOIN h ON h.query_id = t.query_id AND h.key = t.key UNION ALL SELECT query_id, key, score, 1 FROM h WHERE (query_id, key) NOT IN (SELECT (query_id, key) FROM t)",
    "incremental_facts": """SELECT CAST(doc_id AS VARCHAR) AS source_path, CASE WHEN doc_id % 10 = 4 THEN md5(text || '!') ELSE md5(text) END AS hash FROM documents WHERE doc_id % 10 <> 3
UNION ALL SELECT 'new/' || doc_id, md5('?' || text) FROM documents WHERE doc_id % 10 = 5""",
    "apply_access": """WITH n AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 4 + 1 >= 3 AND user_id IS NOT NULL GROUP BY 1), o AS (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS id, round((c_custkey % 10 / 10.0)::DOUBLE + 0.001::DOUBLE * coalesce(n, 0), 6) AS importance, CASE WHEN coalesce(n, 0) + coalesce(o, 0) > 0 THEN coalesce(n, 0) + coalesce(o, 0) ELSE c_custkey % 3 END AS access_count
FROM customer LEFT JOIN n ON user_id = c_custkey LEFT JOIN o ON o_custkey = c_custkey""",
    "temporal_current": f"WITH {_LOG} SELECT id, generation, kind FROM s",
    "temporal_records": f"WITH {_LOG} SELECT id, generation, kind FROM g WHERE fact_type = 'state' AND (until IS NULL OR until >= TIMESTAMP '{LATE}')",
    "temporal_tier": f"""WITH {_LOG}, x AS (SELECT r_regionkey AS q, id, ts FROM region, s WHERE r_regionkey % 5 = 0 UNION ALL SELECT r_regionkey, id, ts FROM region, g WHERE r_regionkey % 5 = 1 AND ts >= TIMESTAMP '2005-01-01' UNION ALL SELECT r_regionkey, id, ts FROM region, g WHERE r_regionkey % 5 IN (2, 3))
SELECT q AS query_id, id AS key, strftime(max(ts), '%Y-%m-%d') AS day FROM x GROUP BY q, id""",
    "retrieval_metrics": f"""WITH {_HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM h QUALIFY rank <= 10),
j AS (SELECT DISTINCT l_orderkey AS query_id, l_returnflag AS tier, l_suppkey AS key FROM lineitem WHERE l_linestatus = 'F'), d AS (SELECT DISTINCT query_id, key FROM j),
o AS (SELECT query_id, sum((rank <= 3)::INT) AS in3, sum((rank <= 5)::INT) AS in5, min(rank) FILTER (rank <= 5) AS first FROM b JOIN d USING (query_id, key) GROUP BY 1),
v AS (SELECT query_id, count(*) AS bad FROM b WHERE (query_id, key) IN (SELECT (l_orderkey, l_suppkey) FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1), a AS (SELECT query_id, tier, count(*) AS n FROM j GROUP BY ALL)
SELECT tier, round(avg(coalesce(in3, 0) / 3.0::DOUBLE), 6) AS p3, round(avg(coalesce(in5, 0) / n::DOUBLE), 6) AS r5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, CAST(sum(coalesce(bad, 0)) AS BIGINT) AS violations FROM a LEFT JOIN o USING (query_id) LEFT JOIN v USING (query_id) GROUP BY tier""",
    "policy": f"""WITH r AS (SELECT * FROM (VALUES {_RULES}) AS v(n, name, effect, kind, agent, why, ops, allow, deny, types)),
q AS (SELECT event_id, event_type, 'agent-' || (user_id % 13) AS who FROM events),
m AS (SELECT event_id, min(n) AS n FROM q JOIN r ON (kind = '*' OR kind = event_type) AND (agent = '*' OR {_any("[agent]", "who")})
  AND (len(ops) = 0 OR {_any("ops", "'read'")}) AND (len(allow) = 0 OR {_any("allow", "event_type")}) AND NOT {_any("deny", "event_type")} AND (len(types) = 0 OR {_any("types", "'event'")}) GROUP BY 1)
SELECT event_id AS request_id, coalesce(effect <> 'deny', false) AS allowed, name AS rule, CASE WHEN effect IS NULL THEN '{governance.NO_RULE}' WHEN effect = 'deny' THEN coalesce(why, 'denied by rule ''' || name || '''') END AS reason FROM q LEFT JOIN m USING (event_id) LEFT JOIN r USING (n)""",
    "audit_chain": f"""WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events WHERE user_id IS NOT NULL),
i AS (SELECT user_id || '-' || k // 3 AS log, list(event_id ORDER BY event_id) AS ids FROM k GROUP BY ALL),
a AS (SELECT log, ids, '{{"v":' || ids[1] || ',"prev_hash":"{governance.NO_HASH}"}}' AS l0 FROM i), b AS (SELECT *, '{{"v":' || ids[2] || ',"prev_hash":"' || sha256(l0 || chr(10)) || '"}}' AS l1 FROM a), c AS (SELECT *, '{{"v":' || ids[3] || ',"prev_hash":"' || sha256(l1 || chr(10)) || '"}}' AS l2 FROM b),
w AS (SELECT log, n, ids[n + 1] AS v, CASE n WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END AS line FROM c, (SELECT unnest([0, 1, 2]) AS n)),
t AS (SELECT log, n, CASE WHEN v % 7 = 0 THEN replace(line, '"v":', '"v":1') WHEN v % 11 = 0 THEN left(line, 20) WHEN v % 13 = 0 THEN replace(line, '"prev_hash":"', '"prev_hash":"x') ELSE line END AS line FROM w WHERE line IS NOT NULL),
d AS (SELECT log, n, line, CASE WHEN json_valid(line) THEN line ->> '$.prev_hash' END AS said, coalesce(sha256(lag(line) OVER (PARTITION BY log ORDER BY n) || chr(10)), '{governance.NO_HASH}') AS due FROM t),
x AS (SELECT log, n, CASE WHEN said IS NULL THEN 'json' WHEN said <> due THEN 'hash' END AS why FROM d)
SELECT log, CAST(coalesce(min(n) FILTER (why IS NOT NULL), count(*)) AS BIGINT) AS entries, CAST(min(n) FILTER (why IS NOT NULL) AS INTEGER) AS first_bad, arg_min(why, n) FILTER (why IS NOT NULL) AS why FROM x GROUP BY log""",
    "ontology_expansion": """WITH t AS (SELECT lower(n_name) AS term, unnest(['region_' || n_regionkey, 'nation_' || (n_nationkey + 1) % 25]) AS target FROM nation UNION ALL SELECT 'region_' || r_regionkey, 'zone_' || r_regionkey FROM region),
l AS (SELECT DISTINCT unnest([term, 'geo:' || term]) AS name, target FROM t),
z AS (SELECT c_custkey AS query_id, unnest([CASE WHEN c_custkey % 2 = 0 THEN 'geo:' ELSE '' END || 'NATION_' || c_nationkey, c_mktsegment]) AS token FROM customer),
a AS (SELECT DISTINCT query_id, target AS token FROM z JOIN l ON name = lower(token) WHERE (query_id, target) NOT IN (SELECT (query_id, token) FROM z)),
b AS (SELECT DISTINCT query_id, target AS token FROM a JOIN l ON name = lower(token) WHERE (query_id, target) NOT IN (SELECT (query_id, token) FROM z UNION ALL SELECT (query_id, token) FROM a))
SELECT query_id, token, 0 AS depth FROM z UNION ALL SELECT query_id, token, 1 FROM a UNION ALL SELECT query_id, token, 2 FROM b""",
    "ontology_tags": """WITH s AS (SELECT s_suppkey AS n, CASE s_suppkey % 3 WHEN 0 THEN 'geo:Nation_' || s_suppkey % 30 WHEN 1 THEN 'other:' || s_suppkey ELSE 'nation_' || s_suppkey END AS tag FROM supplier)
SELECT tag, CASE WHEN n % 3 <> 0 THEN 'none' WHEN lower(tag) IN (SELECT 'geo:' || lower(n_name) FROM nation) THEN 'valid' ELSE 'unknown' END AS verdict FROM s""",
}
