"""Ontology: tag checks and query expansion. Tables: namespaces (ns, prefix_only) and edges (ns, term, rel, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version int, namespaces map<string,struct<label:string,terms:map<string,struct<parent:string,related:array<string>,equivalent:array<string>>>>>"
MOST_DEPTH = 3


def read(spark: SparkSession, path: str) -> DataFrame:
    """(ns, term, parent, related, equivalent); a namespace without terms has one row with a null term."""
    rows = spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.explode("namespaces").alias("ns", "n"))
    return rows.select(F.lower("ns").alias("ns"), F.explode_outer("n.terms").alias("term", "t")).select("ns", F.lower("term").alias("term"), "t.*")


def check_tags(tags: DataFrame, terms: DataFrame) -> DataFrame:
    """(tag, verdict): none (nothing to check against), valid or unknown."""
    parts = F.split(F.lower("tag"), ":", 2)
    asked = tags.select("tag", parts[0].alias("ns"), F.when(F.size(parts) > 1, parts[1]).alias("term"))
    spaces = terms.groupBy("ns").agg(F.count("term").alias("n"))
    known = terms.where("term is not null").select("ns", "term", F.lit(True).alias("known")).distinct()
    found = asked.join(spaces, "ns", "left").join(known, ["ns", "term"], "left")
    verdict = F.when(F.col("term").isNull() | F.col("n").isNull(), "none").when((F.col("n") == 0) | F.col("known").isNotNull(), "valid").otherwise("unknown")
    return found.select("tag", verdict.alias("verdict"))


def expand(queries: DataFrame, terms: DataFrame, depth: int = 1) -> DataFrame:
    """(query_id, token, depth): the tokens, and what they're related to within depth steps; bare tokens look in all namespaces."""
    targets = F.concat(F.array("parent"), F.coalesce("related", F.array().cast("array<string>")), F.coalesce("equivalent", F.array().cast("array<string>")))
    links = terms.select("ns", "term", F.explode(F.filter(targets, lambda x: x.isNotNull())).alias("target"))
    links = links.select(F.explode(F.array("term", F.concat_ws(":", "ns", "term"))).alias("name"), "target").distinct()
    seen = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).alias("token"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, min(depth, MOST_DEPTH) + 1):
        ahead = frontier.join(links, F.lower("token") == F.col("name")).select("query_id", F.col("target").alias("token"), F.lit(d).alias("depth")).distinct()
        frontier = ahead.join(seen.select("query_id", "token"), ["query_id", "token"], "left_anti").select("query_id", "token", "depth")
        seen = seen.union(frontier)
    return seen


def expanded_text(queries: DataFrame, terms: DataFrame, depth: int = 1) -> DataFrame:
    """(query_id, text) with the added tokens at the end."""
    found = expand(queries, terms, depth).groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("depth") > 0, F.struct("depth", "token")))).alias("more"))
    return queries.join(found, "query_id", "left").select("query_id", F.concat_ws(" ", "text", F.array_join(F.col("more.token"), " ")).alias("text"))


def links(terms: DataFrame) -> DataFrame:
    """(src, dst) among terms as ns:term; a bare target lies in its term's namespace."""
    targets = F.filter(F.concat(F.array("parent"), F.coalesce("related", F.array().cast("array<string>")), F.coalesce("equivalent", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    rows = terms.where("term is not null").select("ns", "term", F.explode(targets).alias("t"))
    full = F.when(F.lower("t").contains(":"), F.lower("t")).otherwise(F.concat_ws(":", "ns", F.lower("t")))
    return rows.select(F.concat_ws(":", "ns", "term").alias("src"), full.alias("dst"))


def cycles(terms: DataFrame) -> list[list[str]]:
    """Cycles among terms, as ``graph.cycles`` gives them."""
    from factloom.operators.graph import cycles as of

    return of(links(terms))
