"""Compiling a tree of facts into tables, in full or only what changed.

Tables of a generation: facts, rejected, postings (sorted by token, so that a
query reads few of their row groups), token_stats, field_sizes, edges, nodes,
problems, tag_warnings, fingerprints, type_cache; and temporal_log, to which each
generation adds its part.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import Config
from factloom.operators import classify, graph, ontology, search, temporal
from factloom.plans import store
from factloom.plans.policy import Policy, Request
from factloom.plans.store import State
from factloom.sources.facts import list_files, parse, read_contents

#: Postings of about so many rows are a file, so that a token's are found in few.
ROWS_PER_FILE = 20_000_000
AGENT = "cli"


def compile_tree(spark: SparkSession, root: str, out: str, now: datetime, access_log: DataFrame | str | None = None, config: Config | None = None, policy: Policy | None = None, agent: str = AGENT, classifier: Callable | None = None) -> int:
    """Write all tables of the tree's valid facts; returns the new generation. Rows with errors are written to ``rejected``.

    access_log: rows (ts, fact_id, agent, gen), or the folder they were appended to, which is emptied after the commit.
    classifier: for facts whose type the rules leave open (see ``classify.by_callable``).
    """
    config, policy = config or Config(), policy or Policy.allow()
    policy.demand(Request("write", "compile", agent))
    began = time.monotonic()
    was = store.read_state(spark, out)
    last, new = was.generation, was.generation + 1
    files = read_contents(list_files(spark, root), root)
    parsed = store.write(with_files(parse(files.where("content is not null")), files), out, "parsed", new)
    facts = parsed.where("error is null").drop("error")
    facts = typed(spark, out, facts, last, new, config, classifier)
    if access_log is not None and config.tracking:
        rows = read_access(spark, access_log) if isinstance(access_log, str) else access_log
        old = store.table(spark, out, "facts", last) if last else facts.limit(0)
        facts = temporal.apply_tally(facts, temporal.tally(rows, last), old.select("id", "access_count"), config.importance_delta)
    commit(spark, out, was, now, began, facts, parsed.where("error is not null"), prints(parsed), config)
    if isinstance(access_log, str) and config.tracking:
        rows.limit(0).write.mode("overwrite").json(access_log)
    return new


def compile_changes(spark: SparkSession, root: str, out: str, now: datetime, config: Config | None = None, policy: Policy | None = None, agent: str = AGENT, classifier: Callable | None = None) -> tuple[int, dict[str, int]]:
    """Compile only what changed since the last generation; returns the generation and how many files changed in what way.

    Files whose time is the same aren't read. Without an earlier compile all is
    compiled; without a change nothing is, though new times are kept. What comes out
    is what a full compile gives, but that the access log isn't counted and changed
    facts fall back to their own counts. A renamed file is one gone and one added.
    """
    config, policy = config or Config(), policy or Policy.allow()
    was = store.read_state(spark, out)
    if not was.generation:
        new = compile_tree(spark, root, out, now, None, config, policy, agent, classifier)
        return new, {"added": store.table(spark, out, "fingerprints", new).count()}
    policy.demand(Request("write", "compile", agent))
    began = time.monotonic()
    last, new = was.generation, was.generation + 1
    before = store.table(spark, out, "fingerprints", last)
    known = before.select("source_path", F.col("mtime").alias("was_mtime"))
    listed = list_files(spark, root)
    fresh = listed.join(known, "source_path", "left").where("was_mtime is null or was_mtime <> mtime").select("source_path", "mtime")
    contents = read_contents(fresh, root).where("content is not null")
    parsed = store.write(with_files(parse(contents), contents), out, "parsed", new)
    found = prints(parsed)
    kept = before.join(listed.select("source_path"), "source_path", "left_semi").join(found.select("source_path"), "source_path", "left_anti")
    now_prints = kept.unionByName(found)
    old, cur = (x.select(F.col("source_path").alias("path"), "mtime", "hash") for x in (before, now_prints))
    change = temporal.changes(old, cur)
    counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
    if not set(counts) - {"touched"}:
        if counts:  # only times: they're written as another state of the same tables
            store.write(now_prints, out, "fingerprints_touched", new)
            store.write(spark.read.parquet(f"{out}/fingerprints_touched/generation={new}"), out, "fingerprints", last)
        return last, counts
    touched = change.where("change = 'touched'").select(F.col("path").alias("source_path"))
    parsed = parsed.join(touched, "source_path", "left_anti")
    gone = change.where("change <> 'touched'").select(F.col("path").alias("source_path"))
    fresh_facts = typed(spark, out, parsed.where("error is null").drop("error", "mtime"), last, new, config, classifier)
    facts = temporal.apply_changes(store.table(spark, out, "facts", last), gone, fresh_facts)
    bad = temporal.apply_changes(store.table(spark, out, "rejected", last), gone, parsed.where("error is not null").select("source_path", "error"))
    commit(spark, out, was, now, began, facts, bad, now_prints, config, gone)
    return new, counts


def with_files(parsed: DataFrame, files: DataFrame) -> DataFrame:
    return parsed.join(files.select("source_path", "mtime"), "source_path")


def prints(parsed: DataFrame) -> DataFrame:
    """(source_path, mtime, hash) of the files read, those with errors too."""
    return parsed.select("source_path", "mtime", F.col("content_hash").alias("hash"))


def read_access(spark: SparkSession, path: str) -> DataFrame:
    """The access log's lines; malformed ones are skipped."""
    return spark.read.schema("ts long, fact_id string, agent string, gen long").option("mode", "DROPMALFORMED").json(path)


def typed(spark: SparkSession, out: str, facts: DataFrame, last: int, new: int, config: Config, classifier: Callable | None) -> DataFrame:
    """Facts with their types, from the cache, the rules and the callable; what's found is cached for the next generation."""
    cache = store.table(spark, out, "type_cache", last) if last else spark.createDataFrame([], "body_hash string, fact_type string")
    if not config.classify and classifier is None:
        store.write(cache, out, "type_cache", new)
        return facts
    facts, sure = classify.classify_cached(facts, cache)
    if classifier is not None:
        facts, more = classify.by_callable(facts, cache.unionByName(sure), classifier, config.max_tokens_per_compile)
        sure = sure.unionByName(more)
    store.write(cache.unionByName(sure), out, "type_cache", new)
    return facts


def commit(spark: SparkSession, out: str, was: State, now: datetime, began: float, facts: DataFrame, rejected: DataFrame, fingerprints: DataFrame, config: Config, gone: DataFrame | None = None) -> None:
    """Write all tables of a generation and make it visible. gone: paths whose facts are no longer as they were; the other facts' postings are taken over."""
    last, new = was.generation, was.generation + 1
    facts = store.write(facts.drop("mtime"), out, "facts", new)
    store.write(rejected.select("source_path", "error"), out, "rejected", new)
    files = store.write(fingerprints, out, "fingerprints", new).count()
    previous = store.table(spark, out, "facts", last) if last else facts.limit(0)
    fields = search.BOOSTS
    if gone is None:
        post = search.postings(facts, "id", fields)
    else:
        changed = facts.join(gone, "source_path", "left_semi")
        stale = previous.join(gone, "source_path", "left_semi").select(F.col("id").alias("key")).union(changed.select("id")).distinct()
        post = store.table(spark, out, "postings", last).join(stale, "key", "left_anti")
        again = facts.join(stale.withColumnRenamed("key", "id"), "id", "left_semi")
        post = post.unionByName(search.postings(again, "id", fields))
    post = store.write(post.repartitionByRange("token").sortWithinPartitions("token", "field", "key"), out, "postings", new)
    store.write(search.token_stats(post).sortWithinPartitions("token"), out, "token_stats", new)
    store.write(search.field_sizes(facts, "id", fields).coalesce(1), out, "field_sizes", new)
    edge = store.write(graph.edges(facts), out, "edges", new)
    store.write(graph.nodes(facts, edge), out, "nodes", new)
    store.write(graph.problems(facts), out, "problems", new)
    if config.ontology:
        tags = facts.select("id", F.explode("domain_tags").alias("tag"))
        unknown = ontology.check_tags(tags.select("tag").distinct(), ontology.read(spark, config.ontology)).where("verdict = 'unknown'")
        store.write(tags.join(unknown.select("tag"), "tag").select("id", "tag"), out, "tag_warnings", new)
    events = temporal.manifest_events(previous, facts, F.lit(now).cast("timestamp"))
    store.write(events.sortWithinPartitions("event_ts"), out, "temporal_log", new)
    took = int((time.monotonic() - began) * 1000)
    store.write_state(spark, out, dataclasses.replace(was, seq=was.seq + 1, generation=new, dirty=False, dirty_since=None, compiled_at=now, took_ms=took, files=files))
