"""Change detection and the temporal log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CARRIED = ("source_path", "fact_type", "valid_until", "created_at", "content_hash")


def manifest_events(previous: DataFrame, current: DataFrame, compiled_at: Column) -> DataFrame:
    """(id, kind, event_ts, and what of CARRIED the current manifest has) of what changed between two manifests (id, content_hash, created_at, updated_at, valid_until): one outer join.

    An expired fact is told of at every compile. Of a deleted one its last row is carried.
    """
    carried = [c for c in CARRIED if c in current.columns]
    p = previous.select("id", F.col("content_hash").alias("was"), F.lit(True).alias("there"), *(F.col(c).alias(f"was_{c}") for c in carried if c in previous.columns))
    c = current.select("id", "content_hash", "updated_at", *(F.col(x).alias(f"now_{x}") for x in {"created_at", "valid_until", *carried}), F.lit(True).alias("here"))
    both = c.join(p, "id", "full")

    def event(on: Column, kind: str, at: Column) -> Column:
        return F.when(on, F.struct(F.lit(kind).alias("kind"), at.alias("event_ts")))

    here, there = F.col("here").isNotNull(), F.col("there").isNotNull()
    found = F.array(
        event(here & ~there, "created", F.col("now_created_at")),
        event(here & there & ~F.col("content_hash").eqNullSafe(F.col("was")), "updated", F.col("updated_at")),
        event(here & (F.col("now_valid_until") < compiled_at), "expired", F.col("now_valid_until")),
        event(~here & there, "deleted", compiled_at),
    )
    own = [F.when(here, F.col(f"now_{x}")).otherwise(F.col(f"was_{x}") if f"was_{x}" in p.columns else F.lit(None)).alias(x) for x in carried]
    return both.select("id", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e"), *own).select("id", "e.kind", "e.event_ts", *carried)


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, modified, touched (same content, other time), deleted or renamed (content that a deleted file had). Tables (path, mtime, hash); the unchanged aren't listed."""
    p = previous.select("path", F.col("mtime").alias("was_time"), F.col("hash").alias("was"), F.lit(True).alias("there"))
    c = current.select("path", "mtime", "hash", F.lit(True).alias("here"))
    both = c.join(p, "path", "full")
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(F.col("mtime").eqNullSafe(F.col("was_time")), None)
    change = change.when(F.col("hash").eqNullSafe(F.col("was")), "touched").otherwise("modified")
    marked = both.select("path", change.alias("change"), F.coalesce("hash", "was").alias("h")).where("change is not null")
    gone = marked.where("change = 'deleted'").select("h", F.lit(True).alias("moved")).distinct()
    marked = marked.join(gone, "h", "left")
    return marked.select("path", F.when((F.col("change") == "added") & F.col("moved").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"))


def apply_changes(facts: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """The facts without the rows of the paths that went or changed, and with the new ones."""
    paths = gone.select("source_path").union(fresh.select("source_path")).distinct()
    return facts.join(paths, "source_path", "left_anti").unionByName(fresh)


def latest(log: DataFrame) -> DataFrame:
    """Of each fact (id) the last record by generation; in one generation a deletion, an update, a creation and then an expiry count."""
    order = F.create_map(*(F.lit(x) for pair in (("deleted", 4), ("updated", 3), ("created", 2), ("expired", 1)) for x in pair))
    newest = F.max_by(F.struct(*(c for c in log.columns)), F.struct("generation", order[F.col("kind")], "event_ts")).alias("r")
    return log.groupBy("id").agg(newest).select("r.*")


def current_state(log: DataFrame, now: Column, parity: bool = False) -> DataFrame:
    """States that hold now: of each fact by its last record, unless it's deleted; with parity by every record of the log for itself."""
    rows = log if parity else latest(log).where("kind <> 'deleted'")
    return rows.where((F.col("fact_type") == "state") & (F.col("valid_until").isNull() | (F.col("valid_until") >= now)))


def since(log: DataFrame, at: Column) -> DataFrame:
    """Records from a time on; a null time, as an unreadable one gives, is the epoch."""
    return log.where(F.col("event_ts") >= F.coalesce(at, F.lit("1970-01-01").cast("timestamp")))


def history(log: DataFrame) -> DataFrame:
    """All records, the newest first, those without a time last."""
    return log.orderBy(F.desc_nulls_last("event_ts"), "id")


def history_of(log: DataFrame, source_path: str) -> DataFrame:
    return log.where(F.col("source_path") == source_path)


BOOST = 2.0


def merge_temporal(temporal: DataFrame, hits: DataFrame) -> DataFrame:
    """Temporal rows (query_id, key) score their hit's BM25 plus 2; hits of other facts follow. block orders the two."""
    scored = temporal.join(hits.select("query_id", "key", "bm25"), ["query_id", "key"], "left").select("query_id", "key", (F.coalesce("bm25", F.lit(0.0)) + BOOST).alias("score"), F.lit(0).alias("block"))
    rest = hits.join(temporal.select("query_id", "key"), ["query_id", "key"], "left_anti").select("query_id", "key", "score", F.lit(1).alias("block"))
    return scored.unionByName(rest)


def tally(log: DataFrame, generation: int) -> DataFrame:
    """(fact_id, n) of the access log (fact_id, gen), without entries more than a generation old."""
    kept = log if generation <= 1 else log.where(F.col("gen") + 1 >= generation)
    return kept.where("fact_id is not null").groupBy("fact_id").agg(F.count("*").alias("n"))


def apply_tally(facts: DataFrame, counts: DataFrame, previous: DataFrame, delta: float = 0.001) -> DataFrame:
    """Facts with access_count and importance raised. previous: (id, access_count) of the last index."""
    now = counts.select(F.col("fact_id").alias("id"), F.col("n").alias("__now"))
    old = previous.where("access_count > 0").select("id", F.col("access_count").alias("__old"))
    total = F.coalesce("__now", F.lit(0)) + F.coalesce("__old", F.lit(0))
    joined = facts.join(now, "id", "left").join(old, "id", "left")
    joined = joined.withColumn("importance", F.col("importance") + F.when(total > 0, delta * F.coalesce("__now", F.lit(0))).otherwise(0.0))
    return joined.withColumn("access_count", F.when(total > 0, total).otherwise(F.col("access_count"))).select(facts.columns)
