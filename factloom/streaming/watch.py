"""Files and access logs as streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import Config
from factloom.plans.compile import compile_changes
from factloom.plans.policy import Policy
from factloom.sources.facts import parse

ACCESS = "ts long, fact_id string, agent string, gen long"


def fact_stream(spark: SparkSession, root: str) -> DataFrame:
    """Facts of new files, as they come."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return parse(files.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content")))


def access_counts(spark: SparkSession, root: str) -> DataFrame:
    """(fact_id, gen, n), kept up to date; malformed lines are skipped."""
    log = spark.readStream.schema(ACCESS).option("mode", "DROPMALFORMED").json(root)
    return log.where("fact_id is not null").groupBy("fact_id", "gen").agg(F.count("*").alias("n"))


def watch(spark: SparkSession, root: str, out: str, config: Config | None = None, policy: Policy | None = None, every: str = "5 seconds", now: Callable[[], datetime] | None = None):
    """A query that compiles what changed in the tree, deletions too, every so often; each change is a whole generation, so no table is stale."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_: DataFrame, __: int) -> None:
        at = now() if now else datetime.now(timezone.utc).replace(tzinfo=None)
        compile_changes(spark, root, out, at, config, policy)

    return ticks.writeStream.foreachBatch(tick).trigger(processingTime=every).start()
