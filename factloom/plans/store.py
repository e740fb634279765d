"""Tables by generation, and the state rows that make them visible.

A compile writes its tables under ``generation=N`` and then appends a row to
``state``; readers take the generation of the last row, so they never see half a
compile. Rows that only mark the tables as dirty repeat the generation.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the tables' columns; others' tables are left aside and everything is compiled anew.
VERSION = 2
STATE = "seq long, generation int, dirty boolean, dirty_since timestamp, compiled_at timestamp, took_ms long, files long, version int"


class IndexNotFound(Exception):
    """No compile has been committed in the folder."""


@dataclass(frozen=True)
class State:
    seq: int = 0
    generation: int = 0
    dirty: bool = False
    dirty_since: datetime | None = None
    compiled_at: datetime | None = None
    took_ms: int | None = None
    files: int = 0
    version: int = VERSION


def read_state(spark: SparkSession, out: str) -> State:
    """The last state; one of generation 0 if there's none, or only of another version."""
    try:
        row = spark.read.schema(STATE).parquet(f"{out}/state").where(F.col("version") == VERSION).orderBy(F.desc("seq")).first()
    except AnalysisException:
        row = None
    return State(**row.asDict()) if row else State()


def write_state(spark: SparkSession, out: str, state: State) -> None:
    values = [(state.seq, state.generation, state.dirty, state.dirty_since, state.compiled_at, state.took_ms, state.files, state.version)]
    spark.createDataFrame(values, STATE).coalesce(1).write.mode("append").parquet(f"{out}/state")


def set_dirty(spark: SparkSession, out: str, now: datetime) -> State:
    """Mark that facts have changed since the last compile."""
    was = read_state(spark, out)
    new = State(was.seq + 1, was.generation, True, now, was.compiled_at, was.took_ms, was.files)
    write_state(spark, out, new)
    return new


def generation(spark: SparkSession, out: str) -> int:
    return read_state(spark, out).generation


def table(spark: SparkSession, out: str, name: str, at: int | None = None) -> DataFrame:
    """A table of a generation, the last by default; IndexNotFound if nothing has been compiled."""
    at = generation(spark, out) if at is None else at
    if not at:
        raise IndexNotFound(out)
    return spark.read.parquet(f"{out}/{name}/generation={at}")


def log(spark: SparkSession, out: str, at: int | None = None, delta: bool = False) -> DataFrame:
    """The temporal log with its generations: what all compiles up to one found, or (delta) that one alone."""
    at = generation(spark, out) if at is None else at
    if not at:
        raise IndexNotFound(out)
    rows = spark.read.option("basePath", f"{out}/temporal_log").parquet(f"{out}/temporal_log")
    return rows.where(F.col("generation") == at if delta else F.col("generation") <= at)


def write(df: DataFrame, out: str, name: str, at: int) -> DataFrame:
    """Write a generation's table; returns it as read from there."""
    df.write.mode("overwrite").parquet(f"{out}/{name}/generation={at}")
    return df.sparkSession.read.parquet(f"{out}/{name}/generation={at}")
