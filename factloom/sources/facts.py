"""Markdown facts with YAML headers, as rows.

Splitting the header off and reading YAML needs Python; it's done by Arrow batch,
one task per split of the files. All rules of validation are column expressions.
Unreadable rows aren't dropped: they carry the reason in ``error``.
"""

from __future__ import annotations

import json
import os
import re

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALIASES = {"factType": "fact_type", "domainTags": "domain_tags", "causedBy": "caused_by", "validUntil": "valid_until", "createdAt": "created_at", "updatedAt": "updated_at", "eventSequence": "event_sequence", "accessCount": "access_count", "updateCount": "update_count"}
LISTS = ("tags", "keywords", "domain_tags", "related", "caused_by", "causes")
NUMBERS = ("confidence", "importance", "recency", "maturity")
COUNTS = ("event_sequence", "access_count", "update_count")
TEXTS = ("id", "title", "fact_type", "valid_until", "created_at", "updated_at")
RAW = ", ".join([*(f"{c} string" for c in TEXTS), *(f"{c} array<string>" for c in LISTS), *(f"{c} double" for c in NUMBERS), *(f"{c} long" for c in COUNTS)])
_HEADER = re.compile(r"\A---\n(.*?)^---(?:\n|\Z)\n*(.*)\Z", re.S | re.M)


def split_header(text: str) -> tuple[str | None, str]:
    """(header, body); no header unless the text begins with a closed one."""
    found = _HEADER.match(text)
    return (found[1], found[2]) if found else (None, text)


def _parsed(text: str | bytes | None) -> tuple[str | None, str, str | None]:
    """(header as JSON, body, error)."""
    import yaml

    if isinstance(text, bytes):
        try:
            text = text.decode("utf-8")
        except UnicodeDecodeError as error:
            return None, "", f"encoding: {error.reason} at byte {error.start}"
    header, body = split_header(text or "")
    if header is None:
        return None, body, None
    try:
        found = yaml.load(header, Loader=yaml.BaseLoader) or {}
        typed = yaml.safe_load(header) or {}
    except yaml.YAMLError as error:
        return None, body, f"yaml: {str(error).splitlines()[0]}"
    if not isinstance(found, dict):
        return None, body, "yaml: not a mapping"
    row = {}
    for key, value in found.items():
        name = ALIASES.get(key, key)
        if name in row and row[name] is not None:
            continue
        real = typed.get(key)
        if real is None:
            continue
        if name in LISTS:
            if not isinstance(value, list):
                return None, body, f"{name}: not a list"
            row[name] = [str(x) for x in value]
        elif name in NUMBERS or name in COUNTS:
            if isinstance(real, bool) or not isinstance(real, (int, float) if name in NUMBERS else int):
                return None, body, f"{name}: not a number"
            row[name] = real
        elif name in TEXTS:
            if isinstance(real, (list, dict, bool)) or name == "title" and not isinstance(real, str):
                return None, body, f"{name}: not a string"
            row[name] = value
    return json.dumps(row), body, None


def parse(files: DataFrame) -> DataFrame:
    """Validated facts of (source_path, content) rows, the content as bytes or text. Bytes that aren't UTF-8 are that row's error."""

    def run(frames):
        for frame in frames:
            header, body, error = zip(*map(_parsed, frame["content"])) if len(frame) else ((), (), ())
            yield pd.DataFrame({"source_path": frame["source_path"], "bytes": frame["bytes"], "header": header, "body": body, "error": error})

    rows = files.select("source_path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("bytes"))
    rows = rows.mapInPandas(run, "source_path string, bytes string, header string, body string, error string")
    raw = F.from_json(F.coalesce("header", F.lit("{}")), RAW)
    return validate(rows.select("source_path", "bytes", "body", F.col("error").alias("parse_error"), F.col("header").isNull().alias("bare"), raw.alias("h")).select("source_path", "bytes", "body", "parse_error", "bare", "h.*"))


def _walk(fs, folder: str, deep: bool) -> list[tuple[str, int, bool]]:
    """(path, time of change in microseconds, whether a folder) of a folder's Markdown files and, unless all below is asked for, its folders; hidden ones are left out."""
    out = []
    folders = [folder]
    while folders:
        try:
            found = fs.get_file_info(pafs.FileSelector(folders.pop()))
        except OSError:
            if not out and not deep:
                raise
            continue  # what can't be read is skipped
        for x in found:
            if x.base_name.startswith("."):
                continue
            if x.type == pafs.FileType.Directory:
                folders.append(x.path) if deep else out.append((x.path, 0, True))
            elif x.type == pafs.FileType.File and x.base_name.endswith(".md"):
                out.append((x.path, int((x.mtime_ns or 0) // 1000), False))
    return out


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, mtime) of all ``.md`` files below root but for hidden files and folders; root itself may lie in a hidden one.

    The root is listed here, what lies below each of its folders by the tasks. (Spark's
    own listing would leave out names that begin with an underline.)
    """
    fs, path = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root))
    top = _walk(fs, path, deep=False)
    files = spark.createDataFrame([(p, t) for p, t, folder in top if not folder], "source_path string, mtime long")

    def below(frames):
        own = pafs.FileSystem.from_uri(root)[0] if "://" in root else pafs.LocalFileSystem()
        for frame in frames:
            for folder in frame["folder"]:
                found = _walk(own, folder, deep=True)
                yield pd.DataFrame({"source_path": [x[0] for x in found], "mtime": pd.Series([x[1] for x in found], dtype="int64")})

    folders = [(p,) for p, _, folder in top if folder]
    if not folders:
        return files
    rows = spark.createDataFrame(folders, "folder string").repartition(min(len(folders), 10 * spark.sparkContext.defaultParallelism))
    return files.unionAll(rows.mapInPandas(below, "source_path string, mtime long"))


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """The files with their content, as bytes; null where a file has gone since."""

    def run(frames):
        fs = pafs.FileSystem.from_uri(root)[0] if "://" in root else pafs.LocalFileSystem()
        for frame in frames:
            for lo in range(0, len(frame), 256):
                own = frame.iloc[lo : lo + 256]
                content = []
                for path in own["source_path"]:
                    try:
                        with fs.open_input_stream(path) as f:
                            content.append(f.read())
                    except OSError:
                        content.append(None)
                yield own.assign(content=content)

    return files.select("source_path", "mtime").mapInPandas(run, "source_path string, mtime long, content binary")


def read_facts(spark: SparkSession, root: str) -> DataFrame:
    """Validated facts of all files below root."""
    return parse(read_contents(list_files(spark, root), root).where("content is not null"))


def _time(c: str):
    """Zone given or UTC; a lone date is its midnight."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), r"([+-]\d\d)(\d\d)$", "$1:$2"))


def validate(raw: DataFrame) -> DataFrame:
    """Defaults, normal forms and checks. The first failing check, in a fixed order, is the ``error``."""
    derived = F.coalesce(F.nullif(F.regexp_extract("source_path", r"\.brv/context-tree/(.*)\.md$", 1), F.lit("")), F.regexp_extract("source_path", r"([^/]*?)(?:\.md)?$", 1))
    given = F.lower(F.trim("id"))
    ident = F.coalesce(given, derived)
    lists = {c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "") for c in LISTS}
    lists["domain_tags"] = F.transform(lists["domain_tags"], lambda x: F.lower(F.trim(x)))
    confidence = F.coalesce("confidence", F.lit(1.0))
    times = ("created_at", "updated_at", "valid_until")
    kind = F.lower("fact_type")
    error = F.coalesce(
        F.col("parse_error"),
        F.when(given.isNotNull() & ~given.rlike("^[a-z0-9_/-]+$"), "id: invalid characters"),
        F.when(~confidence.between(0, 1), "confidence: outside [0, 1]"),
        *(F.when(F.col(c).isNotNull() & _time(c).isNull(), f"{c}: not a time") for c in times),
        F.when(F.exists(lists["domain_tags"], lambda x: ~x.rlike("^[a-z0-9_:-]+$")), "domain_tags: invalid characters"),
        F.when(F.array_contains(lists["caused_by"], ident), "caused_by: itself"),
    )
    explicit = F.coalesce(kind.isin("durable", "state", "event"), F.lit(False))
    warnings = F.filter(
        F.array(
            F.when(F.col("bare"), "no header"),
            F.when(confidence < 0.1, "confidence: very low"),
            F.when(~explicit, "fact_type: taken as durable"),
            F.when((kind == "event") & F.col("event_sequence").isNull(), "event_sequence: missing"),
            F.when(F.col("event_sequence").isNotNull() & (~explicit | (kind != "event")), "event_sequence: not an event"),
            F.when((~explicit | (kind == "durable")) & F.col("valid_until").isNotNull(), "valid_until: durable"),
        ),
        lambda x: x.isNotNull(),
    )
    return raw.select(
        ident.alias("id"),
        "source_path",
        "title",
        "body",
        *(lists[c].alias(c) for c in LISTS),
        confidence.alias("confidence"),
        *(F.coalesce(c, F.lit(1.0)).alias(c) for c in NUMBERS[1:]),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[1:]),
        *(_time(c).alias(c) for c in times),
        F.when(explicit, kind).otherwise("durable").alias("fact_type"),
        explicit.alias("fact_type_explicit"),
        "event_sequence",
        F.col("bytes").alias("content_hash"),
        warnings.alias("warnings"),
        error.alias("error"),
    )
