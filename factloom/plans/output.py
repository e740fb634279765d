"""What is shown of results: lines of JSON or text, excerpts, blocks of context for prompts."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import column

if TYPE_CHECKING:
    from factloom.plans.engine import Result

EXCERPT = 500
BEGIN, END = "<!-- context:start -->", "<!-- context:end -->"
RAW = "## Raw Concept"


def stem(path: str | None) -> str:
    """A file's name without its last ending."""
    return PurePosixPath(path or "").stem


def cut_text(text: str, most: int) -> str:
    return text[:most]


def excerpt(c: Column | str, most: int = EXCERPT) -> Column:
    """A body's beginning: without the heading that curated facts have, whole if it's short, else up to its last sentence's end or blank, with three dots."""
    body = F.regexp_replace(F.coalesce(column(c), F.lit("")), rf"\A\n*(?:{RAW}\n*)?", "")
    body = F.regexp_replace(body, r"\A\s+|\s+\z", "")
    head = F.substring(body, 1, most)
    sentence, word = F.regexp_extract(head, r"(?s)\A(.*[.!?])", 1), F.regexp_extract(head, r"(?s)\A(.*) ", 1)
    cut = F.when(sentence != "", sentence).when(head.contains(" "), word).otherwise(head)
    return F.when(F.length(body) <= most, body).otherwise(F.concat(cut, F.lit("...")))


def as_json(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, rank, value): a JSON object for each hit of ``ask``, with its body's beginning from the facts."""
    bodies = facts.select(F.col("id").alias("key"), excerpt("body").alias("body")).dropDuplicates(["key"])
    rows = hits.join(bodies, "key", "left")
    name = F.regexp_replace(F.regexp_extract("source_path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    value = F.struct(
        "rank", "score", F.coalesce("title", F.lit("")).alias("title"), name.alias("fact_id"), "source_path", "fact_type", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("body", F.lit("")).alias("body"), F.col("tier").alias("cache_tier"), F.lit(None).cast("string").alias("answer"),
    )
    return rows.select("query_id", "rank", F.to_json(value, {"ignoreNullFields": "false"}).alias("value"))


def as_text(hits: DataFrame) -> DataFrame:
    """(query_id, rank, value): a line for each hit."""
    line = F.format_string("  %d. [score: %.3f] %s (%s)", F.col("rank"), F.col("score"), F.coalesce("title", F.lit("<untitled>")), F.coalesce("source_path", F.lit("")))
    return hits.select("query_id", "rank", line.alias("value"))


def json_lines(result: Result, bodies: dict[str, str]) -> list[str]:
    """As ``as_json`` for one query's result. bodies: excerpts by id."""
    return [
        json.dumps(
            {
                "rank": n, "score": h["score"], "title": h.get("title") or "", "fact_id": stem(h.get("source_path")), "source_path": h.get("source_path"), "fact_type": h.get("fact_type"),
                "tags": list(h.get("tags") or []), "body": bodies.get(h["id"], ""), "cache_tier": result.meta.tier, "answer": h.get("answer"),
            }
        )
        for n, h in enumerate(result.hits, 1)
    ]


def text_lines(result: Result) -> list[str]:
    if not result.hits:
        return ["No results found."]
    head = f"Found {len(result.hits)} result(s) [tier {result.meta.tier}, {result.meta.query_ms}ms, gen {result.meta.generation}]:"
    return [head, *(f"  {n}. [score: {h['score']:.3f}] {h.get('title') or '<untitled>'} ({h.get('source_path') or ''})" for n, h in enumerate(result.hits, 1))]


@dataclass(frozen=True)
class Enrich:
    max_facts: int = 5
    min_score: float = 0.0
    include_metadata: bool = False
    fallback: str | None = None
    agent_id: str = "plugin"


@dataclass(frozen=True)
class Enriched:
    context_block: str
    from_index: bool
    fact_count: int
    tier: int | None
    stale: bool


def context_block(result: Result, options: Enrich | None = None) -> str:
    """Markdown between two marks: a part for each hit."""
    options = options or Enrich()
    head = f"## Context (auto-enriched)\n\n{BEGIN}\n"
    if not result.hits:
        return f"{head}_No relevant facts found for this task._\n{END}"
    parts = []
    for h in result.hits:
        lines = [f"### {h['id'] if h.get('title') is None else h['title']}", f"**Type:** {h.get('fact_type') or 'durable'} | **Confidence:** {h.get('confidence') or 0.0:.2f}"]
        lines += [f"**{name}:** {', '.join(h[key])}" for name, key in (("Tags", "domain_tags"), ("Keywords", "keywords"), ("Related", "related"), ("Caused by", "caused_by")) if h.get(key)]
        if options.include_metadata:
            lines.append(f"**Score:** {h['score']:.3f} | **Tier:** {result.meta.tier} | **Gen:** {result.meta.generation}")
            if (h.get("maturity") if h.get("maturity") is not None else 1.0) < 1.0:
                lines.append(f"**Maturity:** {h['maturity']:.2f}")
            lines += [f"**{name}:** {h[key]} times" for name, key in (("Accessed", "access_count"), ("Updated", "update_count")) if h.get(key)]
        parts.append("\n".join(lines) + f"\n\n_Source: {h.get('source_path') or ''}_\n")
    return head + "\n".join(parts) + END
