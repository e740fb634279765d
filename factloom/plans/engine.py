"""One query at a time, as an agent asks: policy, caches, tiers, audit, access log."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession

from factloom.config import Config
from factloom.plans import cache, output, store
from factloom.plans.ask import ANSWER, ask
from factloom.plans.policy import Decision, Policy, PolicyDenied, Request

EXACT, FUZZY = 0, 1
SYNTHETIC = "llm-synthesized"
TOP_AUDITED = 5


@dataclass(frozen=True)
class Options:
    """min_score and domain_tags don't filter; the tags go to the policy."""

    max_results: int = 10
    min_score: float = 0.0
    domain_tags: tuple[str, ...] = ()
    agent_id: str = "cli"


@dataclass(frozen=True)
class Meta:
    tier: int
    generation: int
    stale: bool
    dirty_since: datetime | None
    query_ms: int
    total_hits: int


@dataclass(frozen=True)
class Result:
    hits: tuple[dict[str, Any], ...]
    meta: Meta


class Engine:
    """Queries over a compiled folder. answer: a callable (query, [(label, text)]) -> text or None, for the last tier; without it that's left out."""

    def __init__(self, spark: SparkSession, out: str, config: Config | None = None, policy: Policy | None = None, answer: Callable[[str, list[tuple[str, str]]], str | None] | None = None, parity: bool = False):
        self.spark, self.out, self.config, self.policy, self.answer, self.parity = spark, out, config or Config(), policy or Policy.allow(), answer, parity
        self.exact, self.fuzzy = cache.Exact(self.config.exact_cache_ttl_secs), cache.Fuzzy()

    def query(self, text: str, options: Options | None = None, now: datetime | None = None) -> Result:
        """Results from the caches are neither audited nor logged. PolicyDenied, IndexNotFound."""
        options, now = options or Options(), now or datetime.now(timezone.utc).replace(tzinfo=None)
        request = Request("read", "query", options.agent_id, domain_tags=options.domain_tags)
        began = time.monotonic()
        decision = self.policy.check(request)
        checked_ms = int((time.monotonic() - began) * 1000)
        if not decision.allowed:
            self.policy.audit(request, decision, checked_ms)
            raise PolicyDenied(decision.reason)
        state = store.read_state(self.spark, self.out)
        known = self.exact.get(text, state.generation, state.dirty)
        if known is not None:
            return replace(known, meta=replace(known.meta, tier=EXACT))
        known = self.fuzzy.get(text, self.config.jaccard_threshold, state.generation, state.dirty, self.config.exact_cache_ttl_secs)
        if known is not None:
            return replace(known, meta=replace(known.meta, tier=FUZZY))
        began = time.monotonic()
        asked = self.spark.createDataFrame([(1, text)], "query_id int, text string")
        rows = ask(self.spark, self.out, asked, now, options.max_results, self.config, self.parity).orderBy("rank").collect()
        hits = [{("id" if k == "key" else k): v for k, v in r.asDict().items() if k not in ("query_id", "tier", "rank")} for r in rows]
        tier = rows[0]["tier"] if rows else 2
        said = self._answer(text, hits)
        if said is not None:
            hits.insert(0, {"id": SYNTHETIC, "title": None, "source_path": "<llm:tier3>", "score": 1.0, "bm25": 0.0, "fact_type": "durable", "answer": said})
            tier = ANSWER
        ms = int((time.monotonic() - began) * 1000)
        result = Result(tuple(hits), Meta(tier, state.generation, state.dirty, state.dirty_since, ms, len(hits)))
        self.policy.audit(replace(request, fact_ids=tuple(output.stem(h["source_path"]) for h in hits[:TOP_AUDITED])), decision, checked_ms)
        self.exact.put(text, result, state.generation)
        self.fuzzy.put(text, result, state.generation)
        if self.config.tracking and self.config.access_log:
            log_access(self.spark, self.config.access_log, hits, options.agent_id, state.generation, now)
        return result

    def _answer(self, text: str, hits: list[dict]) -> str | None:
        """What the callable makes of the best facts' texts, if the best hit is weak and the policy allows the call."""
        if self.answer is None or not self.config.answers or not hits or hits[0]["score"] >= self.config.answer_threshold:
            return None
        request = Request("llm_call", "tier3_llm_synthesis")
        decision: Decision = self.policy.check(request)
        self.policy.audit(request, decision)
        if not decision.allowed:
            return None
        ids = [h["id"] for h in hits[: self.config.answer_top]]
        facts = store.table(self.spark, self.out, "facts")
        bodies = {r["id"]: (r["title"] or r["id"], output.cut_text(r["body"] or "", 500)) for r in facts.where(facts["id"].isin(ids)).select("id", "title", "body").collect()}
        texts = [bodies[i] for i in ids if i in bodies and bodies[i][1].strip()]
        return self.answer(text, texts) if texts else None

    def enrich(self, task: str, options: output.Enrich | None = None, now: datetime | None = None) -> output.Enriched:
        """A block of context for a prompt. Without an index it's the fallback text; any other failure gives nothing, marked as stale."""
        options = options or output.Enrich()
        try:
            result = self.query(task, Options(options.max_facts, options.min_score, agent_id=options.agent_id), now)
        except store.IndexNotFound:
            return output.Enriched(options.fallback or "", False, 0, None, False)
        except Exception:  # noqa: BLE001 - a prompt is built without context rather than not at all
            return output.Enriched("", False, 0, None, True)
        return output.Enriched(output.context_block(result, options), True, len(result.hits), result.meta.tier, result.meta.stale)


def log_access(spark: SparkSession, path: str, hits: list[dict], agent: str, generation: int, now: datetime) -> None:
    """Append a line for each hit; those without id and what was made up aren't facts."""
    seconds = int(now.replace(tzinfo=timezone.utc).timestamp())
    rows = [(seconds, h["id"], agent, generation) for h in hits if h["id"] and h["id"] != SYNTHETIC]
    if rows:
        spark.createDataFrame(rows, "ts long, fact_id string, agent string, gen long").coalesce(1).write.mode("append").json(path)


def classifier_of(call: Callable[[str], str], examples: int = 20) -> Callable[[list[tuple[str, str, str]]], dict[str, tuple[str, float]]]:
    """A classifier of facts by a model: call gets a prompt and returns JSON, a list of objects with id, fact_type and confidence.

    Facts go in portions; a portion is tried once more if the call raises. Types that
    there aren't become durable, confidences are held within 0 and 1, and facts that
    get no answer are left to the rules.
    """

    def classify(facts: list[tuple[str, str, str]]) -> dict[str, tuple[str, float]]:
        found: dict[str, tuple[str, float]] = {}
        for lo in range(0, len(facts), examples):
            lines = [json.dumps({"id": i, "title": title, "text": output.cut_text(body, 200)}) for i, title, body in facts[lo : lo + examples]]
            prompt = "Which of these facts are durable, which describe a state, which an event? Answer with a JSON list of id, fact_type, confidence.\n" + "\n".join(lines)
            for last in (False, True):
                try:
                    for x in json.loads(call(prompt)):
                        kind = x.get("fact_type")
                        found[str(x["id"])] = kind if kind in ("durable", "state", "event") else "durable", min(1.0, max(0.0, float(x.get("confidence", 0))))
                    break
                except Exception:  # noqa: BLE001 - whatever a client raises, the rules remain
                    if last:
                        break
        return found

    return classify
