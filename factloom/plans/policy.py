"""The policy in force and the audit log, on the driver: a decision and a line for each call of the engine.

Tables of requests and of whole logs are ``operators.governance``'s.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import threading
import time
import tomllib
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.governance import NO_HASH, NO_RULE, TYPES, Rule, lint

ACCESS = {"read": "Read", "write": "Write", "llm_call": "LlmCall"}
RELOAD_SECONDS = 30


@dataclass(frozen=True)
class Request:
    access_type: str
    operation: str
    agent_id: str | None = None
    fact_ids: tuple[str, ...] = ()
    domain_tags: tuple[str, ...] = ()
    fact_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Decision:
    allowed: bool
    reason: str | None = None
    rule: str | None = None


class PolicyDenied(Exception):
    pass


def like(pattern: str, value: str) -> bool:
    return pattern == "*" or (value.startswith(pattern[:-1]) if pattern.endswith("*") else value == pattern)


def decide(rules: list[Rule], request: Request) -> Decision:
    """As ``governance.evaluate`` does for one request."""
    for rule in rules:
        if rule.access_type not in ("*", request.access_type):
            continue
        if rule.agent != "*" and (request.agent_id is None or not like(rule.agent, request.agent_id)):
            continue
        if rule.operations and not any(like(p, request.operation) for p in rule.operations):
            continue
        if rule.tags_allow and not all(any(like(p, t) for p in rule.tags_allow) for t in request.domain_tags):
            continue
        if any(like(p, t) for p in rule.tags_deny for t in request.domain_tags):
            continue
        if rule.fact_types and not all(t in TYPES and any(like(p, t) for p in rule.fact_types) for t in request.fact_types):
            continue
        if rule.effect == "deny":
            return Decision(False, rule.reason if rule.reason is not None else f"denied by rule '{rule.name}'", rule.name)
        return Decision(True, None, rule.name)
    return Decision(False, NO_RULE)


ALLOW_ALL = [Rule("allow-all", "allow")]


def read_rules(path: str | Path) -> list[Rule]:
    """Rules of a TOML file ([[rules]] tables). No file allows all; one that can't be read denies all."""
    try:
        found = tomllib.loads(Path(path).read_text())
        rules = []
        for r in found.get("rules", []):
            lists = {name: tuple(r.get(key, ())) for name, key in (("operations", "operations"), ("tags_allow", "domain_tags_allow"), ("tags_deny", "domain_tags_deny"), ("fact_types", "fact_types"))}
            texts = {k: r[k] for k in ("access_type", "agent", "reason") if k in r}
            if not all(isinstance(x, str) for x in (r["name"], r["effect"], *texts.values(), *(v for own in lists.values() for v in own))):
                raise ValueError("a rule's values are texts and lists of texts")
            rules.append(Rule(r["name"], r["effect"], **texts, **lists))
    except FileNotFoundError:
        return ALLOW_ALL
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError, KeyError, TypeError, ValueError, AttributeError) as error:
        warnings.warn(f"{path}: {error!r}; everything is denied", stacklevel=2)
        return []
    for name in lint(rules):
        warnings.warn(f"rule {name} denies everything before any rule that allows", stacklevel=2)
    return rules


class Policy:
    """A fixed decision (``allow``, ``deny``) or a file's rules, with the audit log that calls go to."""

    def __init__(self, rules: list[Rule], path: str | Path | None = None, log: AuditLog | None = None):
        self.rules, self.path, self.log = rules, path, log
        self._stop: threading.Event | None = None

    @classmethod
    def allow(cls, log: AuditLog | None = None) -> Policy:
        return cls(ALLOW_ALL, log=log)

    @classmethod
    def deny(cls, log: AuditLog | None = None) -> Policy:
        return cls([], log=log)

    @classmethod
    def of_file(cls, path: str | Path, log: AuditLog | None = None) -> Policy:
        return cls(read_rules(path), path, log)

    def check(self, request: Request) -> Decision:
        return decide(self.rules, request)

    def audit(self, request: Request, decision: Decision, ms: int = 0) -> None:
        if self.log is not None:
            self.log.append(request, decision, ms)

    def demand(self, request: Request) -> Decision:
        """The decision, audited; PolicyDenied if it's no."""
        began = time.monotonic()
        decision = self.check(request)
        self.audit(request, decision, int((time.monotonic() - began) * 1000))
        if not decision.allowed:
            raise PolicyDenied(decision.reason)
        return decision

    def reload(self) -> bool:
        """Read the file again; whether the rules changed."""
        if self.path is None:
            return False
        rules = read_rules(self.path)
        changed, self.rules = rules != self.rules, rules
        return changed

    def watch(self, seconds: float = RELOAD_SECONDS) -> Callable[[], None]:
        """Reload now and then, in the background; returns what stops it."""
        stop = threading.Event()

        def run():
            while not stop.wait(seconds):
                self.reload()

        threading.Thread(target=run, daemon=True).start()
        return stop.set


class AuditLog:
    """Lines of JSON, each with the hash of the line before. A full log is renamed, and a new chain begins.

    sink: called with each line after it's written, as a collector's client would be; it
    returns an HTTP status or raises. A status of 500 or more is tried once more, nothing else is.
    """

    def __init__(self, path: str | Path, most_bytes: int = 50 << 20, sink: Callable[[str], int] | None = None, probe: Callable[[], int] | None = None, required: bool = False):
        self.path, self.most_bytes, self.sink, self.probe, self.required = Path(path), most_bytes, sink, probe, required

    def append(self, request: Request, decision: Decision, ms: int = 0, now: datetime | None = None) -> None:
        now = now or datetime.now(timezone.utc)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.rotate(now)
        with self.path.open("a+b") as file:
            fcntl.flock(file, fcntl.LOCK_EX)
            last = self._last(file)
            event = {
                "ts_ms": int(now.timestamp() * 1000), "agent_id": request.agent_id or "", "operation": request.operation, "access_type": ACCESS.get(request.access_type, request.access_type),
                "fact_ids": list(request.fact_ids), "domain_tags": list(request.domain_tags), "decision": "allow" if decision.allowed else "deny",
                "reason": decision.reason, "rule_name": None if decision.allowed else decision.rule, "duration_ms": ms, "prev_hash": NO_HASH if last is None else hashlib.sha256(last + b"\n").hexdigest(),
            }
            line = json.dumps({k: v for k, v in event.items() if v is not None or k == "prev_hash"})
            file.seek(0, os.SEEK_END)
            if file.tell() and self._torn(file):  # a line that a crash cut off stays by itself
                file.write(b"\n")
            file.write(line.encode() + b"\n")
            file.flush()
        self._send(line)

    @staticmethod
    def _torn(file) -> bool:
        file.seek(-1, os.SEEK_END)
        torn = file.read(1) != b"\n"
        file.seek(0, os.SEEK_END)
        return torn

    @staticmethod
    def _last(file) -> bytes | None:
        """The last line that isn't empty, read from the end."""
        size = file.seek(0, os.SEEK_END)
        tail = b""
        while size:
            step = min(size, 1 << 16)
            size -= step
            file.seek(size)
            tail = file.read(step) + tail
            lines = [x for x in tail.split(b"\n") if x]
            if len(lines) > 1 or lines and not size:
                return lines[-1]
        return None

    def rotate(self, now: datetime) -> Path | None:
        """Rename a log that has reached its size; 0 means never."""
        if not self.most_bytes or not self.path.exists() or self.path.stat().st_size < self.most_bytes:
            return None
        name = f"{self.path.name}.{now:%Y%m%d-%H%M%S}"
        to, n = self.path.with_name(name), 0
        while to.exists():
            n += 1
            to = self.path.with_name(f"{name}.{n}")
        self.path.rename(to)
        return to

    def _send(self, line: str) -> None:
        if self.sink is None:
            return
        for last in (False, True):
            try:
                status = self.sink(line)
            except Exception as error:  # noqa: BLE001 - whatever a client raises, the log is what counts
                warnings.warn(f"the audit sink failed: {error}", stacklevel=2)
                return
            if status < 500 or last:
                return

    def reachable(self) -> None:
        """Probe the sink; an error only where it's required."""
        if self.probe is None:
            return
        try:
            status = self.probe()
            why = None if 200 <= status < 400 else f"HTTP {status}"
        except Exception as error:  # noqa: BLE001
            why = str(error)
        if why and self.required:
            raise ConnectionError(f"the audit sink can't be reached: {why}")
        if why:
            warnings.warn(f"the audit sink can't be reached: {why}", stacklevel=2)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(log, n, line) of the complete lines that aren't empty, counted from 1, of one log or a folder of them; what stands behind the last line end is left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log"), "value")
    lines = F.slice(F.split("value", "\n", -1), 1, F.size(F.split("value", "\n", -1)) - 1)
    return whole.select("log", F.posexplode(F.filter(lines, lambda x: x != "")).alias("n", "line")).select("log", (F.col("n") + 1).alias("n"), "line")
