"""Writing a new fact into a tree, and compiling it in."""

from __future__ import annotations

import os
import subprocess
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from factloom.config import Config
from factloom.plans import store
from factloom.plans.compile import compile_tree
from factloom.plans.policy import Policy, Request

TITLE = 80


class EmptySummary(ValueError):
    pass


class Locked(RuntimeError):
    """Another process is compiling."""


def slug(summary: str) -> str:
    """As ``functions.text.slug`` for one text."""
    words = summary.split()[:6]
    if not words:
        raise EmptySummary("there's nothing to write down")
    plain = "".join(c if c.isascii() and (c.isalnum() or c == "-") else "-" for c in "-".join(words).lower())
    while "--" in plain:
        plain = plain.replace("--", "-")
    return plain.rstrip("-")[:60].rstrip("-")


def unused(folder: Path, day: str, name: str) -> Path:
    path, n = folder / f"{day}-{name}.md", 1
    while path.exists():
        n += 1
        path = folder / f"{day}-{name}-{n}.md"
    return path


def content(summary: str, now: datetime) -> str:
    at = now.replace(tzinfo=timezone.utc).isoformat()
    title = summary[:TITLE].replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ").replace("\r", " ")
    return f'---\ntitle: "{title}"\nfactType: durable\nconfidence: 1.0\ncreatedAt: "{at}"\nupdatedAt: "{at}"\n---\n\n## Raw Concept\n\n{summary}\n\n## Metadata\n\n_Curated at {at}_\n'


class Lock:
    """A file with the number of the process that compiles; one whose process has ended counts as none."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def __enter__(self) -> Lock:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        for _ in range(2):
            try:
                with open(self.path, "x") as f:
                    f.write(str(os.getpid()))
                return self
            except FileExistsError:
                if self.alive():
                    raise Locked(self.path) from None
                self.path.unlink(missing_ok=True)
        raise Locked(self.path)

    def alive(self) -> bool:
        try:
            os.kill(int(self.path.read_text()), 0)
        except (ValueError, ProcessLookupError, FileNotFoundError):
            return False
        except PermissionError:
            pass
        return True

    def __exit__(self, *_) -> None:
        self.path.unlink(missing_ok=True)


def curate(spark: SparkSession, root: str, out: str, summary: str, now: datetime | None = None, sync: bool = True, config: Config | None = None, policy: Policy | None = None, agent: str = "cli", command: list[str] | None = None) -> Path:
    """Write the summary as a fact below ``curated``, mark the tables as dirty, and compile: here (sync), or in a process of its own, whose command may be given.

    root is a local folder, or one mounted as such.
    """
    now, policy = now or datetime.now(timezone.utc).replace(tzinfo=None), policy or Policy.allow()
    name = slug(summary)
    policy.demand(Request("write", "curate", agent, fact_types=("durable",)))
    folder = Path(root) / "curated"
    folder.mkdir(parents=True, exist_ok=True)
    path = unused(folder, f"{now:%Y-%m-%d}", name)
    path.write_text(content(summary, now))
    store.set_dirty(spark, out, now)
    if not sync:
        subprocess.Popen(command or [sys.executable, "-m", "factloom", "compile", root, "--out", out], start_new_session=True)
        return path
    with Lock(Path(root) / ".compile.lock"):
        compile_tree(spark, root, out, now, None, config, policy, agent)
    state = store.read_state(spark, out)
    if state.dirty or not state.generation:
        raise RuntimeError(f"the compile left {state}")
    return path
