"""The command line: compile, curate, init, query, watch, verify."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom import config as settings
from factloom.operators.governance import verify
from factloom.plans import output, store
from factloom.plans.compile import compile_changes, compile_tree
from factloom.plans.curate import curate
from factloom.plans.engine import Engine, Options
from factloom.plans.policy import AuditLog, Policy, PolicyDenied, read_log
from factloom.session import ensure_importable
from factloom.streaming.watch import watch


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="factloom")
    parser.add_argument("--config"), parser.add_argument("--policy"), parser.add_argument("--audit"), parser.add_argument("--agent", default="cli")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("compile", "curate", "query", "watch"):
        own = commands.add_parser(name)
        own.add_argument("root"), own.add_argument("--out", required=True)
        if name in ("curate", "query"):
            own.add_argument("text")
    commands.choices["compile"].add_argument("--incremental", action="store_true")
    commands.choices["compile"].add_argument("--classify", action="store_true")
    commands.choices["curate"].add_argument("--sync", action="store_true")
    commands.choices["query"].add_argument("--format", choices=("text", "json"), default="text")
    commands.choices["query"].add_argument("--top", type=int, default=10)
    commands.add_parser("init").add_argument("path")
    commands.add_parser("verify").add_argument("log")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    if args.command == "init":
        path = Path(args.path)
        path.parent.mkdir(parents=True, exist_ok=True)
        if not path.exists():
            path.write_text("[query]\nscore_threshold = 0.0\n")
        return 0
    spark = spark or SparkSession.builder.appName("factloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ensure_importable(spark)
    config = settings.load(args.config)
    log = AuditLog(args.audit, config.max_log_bytes) if args.audit else None
    policy = Policy.of_file(args.policy, log) if args.policy else Policy.allow(log)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    try:
        if args.command == "verify":
            for r in verify(read_log(spark, args.log)).collect():
                print(f"{r['log']}: {r['entries']} entries" + (f"; line {r['first_bad']}: {r['why']}" if r["why"] else ", intact"))
                if r["why"]:
                    return 1
        elif args.command == "compile":
            config = config if not args.classify else settings.Config(**{**vars(config), "classify": True})
            if args.incremental:
                print(*compile_changes(spark, args.root, args.out, now, config, policy, args.agent))
            else:
                print(compile_tree(spark, args.root, args.out, now, config.access_log, config, policy, args.agent))
        elif args.command == "curate":
            print(curate(spark, args.root, args.out, args.text, now, args.sync, config, policy, args.agent))
        elif args.command == "watch":
            watch(spark, args.root, args.out, config, policy).awaitTermination()
        else:
            result = Engine(spark, args.out, config, policy).query(args.text, Options(args.top, agent_id=args.agent), now)
            if result.meta.stale:
                print(f"the tables are stale since {result.meta.dirty_since}", file=sys.stderr)
            if args.format == "json":
                facts = store.table(spark, args.out, "facts").where(F.col("id").isin([h["id"] for h in result.hits]))
                bodies = {r[0]: r[1] for r in facts.select("id", output.excerpt("body")).collect()}
                print(*output.json_lines(result, bodies), sep="\n")
            else:
                print(*output.text_lines(result), sep="\n")
    except store.IndexNotFound:
        print("nothing has been compiled there", file=sys.stderr)
        return 1
    except PolicyDenied as error:
        print(f"denied: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
