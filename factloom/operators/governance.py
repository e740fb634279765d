"""Policy decisions and the hash-chained audit log, over tables of requests and lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import glob

NO_HASH = "0" * 64
RULES = "rule_ord int, name string, effect string, access_type string, agent string, reason string, operations array<string>, tags_allow array<string>, tags_deny array<string>, fact_types array<string>"
TYPES = ("durable", "state", "event")
NO_RULE = "no matching rule; default deny"


@dataclass(frozen=True)
class Rule:
    name: str
    effect: str
    access_type: str = "*"
    agent: str = "*"
    reason: str | None = None
    operations: tuple[str, ...] = ()
    tags_allow: tuple[str, ...] = ()
    tags_deny: tuple[str, ...] = ()
    fact_types: tuple[str, ...] = ()


def in_order(rules: DataFrame | Sequence[Rule]) -> list[Rule]:
    """Rules, the first to be tried first. They're what people write into a policy file, so they fit on the driver."""
    if not isinstance(rules, DataFrame):
        return list(rules)
    rows = rules.orderBy("rule_ord").collect()
    return [Rule(r["name"], r["effect"], r["access_type"], r["agent"], r["reason"], *(tuple(r[c] or ()) for c in ("operations", "tags_allow", "tags_deny", "fact_types"))) for r in rows]


def matches(rule: Rule) -> Column:
    """Whether a request (access_type, agent_id, operation, domain_tags, fact_types) meets all of a rule's conditions; an empty list asks for nothing."""

    def any_of(patterns: Sequence[str], value: Column) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | F.coalesce(glob(F.lit(p), value), F.lit(False))
        return found

    def none() -> Column:
        return F.array().cast("array<string>")

    met = F.lit(True)
    if rule.access_type != "*":
        met = met & (F.col("access_type") == rule.access_type)
    if rule.agent != "*":
        met = met & glob(F.lit(rule.agent), F.col("agent_id"))
    if rule.operations:
        met = met & any_of(rule.operations, F.col("operation"))
    tags, types = F.coalesce("domain_tags", none()), F.coalesce("fact_types", none())
    if rule.tags_allow:
        met = met & F.forall(tags, lambda t: any_of(rule.tags_allow, t))
    if rule.tags_deny:
        met = met & ~F.exists(tags, lambda t: any_of(rule.tags_deny, t))
    if rule.fact_types:
        met = met & F.forall(types, lambda t: t.isin(*TYPES) & any_of(rule.fact_types, t))
    return F.coalesce(met, F.lit(False))


def evaluate(requests: DataFrame, rules: DataFrame | Sequence[Rule]) -> DataFrame:
    """(request_id, allowed, rule, reason) of every request: the first rule that matches decides, without one it's denied.

    The rules become one expression, so requests are neither joined nor shuffled.
    """
    decision = "struct<allowed:boolean,rule:string,reason:string>"
    each = []
    for rule in in_order(rules):
        denied = rule.effect == "deny"
        why = (rule.reason if rule.reason is not None else f"denied by rule '{rule.name}'") if denied else None
        each.append(F.when(matches(rule), F.struct(F.lit(not denied).alias("allowed"), F.lit(rule.name).alias("rule"), F.lit(why).cast("string").alias("reason")).cast(decision)))
    default = F.struct(F.lit(False).alias("allowed"), F.lit(None).cast("string").alias("rule"), F.lit(NO_RULE).alias("reason")).cast(decision)
    return requests.select("request_id", F.coalesce(*each, default).alias("d")).select("request_id", "d.*")


def lint(rules: DataFrame | Sequence[Rule]) -> list[str]:
    """Names of rules that deny everything to everyone and stand before any rule that allows."""
    found = []
    for rule in in_order(rules):
        if rule.effect == "allow":
            break
        if rule.effect == "deny" and rule.access_type == "*" and rule.agent == "*":
            found.append(rule.name)
    return found


def line_hash(c: str):
    return F.sha2(F.concat(F.col(c), F.lit("\n")), 256)


def verify(lines: DataFrame) -> DataFrame:
    """(log, entries, first_bad, why) of logs (log, n, line): how many lines are good up to the first that isn't, its number and what's wrong with it.

    ``json``: it isn't an object with a prev_hash; ``hash``: that isn't the hash of the line before, zeros for the first. One shuffle, by log.
    """
    by = Window.partitionBy("log").orderBy("n")
    due = F.coalesce(F.lag(line_hash("line")).over(by), F.lit(NO_HASH))
    said = F.try_variant_get(F.try_parse_json("line"), "$.prev_hash", "string")
    why = F.when(said.isNull(), "json").when(said != due, "hash")
    checked = lines.where("line <> ''").select("log", "n", F.row_number().over(by).alias("place"), why.alias("why"))
    bad = F.min(F.when(F.col("why").isNotNull(), F.struct("place", "n", "why"))).alias("bad")
    found = checked.groupBy("log").agg(bad, F.count("*").alias("all"))
    return found.select("log", F.coalesce(F.col("bad.place") - 1, F.col("all")).cast("long").alias("entries"), F.col("bad.n").alias("first_bad"), F.col("bad.why").alias("why"))
