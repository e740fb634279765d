"""The engine's operators, on the driver's tables and on small rows."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import warnings

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from factloom import config as settings
from factloom.__main__ import main
from factloom.functions import text as T
from factloom.operators import classify, governance, graph, ontology, search, temporal
from factloom.plans import ask as tiers
from factloom.plans import cache, curate, output, store
from factloom.plans.compile import compile_changes, compile_tree, read_access
from factloom.plans.engine import Engine, Options, classifier_of, log_access
from factloom.plans.policy import ALLOW_ALL, AuditLog, Decision, Policy, PolicyDenied, Request, decide, read_log, read_rules
from factloom.plans.queries import ORACLE_SQL, QUERIES
from factloom.sources.facts import list_files, read_facts, split_header
from factloom.streaming import watch

NOW = datetime.datetime(2024, 6, 1)
LOOSE = settings.Config(score_threshold=0.0, score_gap=0.0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert_same(df, ORACLE_SQL[name], sf_dir)
    assert not df.isEmpty()


def test_text_functions(spark):
    def fnv(s: str) -> int:
        h = 14695981039346656037
        for b in s.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h - 2**64 if h >= 2**63 else h

    texts = ["", "a", "héllo wörld", "src/x.md"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.fnv1a64("t")).collect()] == [fnv(t) for t in texts]
    one = spark.createDataFrame([("The DB was moved -- to AWS us/east one two", "What happened since 2021?", "password")], "a string, b string, c string")
    got = one.select(T.slug("a"), T.temporal_pattern("b"), T.since_year("b"), T.signal("c", T.TEMPORAL_SIGNALS), T.signal("a", T.TEMPORAL_SIGNALS), T.tokens("a")).first()
    assert tuple(got)[:5] == ("the-db-was-moved-to", "since", 2021, False, True)
    assert got[5][:3] == ["the", "db", "was"]


def test_fact_types_of_odd_texts(spark, tmp_path):
    """Letters beyond ASCII at the edges of dates, a vertical tab between words, the dotted capital I."""
    edges = [f"{a}{w}{b}" for w in ("in march 2024", "on may 5", "2024-01-02", "quota") for a, b in (("é", ""), ("", "é"), ("xé", " y"), ("\v", ""), ("Σ", "ß"), ("_", ""))]
    rows = [(n, t, "web" if n % 2 else None) for n, t in enumerate([*edges, "must\vnot", "in m\u0130rch 2024", "\u0130S LIVE", "", None])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert_same(QUERIES["fact_types"](spark, str(tmp_path)), ORACLE_SQL["fact_types"], str(tmp_path))


def write(root, name: str, header: str | None, body: str):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if header is None else f"---\n{header}\n---\n\n{body}")
    return path


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / ".store" / "tree"
    write(root, "pool.md", "title: Connection pool\nfactType: state\ntags: [db]\ndomainTags: ['db:pool']\nupdatedAt: 2024-05-30T00:00:00Z\ncauses: [outage, gone]\nvalidUntil: 2030-01-01", "The pool size is set to fifty connections.")
    write(root, "ops/outage.md", "title: Pool outage\nfactType: event\neventSequence: 1\ncausedBy: [pool]\nrecency: 0.5", "The pool ran out of connections.")
    write(root, "ops/deep/_rule.md", "title: Naming rule", "Names must be short by convention.")
    write(root, "bare.md", None, "No header here.")
    write(root, "broken.md", "title: [unclosed", "x")
    write(root, "high.md", "title: High\nconfidence: 1.5", "x")
    write(root, ".hidden/secret.md", "title: Secret", "x")
    write(root, "ops/.secret.md", "title: Secret", "x")
    (root / "latin.md").write_bytes(b"---\ntitle: caf\xe9\n---\nx")
    return root


def test_headers():
    assert split_header("---\na: 1\n---\n\n\nbody") == ("a: 1\n", "body")
    assert split_header("---\na: 1\n--- no end") == (None, "---\na: 1\n--- no end")
    assert split_header("---") == (None, "---")


def test_sources(spark, tree):
    """A tree below a hidden folder, names with an underline, bytes that aren't UTF-8, and the hash of a file's bytes."""
    rows = {os.path.basename(r["source_path"]): r for r in read_facts(spark, str(tree)).collect()}
    assert set(rows) == {"pool.md", "outage.md", "_rule.md", "bare.md", "broken.md", "high.md", "latin.md"}
    assert rows["latin.md"]["error"].startswith("encoding") and rows["_rule.md"]["error"] is None
    assert all(r["content_hash"] == hashlib.sha256(open(r["source_path"], "rb").read()).hexdigest() for r in rows.values())
    assert {r["source_path"] for r in list_files(spark, f"file://{tree}").collect()} == {r["source_path"] for r in rows.values()}
    with pytest.raises(OSError):
        list_files(spark, str(tree / "missing"))


def test_compile_ask_and_compile_again(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(store.IndexNotFound):
        store.table(spark, out, "facts")
    assert compile_tree(spark, str(tree), out, NOW) == 1
    facts = {r["id"]: r for r in store.table(spark, out, "facts").collect()}
    assert set(facts) == {"pool", "outage", "_rule", "bare"}
    assert facts["_rule"]["fact_type"] == "durable" and "fact_type: taken as durable" in facts["_rule"]["warnings"]
    assert facts["pool"]["domain_tags"] == ["db:pool"] and facts["pool"]["valid_until"] == datetime.datetime(2030, 1, 1)
    rejected = store.table(spark, out, "rejected").collect()
    assert sorted(r["error"].split(":")[0] for r in rejected) == ["confidence", "encoding", "yaml"]
    assert [tuple(r) for r in store.table(spark, out, "edges").collect()] == [("pool", "outage", 65535)]
    assert {(r["place"], r["id"], r["fact_type"], r["out_degree"], r["in_degree"]) for r in store.table(spark, out, "nodes").collect()} == {(0, "_rule", "durable", 0, 0), (1, "bare", "durable", 0, 0), (2, "outage", "event", 0, 1), (3, "pool", "state", 1, 0)}
    assert {tuple(r) for r in store.table(spark, out, "problems").collect()} == {("dangling", "pool", "gone")}
    assert {r["kind"] for r in store.log(spark, out).collect()} == {"created"}
    df = {(r["field"], r["token"]): r["df"] for r in store.table(spark, out, "token_stats").collect()}
    assert df["body", "pool"] == 2 and df["title", "pool"] == 2 and df["tags", "db"] == 1
    asked = spark.createDataFrame([(1, "pool connections"), (2, "nothing at all zzz")], "query_id int, text string")
    hits = tiers.ask(spark, out, asked, NOW, config=LOOSE).orderBy("rank").collect()
    assert [(h["query_id"], h["key"]) for h in hits] == [(1, "pool"), (1, "outage")] and hits[0]["score"] > 1
    (tree / "ops/deep/_rule.md").unlink()
    write(tree, "new.md", "title: New", "Fresh.")
    log_access(spark, str(tmp_path / "access"), [{"id": "pool"}, {"id": "pool"}, {"id": ""}, {"id": "llm-synthesized"}], "a", 1, NOW)
    assert compile_tree(spark, str(tree), out, NOW, str(tmp_path / "access")) == 2
    assert read_access(spark, str(tmp_path / "access")).count() == 0
    kinds = {(r["id"], r["kind"], r["fact_type"]) for r in store.log(spark, out, delta=True).collect()}
    assert kinds == {("new", "created", "durable"), ("_rule", "deleted", "durable")}
    assert store.log(spark, out).count() == 6
    pool = store.table(spark, out, "facts").where("id = 'pool'").first()
    assert pool["access_count"] == 2 and pool["importance"] == pytest.approx(1.002)


FACTS = ("id", "title", "body", "tags", "fact_type", "content_hash", "access_count", "importance")


def tables_of(spark, out: str) -> dict:
    plain = {"facts": FACTS, "postings": ("field", "token", "key", "tf", "length"), "token_stats": ("field", "token", "df", "total"), "edges": ("src", "dst", "weight"), "nodes": ("place", "id"), "fingerprints": ("source_path", "hash"), "rejected": ("source_path", "error")}
    return {name: sorted(map(str, store.table(spark, out, name).select(*columns).collect())) for name, columns in plain.items()}


def test_compile_changes_equals_a_full_compile(spark, tree, tmp_path):
    out, other = str(tmp_path / "out"), str(tmp_path / "other")
    assert compile_changes(spark, str(tree), out, NOW)[0] == 1
    assert compile_changes(spark, str(tree), out, NOW) == (1, {})
    os.utime(tree / "pool.md", (1, 1))
    assert compile_changes(spark, str(tree), out, NOW) == (1, {"touched": 1})
    assert compile_changes(spark, str(tree), out, NOW) == (1, {})
    write(tree, "ops/outage.md", "title: Pool outage\nfactType: event\ncausedBy: [pool, bare]", "The pool was repaired.")
    write(tree, "bare.md", None, "No header here, but more.")
    (tree / "ops/deep/_rule.md").rename(tree / "ops/rule2.md")
    (tree / "high.md").unlink()
    write(tree, "broken.md", "title: Closed", "mended")
    new, counts = compile_changes(spark, str(tree), out, NOW)
    assert new == 2 and counts == {"modified": 3, "renamed": 1, "deleted": 2}
    compile_tree(spark, str(tree), other, NOW)
    assert tables_of(spark, out) == tables_of(spark, other)
    kinds = {(r["id"], r["kind"]) for r in store.log(spark, out, delta=True).collect()}
    assert kinds == {("outage", "updated"), ("bare", "updated"), ("broken", "created"), ("_rule", "deleted"), ("rule2", "created")}
    assert store.read_state(spark, out).files == 6


@pytest.fixture
def graphed(spark, tmp_path):
    """a -> b -> c, a -> d, e alone; all events but a state s, an expired one and a durable fact."""
    root = tmp_path / "graph"
    for name, causes in (("a", "[b, d]"), ("b", "[c]"), ("c", "[]"), ("d", "[]"), ("e", "[]")):
        write(root, f"{name}.md", f"title: Event {name}\nfactType: event\ncauses: {causes}\ncreatedAt: 202{ord(name) - 97}-03-01\nimportance: {0.9 if name == 'a' else 0.8}", f"storm {'storm ' * (name == 'a')}number {name}")
    write(root, "s.md", "title: Valve state\nfactType: state\ncreatedAt: 2024-02-01\nupdatedAt: 2024-05-31", "the valve is open")
    write(root, "x.md", "title: Old valve state\nfactType: state\nvalidUntil: 2020-01-01", "the valve is shut")
    write(root, "r.md", "title: Rule", "valves must be labelled")
    out = str(tmp_path / "gout")
    compile_tree(spark, str(root), out, NOW)
    return out


def hits_of(spark, out, text, **options):
    asked = spark.createDataFrame([(7, text)], "query_id int, text string")
    return tiers.ask(spark, out, asked, NOW, **{"config": LOOSE, **options}).orderBy("rank").collect()


def test_causal_tier(spark, graphed):
    hits = hits_of(spark, graphed, "storm a")
    score = {h["key"]: h["score"] for h in hits}
    assert hits[0]["key"] == "a" and set(score) == set("abcde") and {h["tier"] for h in hits} == {tiers.WORDS}
    one = {h["key"]: h["score"] / h["bm25"] / 0.8 for h in hits if h["key"] != "a"}
    assert one == pytest.approx({"b": 0.7, "d": 0.7, "c": 0.49, "e": 1.0})  # e has no edges, so it's neither here nor there
    old = {h["key"]: h["score"] for h in hits_of(spark, graphed, "storm a", parity=True)}
    assert old["e"] == 0 and old["b"] == pytest.approx(score["b"])
    forward = hits_of(spark, graphed, "downstream of number a")
    assert {h["tier"] for h in forward} == {tiers.CAUSAL}
    backward = hits_of(spark, graphed, "root cause of number c", k=1)
    assert [h["key"] for h in backward] == ["c", "b", "a"] and backward[1]["score"] == pytest.approx(0.7) and backward[2]["score"] == pytest.approx(0.49)
    assert backward[1]["title"] == "Event b"
    bare = hits_of(spark, graphed, "root cause of number c", k=1, parity=True)
    assert [(h["key"], h["title"]) for h in bare] == [("c", "Event c"), ("b", None), ("a", None)]
    chain = hits_of(spark, graphed, "storm a because", parity=True)
    assert sorted((h["key"], round(h["score"], 2)) for h in chain[5:]) == [("b", 0.7), ("c", 0.49), ("d", 0.7)]


def test_temporal_tier(spark, graphed):
    now = hits_of(spark, graphed, "current valve")
    assert now[0]["key"] == "s" and now[0]["score"] > 2 and now[0]["tier"] == tiers.TEMPORAL and now[0]["title"] == "Valve state"
    assert {h["key"] for h in now[1:]} == {"x"} and now[1]["score"] == 0  # expired, so it's among the words' hits only
    since = [h["key"] for h in hits_of(spark, graphed, "storm since 2022")]
    assert set(since[:4]) == {"c", "d", "e", "s"} and set(since[4:]) == {"a", "b"}
    history = [h["key"] for h in hits_of(spark, graphed, "history zzz")]
    assert set(history) == set("abcdersx") and history[:2] == ["e", "s"] or history[:2] == ["s", "e"]


def test_query_syntax_and_ontology(spark, graphed, tmp_path):
    assert [h["key"] for h in hits_of(spark, graphed, "title:valve")] == ["s", "x"]
    assert hits_of(spark, graphed, "osdu:valve") == [] and hits_of(spark, graphed, 'valve "open') == []
    assert hits_of(spark, graphed, None) == []
    path = tmp_path / "terms.json"
    path.write_text(json.dumps({"version": 1, "namespaces": {"hw": {"terms": {"tap": {"equivalent": ["valve"]}}}}}))
    assert hits_of(spark, graphed, "tap") == []
    known = settings.Config(score_threshold=0.0, score_gap=0.0, ontology=str(path))
    assert {h["key"] for h in hits_of(spark, graphed, "tap", config=known)} == {"s", "x"}
    assert {h["key"] for h in hits_of(spark, graphed, "valve", config=settings.Config(score_threshold=0.0, score_gap=0.0, ontology="/nowhere.json"))} == {"s", "x"}


def test_engine(spark, graphed, tmp_path):
    log = AuditLog(tmp_path / "audit.log")
    config = settings.Config(score_threshold=0.0, score_gap=0.0, answers=True, answer_threshold=5.0, access_log=str(tmp_path / "seen"))
    said = []
    engine = Engine(spark, graphed, config, Policy.allow(log), answer=lambda q, texts: said.append((q, texts)) or "42")
    result = engine.query("valve", now=NOW)
    assert [h["id"] for h in result.hits] == ["llm-synthesized", "s", "x"] and result.meta.tier == tiers.ANSWER and result.hits[0]["answer"] == "42"
    assert said[0][0] == "valve" and ("Valve state", "the valve is open") in said[0][1]
    assert engine.query("valve", Options(max_results=1), NOW).meta.tier == 0 and engine.query("Valve!", now=NOW).meta.tier == 1
    assert sorted(r["fact_id"] for r in read_access(spark, config.access_log).collect()) == ["s", "x"]
    lines = [json.loads(x) for x in (tmp_path / "audit.log").read_text().splitlines()]
    assert [x["access_type"] for x in lines] == ["LlmCall", "Read"] and lines[1]["fact_ids"] == ["<llm:tier3>", "s", "x"]
    store.set_dirty(spark, graphed, NOW)
    again = engine.query("valve", now=NOW)
    assert again.meta.stale and again.meta.tier == tiers.ANSWER
    with pytest.raises(PolicyDenied):
        Engine(spark, graphed, config, Policy.deny(log)).query("valve", now=NOW)
    assert json.loads((tmp_path / "audit.log").read_text().splitlines()[-1])["decision"] == "deny"
    plain = Engine(spark, graphed, LOOSE)
    block = plain.enrich("valve", output.Enrich(include_metadata=True), NOW)
    assert block.from_index and block.fact_count == 2 and "### Valve state\n**Type:** state | **Confidence:** 1.00" in block.context_block and block.context_block.endswith(output.END)
    missing = Engine(spark, str(tmp_path / "none"), LOOSE).enrich("x", output.Enrich(fallback="no index"))
    assert (missing.context_block, missing.from_index, missing.stale) == ("no index", False, False)
    assert Engine(spark, graphed, LOOSE, Policy.deny()).enrich("x").stale
    rows = output.as_json(tiers.ask(spark, graphed, spark.createDataFrame([(1, "valve")], "query_id int, text string"), NOW, config=LOOSE), store.table(spark, graphed, "facts")).orderBy("rank").collect()
    first = json.loads(rows[0]["value"])
    assert first["fact_id"] == "s" and first["body"] == "the valve is open" and first["answer"] is None and first["cache_tier"] == tiers.TEMPORAL or first["cache_tier"] == tiers.WORDS
    assert output.text_lines(result)[1].startswith("  1. [score: 1.000] <untitled>")


def test_caches():
    clock = [0.0]
    exact, fuzzy = cache.Exact(60, lambda: clock[0]), cache.Fuzzy(3, lambda: clock[0])
    exact.put("q", 1, 5)
    assert (exact.get("q", 5, False), exact.get("q", 6, False), exact.get("q", 5, True), exact.get("Q", 5, False)) == (1, None, None, None)
    for n, text in enumerate(("a b c d", "a b c d e", "x y")):
        clock[0] = float(n)
        fuzzy.put(text, n, 5)
    assert fuzzy.get("a b c d!", 0.6, 5, False, 60) == 0 and fuzzy.get("a b c d e f", 0.6, 5, False, 60) == 1 and fuzzy.get("q", 0.6, 5, False, 60) is None
    assert fuzzy.get("A B C D", 0.6, 4, False, 60) is None and fuzzy.get("a b c d", 0.6, 5, True, 60) is None
    clock[0] = 3.0
    fuzzy.put("x y", 3, 5)
    assert fuzzy.get("x, y", 0.6, 5, False, 60) == 3 and fuzzy.get("a b c d", 0.9, 5, False, 60) is None  # the oldest has gone
    clock[0] = 100.0
    assert exact.get("q", 5, False) is None and fuzzy.get("x y", 0.6, 5, False, 60) is None
    assert cache.jaccard(cache.words(""), cache.words("?")) == 1.0


def test_cache_lookups_as_tables(spark):
    held = spark.createDataFrame([(1, "a b c d", 5, NOW), (2, "a b c d", 5, NOW + datetime.timedelta(seconds=1)), (3, "a b c d e", 4, NOW), (4, "!", 5, NOW)], "entry int, text string, generation int, at timestamp")
    asked = spark.createDataFrame([(1, "a b c d"), (2, "a, b, c"), (3, "z"), (4, "?")], "query_id int, text string")
    at = F.lit(NOW + datetime.timedelta(seconds=30))
    assert {tuple(r) for r in search.exact_lookup(asked, held, 5, at, 60).collect()} == {(1, 2)}
    assert {tuple(r) for r in search.fuzzy_lookup(asked, held, 0.6, 5, at, 60).collect()} == {(1, 2, 1.0), (2, 2, 0.75), (4, 4, 1.0)}
    assert search.fuzzy_lookup(asked, held, 0.6, 5, F.lit(NOW + datetime.timedelta(seconds=300)), 60).count() == 0


def test_policy(spark, tmp_path):
    path = tmp_path / "p.toml"
    assert read_rules(path) == ALLOW_ALL
    path.write_text('[[rules]]\nname = "w"\neffect = "deny"\naccess_type = "write"\nagent = "bot-*"\noperations = ["cur*"]\n[[rules]]\nname = "t"\neffect = "allow"\ndomain_tags_allow = ["a:*"]\ndomain_tags_deny = ["a:secret"]\nfact_types = ["state"]\n')
    policy = Policy.of_file(path)
    asked = [Request("write", "curate", "bot-1"), Request("write", "curate", "cli"), Request("read", "query", None, domain_tags=("a:x",), fact_types=("state",)), Request("read", "q", None, domain_tags=("a:secret",)), Request("read", "q", None, fact_types=("odd",)), Request("read", "q", None, domain_tags=("b",)), Request("write", "compile", "bot-1")]
    due = [(False, "w"), (True, "t"), (True, "t"), (False, None), (False, None), (False, None), (True, "t")]
    assert [(d.allowed, d.rule) for d in map(policy.check, asked)] == due
    assert policy.check(asked[0]).reason == "denied by rule 'w'" and policy.check(asked[3]).reason == governance.NO_RULE
    rows = spark.createDataFrame([(n, r.access_type, r.agent_id, r.operation, list(r.domain_tags), list(r.fact_types)) for n, r in enumerate(asked)], "request_id int, access_type string, agent_id string, operation string, domain_tags array<string>, fact_types array<string>")
    got = governance.evaluate(rows, policy.rules).orderBy("request_id").collect()
    assert [(r["allowed"], r["rule"]) for r in got] == due and [r["reason"] for r in got] == [policy.check(r).reason for r in asked]
    assert not policy.reload()
    path.write_text("[[rules]]\nname = 1\n")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert policy.reload() and policy.rules == [] and seen
    assert not decide([], asked[0]).allowed
    assert governance.lint([governance.Rule("all", "deny"), governance.Rule("x", "allow")]) == ["all"] and governance.lint([governance.Rule("x", "allow"), governance.Rule("all", "deny")]) == []


def test_audit_log(spark, tmp_path):
    path = tmp_path / "logs" / "audit.log"
    sent = []
    log = AuditLog(path, 0, sink=lambda line: sent.append(line) or 503)
    for n in range(5):
        log.append(Request("read", f"q{n}", "me"), Decision(n % 2 == 0, None if n % 2 == 0 else "why", "rule"))
    assert len(sent) == 10  # each tried once more
    rows = read_log(spark, str(path))
    assert [tuple(r)[1:] for r in governance.verify(rows).collect()] == [(5, None, None)]
    with path.open("a") as f:
        f.write('{"cut')
    assert governance.verify(read_log(spark, str(path))).first()["entries"] == 5
    log.append(Request("read", "after"), Decision(True))
    assert governance.verify(read_log(spark, str(path))).first()["why"] == "json"
    text = path.read_text().replace('{"cut\n', "").splitlines()[:5]
    text[1] = text[1].replace("q1", "q9")
    path.write_text("\n".join(text) + "\n")
    assert [tuple(r)[1:] for r in governance.verify(read_log(spark, str(path))).collect()] == [(2, 3, "hash")]
    small = AuditLog(path, 10)
    for _ in range(2):
        small.append(Request("read", "q"), Decision(True), now=NOW)
    names = sorted(p.name for p in path.parent.iterdir())
    assert names == ["audit.log", "audit.log.20240601-000000", "audit.log.20240601-000000.1"]
    assert {r["why"] for r in governance.verify(read_log(spark, str(path.parent))).collect()} == {None, "hash"}
    with pytest.raises(ConnectionError):
        AuditLog(path, probe=lambda: 500, required=True).reachable()
    AuditLog(path, probe=lambda: 200, required=True).reachable()


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    assert settings.load(path) == settings.Config()
    path.write_text("[query]\nscore_gap = 1\ncausal_max_hops = 99\n[ontology]\nexpansion_depth = 9\n[audit]\nsiem_required = true\n")
    got = settings.load(path)
    assert (got.score_gap, got.causal_max_hops, got.expansion_depth, got.siem_required) == (1.0, 6, 3, True)
    for bad in ("[query", '[query]\nscore_gap = "x"\n', "[compile]\nclassify = 1\n"):
        path.write_text(bad)
        with pytest.warns(UserWarning):
            assert settings.load(path) == settings.Config()


def test_curate_and_command_line(spark, tmp_path, capsys):
    root, out = str(tmp_path / "tree"), str(tmp_path / "out")
    path = curate.curate(spark, root, out, 'Use "short" names: always\nplease', NOW)
    assert path.name == "2024-06-01-use-short-names-always-please.md" and store.read_state(spark, out).generation == 1
    fact = store.table(spark, out, "facts").first()
    assert fact["title"] == 'Use "short" names: always please' and fact["fact_type"] == "durable"
    assert curate.curate(spark, root, out, 'Use "short" names: always\nplease', NOW).name.endswith("-2.md")
    with pytest.raises(curate.EmptySummary):
        curate.curate(spark, root, out, "  ")
    curate.curate(spark, root, out, "later", NOW, sync=False, command=["true"])
    assert store.read_state(spark, out).dirty
    with curate.Lock(tmp_path / "l"), pytest.raises(curate.Locked), curate.Lock(tmp_path / "l"):
        pass
    (tmp_path / "l").write_text("999999999")
    with curate.Lock(tmp_path / "l"):
        pass
    config = tmp_path / "c.toml"
    assert main(["init", str(config)]) == 0 and settings.load(config).score_threshold == 0.0
    audit = ["--audit", str(tmp_path / "a.log")]
    assert main([*audit, "compile", root, "--out", out, "--incremental"], spark) == 0
    assert main(["--config", str(config), *audit, "query", root, "names", "--out", out, "--format", "json"], spark) == 0
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith('{"rank"')]
    assert shown[0]["fact_id"].startswith("2024-06-01-use-short") and shown[0]["body"].startswith('Use "short"')
    assert main(["verify", str(tmp_path / "a.log")], spark) == 0 and "intact" in capsys.readouterr().out
    assert main(["query", root, "names", "--out", str(tmp_path / "no")], spark) == 1
    deny = tmp_path / "deny.toml"
    deny.write_text("")
    assert main(["--policy", str(deny), "query", root, "names", "--out", out], spark) == 1


def test_classification_by_a_callable(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    write(tree, "open.md", "title: Open question", "something else entirely")
    asked = []

    def model(prompt: str) -> str:
        asked.append(prompt)
        if len(asked) == 1:
            raise TimeoutError
        return json.dumps([{"id": "open", "fact_type": "event", "confidence": 3}, {"id": "bare", "fact_type": "odd"}])

    compile_tree(spark, str(tree), out, NOW, config=settings.Config(classify=True), classifier=classifier_of(model))
    kinds = {r["id"]: r["fact_type"] for r in store.table(spark, out, "facts").collect()}
    assert kinds["open"] == "event" and kinds["bare"] == "durable" and len(asked) == 2
    compile_tree(spark, str(tree), out, NOW, config=settings.Config(classify=True), classifier=classifier_of(model))
    assert len(asked) == 2  # all cached
    facts = store.table(spark, out, "facts")
    assert classify.by_callable(facts, spark.createDataFrame([], "body_hash string, fact_type string"), lambda x: {}, 10)[1].count() == 0


EDGES = (("a", "b"), ("a", "f"), ("b", "c"), ("c", "d"), ("d", "b"), ("f", "g"), ("g", "d"), ("x", "x"), ("p", "q"), ("q", "p"))


def test_fuzzy_lookup_of_few(spark, monkeypatch):
    """Few entries are compared in the query's row, many are joined by tokens, dealt out: the same is found, of equals the newest."""
    words = [f"w{n}" for n in range(9)]
    texts = [" ".join(words[(n * j) % 9] for j in range(n % 7)) for n in range(60)]
    at = F.lit(NOW) + F.make_interval(secs=F.col("entry") % 5)
    held = spark.createDataFrame([(n, t) for n, t in enumerate(texts[::3])] + [(90, None), (91, "zz")], "entry long, text string").select("entry", "text", F.lit(1).alias("generation"), at.alias("at"))
    asked = spark.createDataFrame([(n, t) for n, t in enumerate(texts)] + [(7, "w1 w2 w3"), (200, None), (201, "qq"), (None, "zz")], "query_id long, text string")
    few = search.fuzzy_lookup(asked, held, 0.4, 1, F.lit(NOW), 60)
    # a task of the join by token would hold a row for each pair
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    got = sorted(map(str, few.collect()))
    monkeypatch.setattr(search, "FEW_HELD", 0)
    assert got == sorted(map(str, search.fuzzy_lookup(asked, held, 0.4, 1, F.lit(NOW), 60).collect())) and len(got) > 50
    assert search.fuzzy_lookup(asked, held.where("entry > 1000"), 0.4, 1, F.lit(NOW), 60).count() == 0
    monkeypatch.setattr(search, "FEW_HELD", 256)
    assert search.fuzzy_lookup(asked, held.where("entry > 1000"), 0.4, 1, F.lit(NOW), 60).count() == 0


def test_best_leave_tasks(spark):
    """Only the best of each query leave a task, with the ranks that all would give: ties, empty and null texts, an unknown word, a repeated query, and facts that share a key."""
    words = ["ab", "cd", "ef", "gh", "ij"]
    rows = [(f"k{n * 7 % 211}", " ".join(words[(n * j) % 5] for j in range(n % 6)) if n % 17 else None, [words[n % 5]] if n % 3 else []) for n in range(211)] + [(None, "ab cd", ["ef"])]
    facts = spark.createDataFrame(rows, "id string, body string, tags array<string>").repartition(3)
    asked = spark.createDataFrame([(1, "ab cd"), (2, "gh"), (3, "zz"), (None, "ef ef ij"), (1, "cd ef"), (5, None)], "query_id int, text string")
    boosts = {"body": 1.0, "tags": 2.5}
    for own in (facts, facts.union(facts.where("id < 'k2'"))):
        got, want = search.bm25(asked, own, "id", boosts, most=4), search.bm25(asked, own, "id", boosts)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(str, search.best(got, "bm25", 4).collect())) == sorted(map(str, search.best(want, "bm25", 4).collect()))
    assert search.bm25(asked, facts, "id", boosts, most=4).count() <= 3 * 4 * 3 < search.bm25(asked, facts, "id", boosts).count()
    assert search.bm25(asked.where("query_id > 4"), facts, "id", boosts, most=4).count() == 0


def plain_paths(edges, sources, hops):
    """{(src, node): path}: breadth first, the first of equally short paths."""
    found = {}
    for src in sources:
        level = {src: (src,)}
        for _ in range(hops + 1):
            found |= {(src, node): path for node, path in level.items()}
            ways = sorted((*path, b) for node, path in level.items() for a, b in edges if a == node and (src, b) not in found)
            level = {path[-1]: path for path in reversed(ways)}
    return found


def test_last_hop(spark, monkeypatch):
    """Through two hubs 40 nodes reach 40: those 1600 rows are found, but never stored or shuffled, nor all found for a few pairs."""
    edges = [*((f"a{n}", h) for n in range(40) for h in ("h1", "h2")), *((h, f"b{n}") for n in range(40) for h in ("h2", "h1")), ("b0", "a0"), ("b1", "b1"), ("a0", "a1")]
    edge = spark.createDataFrame(edges, "src string, dst string")
    stored, store_ = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: stored.append(store_(df)) or stored[-1])
    monkeypatch.setattr(graph, "LEAST_BLOCK", 20)
    sources = spark.createDataFrame([(a,) for a, _ in edges] + [("zz",), (None,)], "src string")
    for hops in (2, 3, 4):
        del stored[:]
        want = plain_paths([e for e in edges if e[0] != e[1]], {a for a, _ in edges} | {"zz"}, hops)
        got = graph.shortest_paths(sources, edge, hops).where("src is not null").collect()
        assert len(got) == len(want) and {(r["src"], r["node"]): tuple(r["path"]) for r in got} == want and all(r["hops"] == len(r["path"]) - 1 for r in got)
        assert sorted(map(tuple, graph.reachable(sources, edge, hops).collect())) == sorted((*k, len(v) - 1) for k, v in want.items() if len(v) > 1)
        assert not any("hops" in df.columns and df.where(F.col("hops") == hops).count() for df in stored)
    ids = spark.createDataFrame(sorted({(n,) for e in edges for n in e} | {("zz",)}), "id string")
    del stored[:]
    pairs = spark.createDataFrame([(f"a{n}", f"b{n}") for n in range(40)] + [("h1", "a0"), ("b0", "b9"), ("b0", "b0"), ("zz", "a0")], "src string, node string")
    paths = plain_paths(edges, {a for a, _ in edges} | {"zz"}, 2)
    assert {(r[0], r[1]): round(r[2], 4) for r in graph.adjacency(pairs, ids, edge.union(spark.createDataFrame([("q", f"b{n}") for n in range(9)], edge.schema)), 2).collect()} == {(a, b): round(0.7 ** (len(paths[a, b]) - 1), 4) if (a, b) in paths else 0.0 for a, b in map(tuple, pairs.collect())}
    assert sum(df.count() for df in stored) < 400


def test_graph(spark):
    edge = spark.createDataFrame(list(EDGES), "src string, dst string")
    ids = spark.createDataFrame([(i,) for i in "abcdfghpqx"], "id string")
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("f", "c"), ("a", "h"), ("zz", "a"), ("a", "zz")], "src string, node string")
    got = {(r[0], r[1]): round(r[2], 4) for r in graph.adjacency(pairs, ids, edge, 3).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): 0.7, ("a", "c"): 0.49, ("a", "d"): 0.343, ("f", "c"): 0.0, ("a", "h"): 0.0, ("zz", "a"): 0.0, ("a", "zz"): 1.0}
    assert {(r[0], r[1]): round(r[2], 4) for r in graph.adjacency(pairs.where("src = 'f'"), ids, edge, 4).collect()} == {("f", "c"): 0.2401}
    one = spark.createDataFrame([("d",)], "src string")
    assert {r["node"] for r in graph.reachable(one, edge, 1, backward=True).collect()} == {"c", "g"}
    core = {tuple(r) for r in graph.cyclic_core(edge).collect()}
    assert core == {("b", "c"), ("c", "d"), ("d", "b"), ("p", "q"), ("q", "p")}
    assert graph.cycles(edge) == [["b", "c", "d", "b"], ["p", "q", "p"]] == graph.cycles(edge, 6)
    with pytest.raises(ValueError):
        graph.cycles(edge, 2)
    assert graph.cycles(edge.where("dst not in ('b', 'p')")) == [] and graph.cyclic_core(edge.where("dst not in ('b', 'p')")).count() == 0
    long = spark.range(3000).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst")
    assert graph.cycles(long) == []
    facts = spark.createDataFrame([("a", ["b", "a", "zz"], [], 1.0, 0.5), ("b", [], ["a"], 1.0, 1.0), ("a", ["b"], [], 0.1, 0.1)], "id string, causes array<string>, caused_by array<string>, confidence double, importance double")
    assert [tuple(r) for r in graph.edges(facts).collect()] == [("a", "b", 32767)]
    assert {tuple(r) for r in graph.problems(facts).collect()} == {("dangling", "a", "zz"), ("self_loop", "a", "a")}
    assert [(r["place"], r["id"], r["out_degree"], r["in_degree"]) for r in graph.nodes(facts, graph.edges(facts)).orderBy("place").collect()] == [(0, "a", 1, 0), (1, "b", 0, 1)]
    assert graph.fingerprint(edge).first() == graph.fingerprint(edge.orderBy(F.desc("dst"))).first() != graph.fingerprint(edge.limit(3)).first()


def test_temporal_log(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [("a", "created", day(1), "state", None, 1), ("a", "deleted", day(5), "state", None, 2), ("b", "created", day(2), "state", day(3), 1), ("b", "updated", day(4), "state", day(20), 2), ("c", "created", None, "state", None, 1), ("d", "created", day(2), "event", None, 1)]
    log = spark.createDataFrame(rows, "id string, kind string, event_ts timestamp, fact_type string, valid_until timestamp, generation int")
    now = F.lit(day(10))
    assert sorted(r["id"] for r in temporal.current_state(log, now).collect()) == ["b", "c"]
    assert sorted(r["id"] for r in temporal.current_state(log, now, parity=True).collect()) == ["a", "a", "b", "c"]
    assert {r["id"] for r in temporal.since(log, F.lit(day(4))).collect()} == {"a", "b"}
    assert {r["id"] for r in temporal.since(log, F.lit(None).cast("timestamp")).collect()} == {"a", "b", "d"}
    assert [r["id"] for r in temporal.history(log).collect()][-1] == "c"


def test_merges_and_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 0.8), (1, "b", 0.5, 0.4)], "query_id int, key string, bm25 double, score double")
    log = spark.createDataFrame([(1, "b"), (1, "c")], "query_id int, key string")
    merged = temporal.merge_temporal(log, hits).orderBy("block", F.desc("score")).collect()
    assert [(r["key"], r["score"]) for r in merged] == [("b", 2.5), ("c", 2.0), ("a", 0.8)]
    causal = spark.createDataFrame([(1, "a", 0.7), (1, "d", 0.49)], "query_id int, key string, score double")
    assert graph.merge_causal(hits, causal).count() == 4 and graph.merge_causal(hits, causal, parity=False).count() == 3
    wanted = spark.createDataFrame([(1, "t", "a"), (2, "t", "x")], "query_id int, tier string, key string")
    row = search.metrics(hits.withColumn("rank", F.when(F.col("key") == "a", 1).otherwise(2)), wanted, spark.createDataFrame([(1, "b"), (2, "y")], "query_id int, key string")).first()
    assert (row["r5"], row["mrr"], round(row["p3"], 4), row["violations"]) == (0.5, 0.5, 0.1667, 1)


def test_ontology(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"version": 1, "namespaces": {"Db": {"terms": {"Index": {"related": ["key"]}, "key": {"parent": "index"}, "row": {}}}, "env": {}}}))
    terms = ontology.read(spark, str(path))
    tags = spark.createDataFrame([("db:index",), ("db:zz",), ("env:any",), ("plain",), ("no:x",)], "tag string")
    assert dict(map(tuple, ontology.check_tags(tags, terms).collect())) == {"db:index": "valid", "db:zz": "unknown", "env:any": "valid", "plain": "none", "no:x": "none"}
    assert ontology.cycles(terms) == [["db:index", "db:key", "db:index"]]
    asked = spark.createDataFrame([(1, "index")], "query_id int, text string")
    assert ontology.expanded_text(asked, terms, 1).first()["text"] == "index key"


def test_streams(spark, tree, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text('{"ts":1,"fact_id":"x","agent":"a","gen":1}\nnot json\n{"ts":2,"fact_id":"x","agent":"a","gen":1}\n')
    counts = watch.access_counts(spark, str(logs)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(60)
    assert [tuple(r) for r in spark.table("counts").collect()] == [("x", 1, 2)]
    seen = []
    facts = watch.fact_stream(spark, str(tree)).writeStream.foreachBatch(lambda df, n: seen.extend(r["title"] for r in df.select("title").collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    facts.awaitTermination(60)
    assert {"Connection pool", "Pool outage"} <= set(seen)


def test_watch_sees_deletions(spark, tree, tmp_path):
    import time

    out = str(tmp_path / "out")
    compile_tree(spark, str(tree), out, NOW)
    (tree / "pool.md").unlink()
    query = watch.watch(spark, str(tree), out, every="1 second", now=lambda: NOW)
    until = time.time() + 60
    while store.generation(spark, out) < 2 and time.time() < until and query.isActive:
        time.sleep(1)
    query.stop()
    assert "pool" not in {r["id"] for r in store.table(spark, out, "facts").collect()}
