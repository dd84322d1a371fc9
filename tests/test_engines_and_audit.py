"""Engines, worlds, shared groupings, range joins, entity heads, and the reads of audit packages."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from claimloom import FactSpace, RuleError, evaluate
from claimloom.functions.encoding import entity_ref
from claimloom.operators import paths, uncertain, views
from claimloom.operators.views import CLAIM_META, Ledger
from claimloom.plans import engines, rules
from claimloom.plans.ir import Agg, parse
from claimloom.sources import audit


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_worlds(certain, uncertain_, answers):
    """Sum of the weights of the worlds that give each answer."""
    total = {}
    for held in product([False, True], repeat=len(uncertain_)):
        weight, facts = 1.0, list(certain)
        for (fact, p), h in zip(uncertain_, held, strict=True):
            weight *= p if h else 1 - p
            facts += [fact] * h
        for a in answers(facts):
            total[a] = total.get(a, 0.0) + weight
    return total


def test_worlds_of_negation_and_aggregates(spark):
    rng = random.Random(3)
    edges = [(x, y) for x in "abcd" for y in "abcd" if x != y]
    sure = rng.sample(edges, 4)
    unsure = [(e, rng.choice([0.1, 0.5, 0.7])) for e in rng.sample([e for e in edges if e not in sure], 5)]
    table = [(*e, f"s{k}", 1.0) for k, e in enumerate(sure)] + [(*e, f"u{k}", p) for k, (e, p) in enumerate(unsure)]
    facts = FactSpace(spark, {"edge": spark.createDataFrame(table, "x string, y string, _asrt string, _p double"), "node": spark.createDataFrame([(c,) for c in "abcd"], "x string")})

    def got(body):
        return {tuple(r)[:-1]: r["p"] for r in uncertain.world_probability(facts, body, ["$x"]).collect()}

    out = [("pred", "edge", ["$x", "$y"])]
    want = brute_worlds(sure, unsure, lambda f: {(x,) for x in "abcd" if not any(a == x for a, _ in f)})
    assert got([("pred", "node", ["$x"]), ("not", out)]) == pytest.approx(want)
    want = brute_worlds(sure, unsure, lambda f: {(x,) for x in "abcd" if sum(a == x for a, _ in f) >= 2})
    assert got([("pred", "node", ["$x"]), ("ge", ("count", None, out), 2)]) == pytest.approx(want)
    want = brute_worlds(sure, unsure, lambda f: {(x,) for x, y in f if (y, x) in f} | {("a",)})
    assert got([[("pred", "edge", ["$x", "$y"]), ("pred", "edge", ["$y", "$x"])], [("pred", "node", ["$x"]), ("eq", "$x", "a")]]) == pytest.approx(want)
    many = spark.createDataFrame([("a", str(k), f"f{k}", 0.5) for k in range(13)], "x string, y string, _asrt string, _p double")
    with pytest.raises(RuleError, match="uncertain"):
        uncertain.world_probability(facts.with_relations({"edge": many}), out, ["$x"])


def test_engines_by_name(spark):
    facts = FactSpace(spark, {"p": spark.createDataFrame([("a", "f1", 0.5), ("b", "f2", 1.0)], "x string, _asrt string, _p double")})
    known = engines.Engines()
    body = [("pred", "p", ["$x"])]
    assert rows(known.run(facts, body, ["$x"])) == [("a",), ("b",)]
    assert rows(known.run(facts, body, ["$x"], engines.Profile("proofs"))) == rows(known.run(facts, body, ["$x"], engines.Profile("worlds"))) == [("a", 0.5), ("b", 1.0)]
    assert known.able([*body, ("not", [("pred", "p", ["$x"])])]) == ["spark", "worlds"] and known.able([*body, ("ruleref", "r", "1", ["$x"])]) == ["proofs", "spark"]
    known.register(engines.Engine("upper", lambda facts, where, select: evaluate(facts, where, select).withColumn("x", F.upper("x")), frozenset()))
    assert rows(known.run(facts, body, ["$x"], engines.Profile("upper", 2))) == [("A",), ("B",)]
    assert known.capabilities()["upper"] == []
    for bad in (engines.Profile("nobody"), engines.Profile("upper", 1)):
        with pytest.raises(RuleError):
            known.run(facts, body, ["$x"], bad)
    with pytest.raises(RuleError, match="union"):
        known.run(facts, [body, body], ["$x"], engines.Profile("upper"))
    with pytest.raises(RuleError, match="there is"):
        known.register(engines.Engine("spark", evaluate))


def test_aggregates_over_the_same_atoms_share_a_grouping(spark):
    facts = FactSpace(spark, {"k": spark.createDataFrame([("a",), ("b",), ("c",)], "x string"), "v": spark.createDataFrame([("a", 1), ("a", 4), ("b", -2)], "x string, n long")})
    of = [("pred", "v", ["$x", "$n"])]
    body = [("pred", "k", ["$x"]), ("eq", "$s", ("sum", "$n", of)), ("eq", "$c", ("count", None, of)), ("ge", ("max", "$n", of), "$c"), ("addc", "$m", ("min", "$n", of), 1)]
    got = evaluate(facts, body, ["$x", "$s", "$c", "$m"])
    assert rows(got) == [("a", 5, 2, 2)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    zero = evaluate(facts, [("pred", "k", ["$x"]), ("eq", "$s", ("sum", "$n", of)), ("eq", "$c", ("count", None, of))], ["$x", "$s", "$c"])
    assert rows(zero) == [("a", 5, 2), ("b", -2, 1), ("c", 0, 0)]
    # what binds another of their variables in between parts them
    parted = [("pred", "k", ["$x"]), ("eq", "$s", ("sum", "$n", of)), ("eq", "$n", 4), ("eq", "$c", ("count", None, of))]
    assert rows(evaluate(facts, parted, ["$x", "$s", "$c"])) == [("a", 5, 1), ("b", -2, 0), ("c", 0, 0)]
    assert isinstance(parse(body).branches[0][1].right, Agg)


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(5)
    points = [(k, rng.choice([rng.uniform(-50, 50), float(rng.randrange(-9, 9)), None, float("nan")])) for k in range(300)]
    spans = [(k, lo, lo + rng.choice([0, 1, 7.5, -1, 40])) for k in range(80) for lo in [float(rng.randrange(-60, 60))]] + [(900, None, 1.0), (901, 0.0, float("inf"))]
    p, r = spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(spans, "r int, lo double, hi double")
    want = sorted((a, b) for a, x in points for b, lo, hi in spans if x is not None and x == x and lo is not None and hi != float("inf") and lo <= x <= hi)
    for width in (0.7, 10, 1000):
        assert sorted((x["p"], x["r"]) for x in paths.range_join(p, r, "at", "lo", "hi", width).collect()) == want
    with pytest.raises(RuleError):
        paths.range_join(p, r, "at", "lo", "hi", 0)


def test_heads_that_derive_entities(spark):
    facts = FactSpace(spark, {"p": spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "n string, k long")})
    person = rules.EntityHead("Person", (("name", "string", "$n"), ("number", "int", "$k")))
    got = rules.inference(facts, [("pred", "p", ["$n", "$k"])], {"Person:exists": person, "person:likes": [person, "tea"]}, "r").collect()
    refs = {n: entity_ref("Person", [("name", "string", n), ("number", "int", k)]) for n, k in (("x", 1), ("y", 2))}
    assert sorted((r["target"], r["args"]) for r in got) == sorted([("Person:exists", [f'{{"v":"{refs[n]}"}}', f'{{"v":"{n}"}}', f'{{"v":{k}}}']) for n, k in (("x", 1), ("y", 2))] + [("person:likes", [f'{{"v":"{refs[n]}"}}', '{"v":"tea"}']) for n in "xy"])
    assert [r["candidate_key"] for r in got] == sorted(r["candidate_key"] for r in got)
    rule = rules.Rule("r", [("pred", "p", ["$n", "$k"])], {"name": "$n", "k": rules.Port("$k", "int")})
    assert rows(rules.evaluate_expr(facts, rule, rule.projection("name"))) == [("x",), ("y",)]
    assert rule.digest() == rules.Rule("r", [("pred", "p", ["$n", "$k"])], {"name": "$n", "k": rules.Port("$k", "int")}).digest() != rules.Rule("r", [("pred", "p", ["$n", "$k"])], {"name": "$n"}).digest()
    assert repr(rule) == "Rule(r@1: k int, name any)"


def test_reads_of_an_audit_package(spark, tmp_path):
    def table(kind, *given):
        return spark.createDataFrame(list(given), audit.KINDS[kind])

    audit.export(spark, str(tmp_path / "a"), {
        "runs": table("runs", ("r1", "rule", "1", 1, 9, 2, "done"), ("r2", "rule", "1", 1, 9, 0, "failed")),
        "candidates": table("candidates", ("r1", "c1", "k1", "t", 0.5), ("r1", "c2", "k2", "t", 1.0), ("r2", "c3", "k3", "u", 0.2)),
        "writes": table("writes", ("r1", "c1", "a1", 7)),
        "decisions": table("decisions", ("c1", "reject", None, 3), ("c1", "accept", "ok", 5), ("c3", "reject", "no", 4)),
        "failures": table("failures", ("r2", "c3", "BAD", "m")),
        "evidence": table("evidence", ("c1", 1, "p", "a9"), ("c1", 0, "q", "a8"), ("c1", 0, "q", "a7")),
        "mappings": table("mappings", ("p", "k", "v", "a1", "single_value"), ("q", "k", "w", "a2", "single_value")),
        "rounds": table("rounds", ("o1", 0, "begin", "{}"), ("o1", 2, "end", "{}"), ("o2", 0, "begin", "{}"), ("o2", 1, "end", "{}")),
        "traces": table("traces", ("t1", "r1", "top", "1", 2, None), ("t2", "r1", "low", "1", 5, "t1"), ("t3", "r2", "low", "1", 1, None)),
        "changes": table("changes", ("g1", 1, "apply", "s", "done", 6), ("g1", 0, "check", "s", "open", 5), ("g2", 0, "check", "s", "failed", 8)),
        "annotations": table("annotations", ("a1", "shared", "semantic", "probability", "float", "0.5", "o", None)),
        "meta_history": table("meta_history", ("a1", "s", "str", "x", 1, 0), ("a1", "s", "str", "y", 1, 2), ("a1", "s", None, None, 2, 0)),
    }, "d")
    p = audit.Package(spark, str(tmp_path / "a"))
    assert p.run("r1")["rows"] == 2 and p.run("zz") is None and p.candidate("c3")["target"] == "u" and p.trace_of("t2")["rows"] == 5
    assert p.decision("c1")["decision"] == "accept" and p.decision("c2") is None
    assert {k: v.count() for k, v in p.bundle("r1").items()} == {"runs": 1, "candidates": 2, "writes": 1, "failures": 0, "traces": 2, "decisions": 2, "evidence": 3}
    assert [r["candidate_id"] for r in p.with_evidence().collect()] == ["c1"] and p.with_evidence(False).count() == 2
    assert rows(p.status()) == [("c1", 3, "accept", True), ("c2", 0, None, False), ("c3", 0, "reject", False)]
    assert p.tree("c1")["conditions"] == [{"condition": 0, "uses": [("q", "a7"), ("q", "a8")]}, {"condition": 1, "uses": [("p", "a9")]}] and p.tree("zz") is None
    assert p.tell("c1").splitlines() == ["t (k1), confidence 0.5", "  condition 0: q a7, q a8", "  condition 1: p a9"]
    assert p.timeline_summary("c1") == {"first": 3, "last": 7, "events": {"reject": 1, "accept": 1, "written": 1}}
    assert rows(p.confidence()) == [("t", 2, 0.5, 0.75, 1.0), ("u", 1, 0.2, 0.2, 0.2)]
    assert p.mapping().count() == 2 and p.mapping("p").first()["value"] == "v"
    assert rows(p.rule_summary()) == [("low", "1", 2, 6), ("top", "1", 1, 2)] and p.tell_rule("r1") == "top@1: 2 rows\n  low@1: 5 rows"
    assert p.rounds() == ["o1", "o2"] and p.round_events("o1").count() == 2 and p.round_event("o2", 1)["kind"] == "end" and p.round_events("o1", "end").count() == 1
    assert rows(p.round_summary()) == [("o1", 2, 0, 2, ["begin", "end"]), ("o2", 2, 0, 1, ["begin", "end"])] and rows(p.round_warnings()) == [("o1", 1, 0)]
    assert [r["action"] for r in p.changes("g1").collect()] == ["check", "apply"] and p.changes(status="failed").count() == 1
    assert rows(p.change_runs()) == [("g1", 2, "done", 5, 6), ("g2", 1, "failed", 8, 8)]
    assert p.annotations("a1").first()["value"] == "0.5"
    assert rows(p.meta_at(1, 1)) == [("a1", "s", "str", "x")] and rows(p.meta_at(1, 2)) == [("a1", "s", "str", "y")] and rows(p.meta_at(2, 0)) == []


def test_history_of_metadata_goes_out_and_in(spark, tmp_path):
    claims = spark.createDataFrame([("a1", 1, 1, 0, "p", "e", [])], views.CLAIMS)
    events = [("a1", "s", "str", "x", 1, 0), ("a1", "s", None, None, 2, 0)]
    one = Ledger.of(spark, claims=claims, claim_meta=spark.createDataFrame(events, CLAIM_META))
    views.export_meta_history(one, str(tmp_path / "h"))
    two = views.import_meta_history(Ledger.of(spark, claims=claims, claim_meta=spark.createDataFrame(events[:1], CLAIM_META)), str(tmp_path / "h"))
    assert rows(two.claim_meta) == rows(one.claim_meta)
    with pytest.raises(RuleError, match="unknown"):
        views.import_meta_history(Ledger.of(spark), str(tmp_path / "h"))
