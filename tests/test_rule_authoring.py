"""Structure, checks and publishing of rules, policies step by step, schemas as text, artifacts."""

import pytest

from claimloom import FactSpace, RuleError
from claimloom.plans import authoring, rules
from claimloom.plans.authoring import PolicyBuilder
from claimloom.sources.artifacts import ArtifactStore

TEXT = """
entity Boat(name string, port string) { length int, flag string *, crew float64 }  # two-part identity
relationship Tows { force int }
predicate wind(int, time)
"""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_schemas_as_text():
    schema = authoring.parse_schema(TEXT)
    shown = authoring.catalogue(schema)
    assert shown["boat:flag"] == {"args": ["entity_ref", "string"], "single": False, "owner": "Boat", "field": "flag", "role": "field"}
    assert shown["tows:force"]["args"] == ["entity_ref", "entity_ref", "int"] and shown["wind"]["args"] == ["int", "time"] and shown["boat:port"]["role"] == "identity"
    for bad in ("entity X", "entity X(a string *)", "relationship X", "predicate p", "what x", "entity X(a nothing)", "entity X(a string"):
        with pytest.raises(RuleError):
            authoring.parse_schema(bad)


def test_structure_of_a_body():
    of = [("pred", "boat:length", ["$b", "$n"])]
    body = [[("pred", "boat:flag", ["$b", "red"]), ("ge", ("max", "$n", of), 3), ("addc", "$m", ("count", None, of), 1), ("not", [[("pred", "tows:force", ["$b", "$x", 5])], [("in", "$b", ["z"])]])], [("ruleref", "r", "1", ["$b"]), ("ne", "$b", "q")]]
    one, two = authoring.structure(body)
    assert one["conditions"] == ['boat:flag(b, "red")', "max { n: boat:length(b, n) } >= 3", "m = addc(count { boat:length(b, n) }, 1)", 'not { tows:force(b, x, 5); b in ["z"] }']
    assert one["predicates"] == ["boat:flag", "boat:length", "tows:force"] and one["uses"] == ["count", "max", "not"] and one["bound_at"] == {"b": 0, "m": 2}
    assert two["conditions"] == ["@r[1](b)", 'b != "q"'] and two["rules"] == ["r@1"]


def test_checks_before_running(spark):
    schema = authoring.parse_schema(TEXT)
    fine = [("pred", "boat:length", ["$b", "$n"]), ("gt", "$n", 3)]
    assert authoring.preflight(schema, fine, ["$b", "$n"]) == []
    for body, said in (
        ([("pred", "nope", ["$b"])], "unknown predicate"),
        ([("pred", "boat:length", ["$b"])], "2 arguments"),
        ([("pred", "boat:length", ["$b", "$n"]), ("pred", "boat:flag", ["$b", "$n"])], "never equal"),
        ([("pred", "boat:length", ["$b", "$n"]), ("not", [("pred", "boat:flag", ["$n", "x"])])], "never equal"),
        ([("pred", "boat:length", ["$b", "$n"]), ("lt", "$b", "x")], "no order"),
        ([("pred", "boat:length", ["$b", "$n"]), ("gt", "$z", 1)], ""),
    ):
        errors = authoring.preflight(schema, body)
        assert errors and said in errors[0]
    assert "does not bind" in authoring.preflight(schema, fine, ["$q"])[0]
    registry = authoring.publish(schema, rules.RuleRegistry(), [rules.RuleSpec("a", "1", ["$b"], fine), rules.RuleSpec("b", "1", ["$b"], [("ruleref", "a", "1", ["$b"])])])
    with pytest.raises(RuleError, match="unknown rule"):
        authoring.publish(schema, registry, [rules.RuleSpec("c", "1", ["$b"], [("ruleref", "zz", "1", ["$b"])])])
    facts = FactSpace(spark, {"boat:length": spark.createDataFrame([(str(k), k) for k in range(50)], "b string, n long")})
    assert authoring.preview(facts, fine, ["$b"], 5).count() == 5


def test_policies_step_by_step(spark):
    facts = FactSpace(spark, {"owns": spark.createDataFrame([("ann", "b1"), ("bo", "b2"), ("bo", "b3")], "p string, b string"), "length": spark.createDataFrame([("b1", 4), ("b2", 9), ("b3", 2)], "b string, n long"), "red": spark.createDataFrame([("b3",)], "b string")})
    owner = rules.Rule("owner", [("pred", "owns", ["$p", "$b"])], {"person": rules.Port("$p", "Person"), "boat": rules.Port("$b", "Boat")})
    size = rules.Rule("size", [("pred", "length", ["$b", "$n"])], {"boat": rules.Port("$b", "Boat"), "n": rules.Port("$n", "int")})
    red = rules.Rule("red", [("pred", "red", ["$b"])], {"boat": rules.Port("$b", "Boat")})
    long_ = PolicyBuilder().use(owner).use(size).same("owner.boat", "size.boat").compare("size.n", "gt", rules.Literal(3))
    assert rows(rules.evaluate_policy(facts, long_.build(), long_.outputs(who="owner.person", n="size.n"))) == [("ann", 4), ("bo", 9)]
    hop = PolicyBuilder().use(owner).compare("owner.boat > length", "lt", rules.Literal(5))
    assert rows(rules.evaluate_policy(facts, hop.build(), hop.outputs(boat="owner.boat", n="owner.boat > length"))) == [("b1", 4), ("b3", 2)]
    either = PolicyBuilder().use(owner).use(red).all("owner", "red").same("owner.boat", "red.boat")
    assert rows(rules.evaluate_policy(facts, either.build(), either.outputs(who="owner.person"))) == [("bo",)]
    same = PolicyBuilder().use(owner).compare("owner.boat", "eq", rules.Literal("b1"))  # the text of a reference
    assert rows(rules.evaluate_policy(facts, same.build(), same.outputs(who="owner.person"))) == [("ann",)]
    for bad in (("owner.boat", "lt", rules.Literal("b1")), ("size.n", "eq", rules.Literal("4")), ("size.n", "eq", rules.Literal(True)), ("owner.person", "eq", "owner.boat"), ("owner.boat", "eq", rules.Literal(4))):
        wrong = PolicyBuilder().use(owner).use(size).same("owner.boat", "size.boat").compare(*bad)
        with pytest.raises(RuleError):
            rules.evaluate_policy(facts, wrong.build(), wrong.outputs(who="owner.person"))
    for bad in (lambda: PolicyBuilder().use(owner).use(owner), lambda: PolicyBuilder().same("owner.boat", "size.boat")):
        with pytest.raises(RuleError):
            bad()


def test_artifacts_by_digest(spark, tmp_path):
    kept = ArtifactStore(spark, str(tmp_path / "x"))
    a, b = kept.put({"b": [1, "é"], "a": None}), kept.put([2])
    assert kept.put({"a": None, "b": [1, "é"]}) == a and sorted(kept.digests()) == sorted([a, b])
    assert kept.get(a) == {"a": None, "b": [1, "é"]} and kept.collect([a]) == [b] and kept.digests() == [a]
    with pytest.raises(RuleError, match="no artifact"):
        kept.get(b)
    (tmp_path / "x" / f"{a[7:]}.json").write_text("[]")
    (tmp_path / "x" / f".{a[7:]}.json.crc").unlink(missing_ok=True)
    with pytest.raises(RuleError, match="not what"):
        kept.get(a)
