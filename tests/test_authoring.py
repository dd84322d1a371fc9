"""Rules as expressions and as text, sealed runs, fact packages."""

import pytest

from claimloom import FactSpace, RuleError, evaluate
from claimloom.plans import dsl, replay, rules
from claimloom.schema import PredicateSpec, Schema
from claimloom.sources import package


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def facts(spark):
    return FactSpace(spark, {"user": spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "u string, n long"), "order": spark.createDataFrame([("o1", "a"), ("o2", "a"), ("o3", "b")], "o string, u string"), "blocked": spark.createDataFrame([("b",)], "u string")})


def test_expressions(facts):
    u, n, o = dsl.variables("u n o")
    user, order, blocked = map(dsl.predicate, ("user", "order", "blocked"))
    assert rows(evaluate(facts, dsl.all_of(user(u, n), dsl.agg_count(order(o, u)) >= 1), ["$u"])) == [("a",), ("b",)]
    assert rows(evaluate(facts, dsl.all_of(user(u, n), 3 - n * 2 + n == 1), ["$u"])) == [("b",)]
    assert rows(evaluate(facts, dsl.all_of(user(u, n), dsl.not_(blocked(u)), n.isin(1, 2)), ["$u"])) == [("a",)]
    assert rows(evaluate(facts, dsl.any_of(dsl.all_of(user(u, n), n > 2), dsl.all_of(user(u, n), n < 2)), ["$u"])) == [("a",), ("c",)]
    assert rows(evaluate(facts, dsl.all_of(user(u, n), dsl.not_any(dsl.all_of(blocked(u)), dsl.all_of(order("o1", u)))), ["$u"])) == [("c",)]
    with pytest.raises(RuleError):
        n * n
    with pytest.raises(TypeError):
        bool(n)


def test_text(facts):
    assert rows(evaluate(facts, dsl.parse_body('user(u, n), count { order(o, u) } >= 1, u != "b"'), ["$u"])) == [("a",)]
    assert rows(evaluate(facts, dsl.parse_body("user(u, n), n -1 = 1; user(u, n), n * 2 - 1 = 5"), ["$u"])) == [("b",), ("c",)]
    assert rows(evaluate(facts, dsl.parse_body("user(u, n), not { blocked(u), n < 9; order(o, u), n < 2 }, n in (1, 2, 3)"), ["$u"])) == [("c",)]
    program = dsl.parse_rules("""
        buyer(u) :- user(u, n), order(o, u).   # has an order
        good(u, m) :- buyer(u), user(u, n), m = n + 10, not blocked(u).
        good(u, 0) :- user(u, n), max(k) { user(v, k) } = n.
    """)
    assert rows(evaluate(rules.run_program(facts, program), [("pred", "good", ["$u", "$m"])], ["$u", "$m"])) == [("a", 11), ("c", 0)]
    for bad in ("user(u, n", "user(u, n), n ? 1", "user(u, n) n", ":- user(u)", "user(u, n), n"):
        with pytest.raises(RuleError):
            dsl.parse_body(bad)


def test_sealed_runs(spark, facts, tmp_path):
    body = [("pred", "user", ["$u", "$n"]), ("gt", "$n", 1)]
    said = replay.capture(facts, body, ["$u"], str(tmp_path / "a"))
    assert list(said["facts"]) == ["user"]
    assert replay.replay(spark, str(tmp_path / "a"), body).count() == 0
    with pytest.raises(RuleError, match="not the body"):
        replay.replay(spark, str(tmp_path / "a"), body[:1])
    replay.capture(facts.with_relations({"user": facts["user"].where("u <> 'c'")}), body, ["$u"], str(tmp_path / "b"))
    assert rows(replay.compare_runs(spark, str(tmp_path / "a"), str(tmp_path / "b"))) == [("c", "removed")]
    path = tmp_path / "a" / "run.json"
    path.write_text(path.read_text().replace('"user": 0', '"user": 1'))
    (tmp_path / "a" / ".run.json.crc").unlink(missing_ok=True)
    with pytest.raises(RuleError, match="changed"):
        replay.sealed(spark, str(tmp_path / "a"))
    record, read = replay.round_log(spark, str(tmp_path / "log"))
    assert [record("start", {}), record("end", {"n": 1})] == [0, 1]
    assert [r["kind"] for r in read().collect()] == ["start", "end"]


def test_fact_package(spark, tmp_path):
    schema = Schema(extra=(PredicateSpec("p", ("string", "int", "bool", "bytes")), PredicateSpec("q", ("string",))))
    facts = FactSpace(spark, {"p": spark.createDataFrame([("a\tb", 1, True, bytearray(b"\x00\xff"), "x1")], "a string, b long, c boolean, d binary, _asrt string"), "q": spark.createDataFrame([("only",)], "a string")})
    package.export_facts(facts, schema, str(tmp_path / "pkg"))
    back = package.read_facts(spark, str(tmp_path / "pkg"), schema)
    assert rows(back["p"]) == [("a\tb", 1, True, bytearray(b"\x00\xff"), "x1")] and rows(back["q"]) == [("only", None)]
    with pytest.raises(RuleError, match="there is"):
        package.export_facts(FactSpace(spark, {}), Schema(), str(tmp_path / "pkg"))
    with pytest.raises(RuleError, match="another"):
        package.read_facts(spark, str(tmp_path / "pkg"), Schema())
