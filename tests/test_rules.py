"""Rule bodies over literal facts: the semantics that decide results."""

import random

import pytest
from pyspark.errors import PySparkException

from claimloom import FactSpace, RuleError, evaluate
from claimloom.plans import explain, rules, scenario
from claimloom.plans.ir import check, parse


def space(spark, **tables):
    return FactSpace(spark, {n: spark.createDataFrame(rows, schema) for n, (rows, schema) in tables.items()})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def shop(spark):
    return space(
        spark,
        user=([("ann",), ("bo",), ("cy",)], "u string"),
        order=([("k1", "bo"), ("k2", "bo"), ("k3", "ann"), ("k4", "bo"), ("k5", "ann"), ("k6", "bo")], "o string, u string"),
        amount=([("k1", "bo", 7), ("k2", "bo", -5), ("k4", "bo", 24)], "o string, u string, n long"),
        edge=([("a", "b"), ("b", "c"), ("c", "c"), ("b", "b")], "x string, y string"),
        text=([("7",), ("-3",), (" 7 ",)], "t string"),
        good=([("7",), ("-3",)], "t string"),
        flag=([(True,), (False,)], "f boolean"),
        number=([(1,), (0,)], "n int"),
    )


ORDERS = [("pred", "order", ["$o", "$u"])]


def test_aggregates_equal_plain_python(spark):
    """Gauges of rivers, some without readings, with equal and negative levels, against loops over lists."""
    rng = random.Random(12)
    rivers = [f"river {k}" for k in range(25)]
    gauges = [(f"g{k}", rng.choice(rivers[:20])) for k in range(60)]
    levels = [(rng.choice(gauges)[0], rng.randrange(-6, 9)) for _ in range(150)]  # a bag: equal rows count twice
    facts = space(spark, river=([(r,) for r in rivers], "r string"), gauge=(gauges, "g string, r string"), level=(levels, "g string, n long"))
    of = [("pred", "gauge", ["$g", "$r"]), ("pred", "level", ["$g", "$n"])]
    per = {r: [n for g, n in levels for h, s in gauges if g == h and s == r] for r in rivers}

    def got(*atoms, keep="$v"):
        return dict(tuple(x) for x in evaluate(facts, [("pred", "river", ["$r"]), *atoms], ["$r", keep]).collect())

    assert got(("eq", "$v", ("count", None, of))) == {r: len(x) for r, x in per.items()}
    assert got(("eq", "$v", ("sum", "$n", of))) == {r: sum(x) for r, x in per.items()}
    assert got(("eq", "$v", ("mean", "$n", of))) == pytest.approx({r: sum(x) / len(x) for r, x in per.items() if x})
    assert got(("eq", "$v", ("min", "$n", of))) == {r: min(x) for r, x in per.items() if x}
    assert got(("eq", "$v", ("max", "$n", of))) == {r: max(x) for r, x in per.items() if x}
    # in arithmetic, compared with another, and with a filter inside
    assert got(("mulc", "$v", ("max", "$n", of), -3)) == {r: -3 * max(x) for r, x in per.items() if x}
    high = [*of, ("gt", "$n", 4)]
    want = {r: len(x) for r, x in per.items() if 2 * sum(n > 4 for n in x) > len(x) - 4}
    assert got(("eq", "$v", ("count", None, of)), ("mulc", "$h", ("count", None, high), 2), ("addc", "$w", "$v", -4), ("gt", "$h", "$w")) == want
    assert {r["r"] for r in evaluate(facts, [("pred", "river", ["$r"]), ("lt", ("count", None, [("pred", "gauge", ["$g", "$r"])]), ("count", None, of))], ["$r"]).collect()} == {r for r, x in per.items() if sum(s == r for _, s in gauges) < len(x)}


def test_aggregates_of_texts_have_no_value(spark):
    facts = space(spark, town=([("x",), ("y",)], "t string"), name=([("x", "delta"), ("x", "alpha")], "t string, n string"))

    def value(kind):
        return rows(evaluate(facts, [("pred", "town", ["$t"]), ("eq", "$v", (kind, "$n", [("pred", "name", ["$t", "$n"])]))], ["$t", "$v"]))

    assert value("sum") == [("y", 0)]  # a sum over nothing is 0
    assert value("mean") == []
    assert value("min") == [("x", "alpha")] and value("max") == [("x", "delta")]


def test_bags_inside_sets_outside(spark):
    twice = space(spark, v=([("a", 1), ("a", 1)], "k string, n long"), k=([("a",), ("a",)], "k string"))
    assert rows(evaluate(twice, [("pred", "k", ["$k"]), ("eq", "$s", ("sum", "$n", [("pred", "v", ["$k", "$n"])]))])) == [("a", 2)]
    assert rows(evaluate(twice, [("pred", "k", ["$k"]), ("pred", "v", ["$k", "$n"])])) == [("a", 1)]


def test_aggregate_over_unrelated_facts(shop):
    assert rows(evaluate(shop, [("pred", "user", ["$u"]), ("eq", "$n", ("count", None, [("pred", "edge", ["$x", "$x"])]))], ["$u", "$n"])) == [("ann", 2), ("bo", 2), ("cy", 2)]


def test_repeated_variables_and_constants(shop):
    assert rows(evaluate(shop, [("pred", "edge", ["$x", "$x"])])) == [("b",), ("c",)]
    assert rows(evaluate(shop, [("pred", "edge", ["a", "$y"]), ("pred", "edge", ["$y", "$z"])], ["$y", "$z"])) == [("b", "b"), ("b", "c")]


def test_types_are_not_mixed(shop):
    assert rows(evaluate(shop, [("pred", "number", ["$n"]), ("eq", "$n", "1")])) == []
    assert rows(evaluate(shop, [("pred", "number", ["$n"]), ("ne", "$n", "1")], ["$n"])) == [(0,), (1,)]
    assert rows(evaluate(shop, [("pred", "number", ["$n"]), ("in", "$n", ["1", 0])])) == [(0,)]
    assert rows(evaluate(shop, [("pred", "number", ["$n"]), ("pred", "good", ["$n"])])) == []


def test_ordering_of_texts(shop):
    assert rows(evaluate(shop, [("pred", "good", ["$t"]), ("gt", "$t", 0)])) == [("7",)]
    with pytest.raises(PySparkException, match="takes numbers"):
        evaluate(shop, [("pred", "text", ["$t"]), ("gt", "$t", 0)]).collect()
    with pytest.raises(RuleError, match="boolean"):
        evaluate(shop, [("pred", "flag", ["$f"]), ("gt", "$f", 0)])


def test_arithmetic_binds_or_checks(shop):
    body = [("pred", "amount", ["$o", "$u", "$n"]), ("mulc", "$d", "$n", 2), ("sub", "$e", "$d", "$n"), ("neg", "$m", "$n"), ("add", "$n", "$e", 0)]
    assert rows(evaluate(shop, body, ["$n", "$d", "$m"])) == [(-5, -10, 5), (24, 48, -24), (7, 14, -7)]


def test_negation(shop):
    assert rows(evaluate(shop, [("pred", "user", ["$u"]), ("not", ORDERS)])) == [("cy",)]
    assert rows(evaluate(shop, [("pred", "user", ["$u"]), ("not", [[("pred", "amount", ["$o", "$u", "$n"])], [("pred", "order", ["k5", "$u"])]])])) == [("cy",)]
    assert rows(evaluate(shop, [("pred", "amount", ["$o", "$u", "$n"]), ("not", [("pred", "amount", ["$p", "$u", "$m"]), ("gt", "$m", "$n")])], ["$n"])) == [(24,)]
    assert rows(evaluate(shop, [("pred", "amount", ["$o", "$u", "$n"]), ("not", [("pred", "amount", ["$p", "$u", "$m"]), ("addc", "$k", "$m", -12), ("eq", "$k", "$n")])], ["$n"])) == [(24,), (7,)]


def test_branches_may_bind_different_variables(shop):
    got = evaluate(shop, [[("pred", "user", ["$u"])], [("pred", "number", ["$n"])]])
    assert sorted(got.columns) == ["n", "u"] and got.count() == 5
    with pytest.raises(RuleError, match="does not bind"):
        evaluate(shop, [[("pred", "user", ["$u"])], [("pred", "number", ["$n"])]], ["$u"])


def test_a_body_may_begin_with_a_constant(shop):
    assert rows(evaluate(shop, [("eq", "$x", "a"), ("pred", "edge", ["$x", "$y"])])) == [("a", "b")]


@pytest.mark.parametrize(
    "body",
    [
        [],
        [("eq", "$x", "$y")],
        [("gt", 1, 2)],
        [("pred", "user", ["$u"]), ("gt", "$v", 1)],
        [("pred", "user", ["$u"]), ("in", "$u", [])],
        [("pred", "user", ["$u"]), ("not", [("pred", "number", ["$n"])])],
        [("pred", "user", ["$u"]), ("not", [("not", [("pred", "user", ["$u"])])])],
        [("pred", "user", ["$u"]), ("not", [[("pred", "user", ["$u"])], [("pred", "number", ["$n"])]])],
        [("pred", "user", ["$u"]), ("eq", "$n", ("sum", "$z", ORDERS))],
        [("pred", "user", ["$u"]), ("eq", "$n", ("count", "$u", ORDERS))],
        [("pred", "user", ["$u"]), ("eq", "$n", ("sum", "$n", [("addc", "$n", "$u", 1)]))],
        [("pred", "user", ["$u"]), ("addc", "$n", "$u", "$u")],
        [("pred", "user", [None])],
        [("what", "user")],
        [[("pred", "user", ["$u"])], []],
        [("pred", "user", ["$u"]), [("pred", "user", ["$u"])]],
    ],
)
def test_bodies_that_are_refused(body):
    with pytest.raises(RuleError):
        parse(body)


def test_unknown_predicates_and_arity(shop):
    with pytest.raises(RuleError, match="unknown predicate"):
        evaluate(shop, [("pred", "nope", ["$x"])])
    with pytest.raises(RuleError, match="arguments"):
        evaluate(shop, [("pred", "user", ["$x", "$y"])])


def test_plans_push_filters_and_group_once(spark, sf):
    from claimloom.queries import QUERIES

    def plan(name):
        return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    assert "PushedFilters: [IsNotNull(n_nationkey), IsNotNull(n_name), IsNotNull(n_regionkey), EqualTo(n_regionkey,1)" in plan("pred_const_filter").replace("\n", " ") or "EqualTo(n_regionkey,1)" in plan("pred_const_filter")
    assert "CartesianProduct" not in plan("not_or_branches")
    assert "Python" not in plan("agg_min_max_mean")


def test_rule_references(shop):
    reach = rules.RuleSpec("two", "1", ["$x", "$z"], [("pred", "edge", ["$x", "$y"]), ("pred", "edge", ["$y", "$z"])])
    registry = rules.RuleRegistry([reach])
    top = rules.RuleSpec("top", "1", ["$z"], [("ruleref", "two", "1", ["a", "$z"])])
    assert rows(rules.run_rule(shop, top, registry)) == [("b",), ("c",)]
    assert {r["rule"]: r["rows"] for r in rules.trace_rule(shop, top, registry).collect()} == {"top": 2, "two": 6 - 1}
    with pytest.raises(RuleError, match="already"):
        registry.register(reach)
    registry.register(rules.RuleSpec("loop", "1", ["$x"], [("ruleref", "loop", "1", ["$x"])]))
    with pytest.raises(RuleError, match="circle"):
        rules.run_rule(shop, rules.RuleSpec("t", "1", ["$x"], [("ruleref", "loop", "1", ["$x"])]), registry)


def test_composition_and_its_limits(shop):
    a = rules.Rule("a", [("pred", "order", ["$o", "$u"])], {"u": rules.Port("$u", "user"), "o": rules.Port("$o", "order")})
    b = rules.Rule("b", [("pred", "amount", ["$o", "$u", "$n"])], {"u": rules.Port("$u", "user"), "n": "$n"})
    both = (a & b).join_by_ports("u")
    got = rules.evaluate_expr(shop, both, {"who": a.as_("a").u})
    assert rows(got) == [("bo",)]
    with pytest.raises(RuleError, match="is order"):
        a.as_("a").o.eq(b.as_("b").u)
    with pytest.raises(RuleError, match="twice"):
        rules.lower(rules.all_of(a, a))
    assert rows(rules.evaluate_expr(shop, rules.all_of(a.as_("x"), a.as_("y")).join(a.as_("x").u.eq(a.as_("y").u)), {"p": a.as_("x").o, "q": a.as_("y").o}).where("p = 'k3'")) == [("k3", "k3"), ("k3", "k5")]
    with pytest.raises(TypeError):
        bool(a)
    many = [rules.any_of(a.as_(f"l{k}"), a.as_(f"r{k}")) for k in range(6)]
    with pytest.raises(RuleError, match="branches"):
        rules.lower(rules.all_of(*many))
    with pytest.raises(RuleError, match="ANDs"):
        rules.any_of(a, b).join(a.as_("a").u.eq(b.as_("b").u))


def test_program_and_goal(shop):
    clauses = [
        rules.Clause("hop", ["$x", "$y"], [("pred", "edge", ["$x", "$y"]), ("ne", "$x", "$y")]),
        rules.Clause("far", ["$x", "$z"], [("pred", "hop", ["$x", "$y"]), ("pred", "hop", ["$y", "$z"])]),
        rules.Clause("far", ["$x", "end"], [("pred", "hop", ["$x", "c"])]),
    ]
    got = rules.run_program(shop, clauses)
    assert rows(evaluate(got, [("pred", "far", ["$x", "$z"])])) == [("a", "c"), ("b", "end")]
    assert rules.run_program(shop, clauses, goal=("far", ["a", "c"])).first()["holds"]
    assert not rules.run_program(shop, clauses, goal=("far", ["c", "c"])).first()["holds"]
    assert rows(evaluate(rules.run_program(shop, clauses, {"hop": [("z", "a")]}), [("pred", "far", ["z", "$w"])])) == [("b",)]
    with pytest.raises(RuleError, match="derived"):
        rules.run_program(shop, [*clauses, rules.Clause("x", ["$u"], [("pred", "user", ["$u"]), ("not", [("pred", "hop", ["$u", "$v"])])])])
    with pytest.raises(RuleError, match="circle"):
        rules.run_program(shop, [rules.Clause("p", ["$x"], [("pred", "p", ["$x"])])])


def test_query_policies(shop):
    body = [("pred", "user", ["$u"])]
    facts = shop.with_relations({"nick": shop["amount"].where("o = 'k1'").select("u", "n")})
    assert rows(rules.query(facts, body, {"u": rules.Slot("$u"), "n": rules.Slot("$u", "nick", "null")})) == [("ann", None), ("bo", 7), ("cy", None)]
    assert rows(rules.query(facts, body, {"n": rules.Slot("$u", "nick", "skip")})) == [(7,)]
    with pytest.raises(PySparkException, match="missing"):
        rules.query(facts, body, {"n": rules.Slot("$u", "nick", "error")}).collect()
    assert rows(rules.query(shop, [("pred", "text", ["$t"])], {"t": rules.Slot("$t", kind="long", mismatch="skip")})) == [(-3,), (7,)]


def test_match_needs_connection(shop):
    assert rows(rules.match(shop, "$u", [("pred", "order", ["$o", "$u"])], {"$o": "k4"})) == [("bo",)]
    with pytest.raises(RuleError, match="connect"):
        rules.match(shop, "$u", [("pred", "user", ["$u"]), ("pred", "number", ["$n"])], {})


def test_witnesses_and_recheck(spark):
    facts = FactSpace(spark, {
        "p": spark.createDataFrame([("a", 1, "p1"), ("b", 2, "p2")], "x string, n long, _asrt string"),
        "q": spark.createDataFrame([("a", "q1"), ("c", "q2")], "x string, _asrt string"),
    })
    body = [[("pred", "p", ["$x", "$n"]), ("gt", "$n", 1)], [("pred", "q", ["$x"])], [("pred", "p", ["$x", "$n"]), ("pred", "q", ["$x"])]]
    got = explain.witnesses(facts, body, ["$x"])
    assert {r["x"]: (r["case"], [w["assertion"] for w in r["witnesses"]]) for r in got.collect()} == {"a": (1, ["q1"]), "b": (0, ["p2"]), "c": (1, ["q2"])}
    assert {r["x"]: r["cases"] for r in explain.witnesses(facts, body, ["$x"], first=False).collect()} == {"a": [1, 2], "b": [0], "c": [1]}
    less = facts.with_relations({"q": facts["q"].where("_asrt <> 'q1'")})
    assert {r["x"]: r["stands"] for r in explain.recheck(got, less).collect()} == {"a": False, "b": True, "c": True}


def test_diagnosis(shop):
    body = [[("pred", "user", ["$u"]), ("pred", "amount", ["$o", "$u", "$n"]), ("gt", "$n", 15)], [("pred", "user", ["$u"]), ("eq", "$u", "zz")]]
    ok = explain.diagnose(shop, body, {"$u": "bo"}).first()
    assert (ok["status"], ok["case"], ok["failed_condition"]) == ("passed", 0, None)
    no = explain.diagnose(shop, body, {"$u": "ann"}).first()
    assert (no["status"], no["case"], no["failed_condition"], no["held"]) == ("failed", 0, 1, 1)
    assert explain.check_binding(shop, body, {"$u": "bo"}).count() == 1
    assert explain.check_binding(shop, body, {"$u": "zed"}).count() == 0
    tree = explain.evidence_tree(shop, body, {"$u": "ann"})
    assert [c["state"] for c in tree["branches"][0]["conditions"]] == ["holds", "fails", "not_reached"]
    assert "does not hold" in explain.narrate(tree)
    with pytest.raises(RuleError):
        explain.check_binding(shop, body, {"$nope": 1})


def test_scenarios(spark):
    facts = space(spark, who=([("a",), ("b",)], "e string"), age=([("a", 1), ("b", 2)], "e string, n long"), tag=([("a", "x"), ("a", "y"), ("b", "x")], "e string, t string"), knows=([("a", "b")], "s string, t string"))
    s = scenario

    def after(*ops):
        got = s.apply_scenario(facts, ops)
        return {n: rows(got[n]) for n in facts.names()}

    before = {n: rows(facts[n]) for n in facts.names()}
    assert after(s.SetValue("age", "a", 9))["age"] == [("a", 9), ("b", 2)]
    assert after(s.EnsureMember("tag", "a", "x"))["tag"] == before["tag"]
    assert after(s.SetMembers("tag", "a", ("z",)))["tag"] == [("a", "z"), ("b", "x")]
    assert after(s.WithoutField("tag", "a"), s.WithoutValue("tag", "b", "x"))["tag"] == []
    assert after(s.WithoutRelation("knows", "a", "b"))["knows"] == []
    assert after(s.EnsureRelation("knows", "b", "a"))["knows"] == [("a", "b"), ("b", "a")]
    gone = after(s.WithoutEntity("b"))
    assert gone == {"who": [("a",)], "age": [("a", 1)], "tag": [("a", "x"), ("a", "y")], "knows": []}
    assert after(s.CreateEntity("who", "c", (("age", 7),)))["age"] == [("a", 1), ("b", 2), ("c", 7)]
    for bad in ([s.SetValue("age", "a", 1), s.SetValue("age", "a", 2)], [s.EnsureMember("tag", "a", "q"), s.WithoutValue("tag", "a", "q")], [s.SetValue("age", "b", 1), s.WithoutEntity("b")], [s.WithoutField("tag", "a"), s.EnsureMember("tag", "a", "q")]):
        with pytest.raises(RuleError):
            s.apply_scenario(facts, bad)
    body = [("pred", "age", ["$e", "$n"])]
    patched = s.overlay(facts, [s.ReplaceFact("age", ("a", 1), ("a", 5)), s.RemoveFact("age", ("b", 2))])
    assert rows(s.diff(evaluate(facts, body), evaluate(patched, body))) == [("a", 1, "removed"), ("a", 5, "added"), ("b", 2, "removed")]
    for bad in ([s.RemoveFact("age", ("a", 99))], [s.RemoveFact("age", ("a", 1))] * 2, [s.ReplaceFact("age", ("a", 1), ("b", 1))], [s.RemoveFact("age", ("a",))]):
        with pytest.raises(RuleError):
            s.overlay(facts, bad)


def test_rule_variants_and_expectations(shop):
    body = [("pred", "amount", ["$o", "$u", "$n"]), ("gt", "$n", 15)]
    assert rows(evaluate(shop, scenario.disable(body, [(0, 1)]), ["$n"])) == [(-5,), (24,), (7,)]
    assert rows(evaluate(shop, scenario.replace_literal(body, 0, 1, 15, 5), ["$n"])) == [(24,), (7,)]
    assert rows(evaluate(shop, scenario.add_conditions(body, {0: [("lt", "$n", 30)]}), ["$n"])) == [(24,)]
    for bad in (lambda: scenario.disable(body, [(0, 5)]), lambda: scenario.replace_literal(body, 0, 1, 16, 25), lambda: scenario.replace_literal(body, 0, 1, 15, "x"), lambda: scenario.disable(body, [(0, 0)])):
        with pytest.raises(RuleError):
            bad()
    a, b = evaluate(shop, body, ["$n"]), evaluate(shop, [("pred", "amount", ["$o", "$u", "$n"])], ["$n"])
    assert scenario.expect(b, "contains", a) and not scenario.expect(a, "set_equals", b)
    assert scenario.expect(a, "exists") and scenario.expect(a, "count_eq", 1)
    assert rows(scenario.compare_variants(a, b)) == [(-5, "candidate_only"), (24, "shared"), (7, "candidate_only")]


def test_dataflow_check_returns_what_is_bound():
    body = parse([("pred", "p", ["$a"]), ("addc", "$b", "$a", 1)])
    assert check(body.branches[0]) == {"$a", "$b"}


def test_no_shuffle_makes_a_set_of_a_set(spark):
    rows_ = spark.createDataFrame([(1, 10, "x"), (2, 10, "x")], "k long, g long, v string")
    twice = spark.createDataFrame([(10, "a"), (10, "b")], "g long, t string")
    keyed = FactSpace.from_tables(spark, {"t": rows_, "many": twice}, {"t": "k"})

    def shuffles(body, select=None):
        df = evaluate(keyed, body, select)
        assert df.count() == df.distinct().count()
        return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")

    assert shuffles([("pred", "t:g", ["$k", "$g"]), ("pred", "t:v", ["$k", "$v"])]) == 0
    assert shuffles([("pred", "t:g", ["$k", "$g"])], ["$g"]) == 1  # the key is gone
    assert shuffles([("pred", "t:g", ["$k", "$g"]), ("pred", "many", ["$g", "$x"])]) == 1  # unknown key
    assert shuffles([("pred", "t:v", [1, "$v"])]) == 0
    assert shuffles([("pred", "t:g", ["$k", "$g"]), ("pred", "t:g", ["$j", "$g"])], ["$k", "$j"]) == 0
    assert shuffles([("pred", "t:g", ["$k", "$g"]), ("pred", "t:g", ["$j", "$g"])], ["$k"]) == 1
    assert shuffles([("pred", "t:g", ["$k", "$g"]), ("not", [("pred", "many", ["$g", "zz"])])]) == 0
