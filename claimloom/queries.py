"""The registered queries: each runs operators of the library on the driver's tables, beside its SQL."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .functions.encoding import entity_ref_column
from .operators import evidence, paths, uncertain, views
from .plans import explain, rules, scenario
from .plans.compile import FactSpace, evaluate
from .registry import ORACLE_SQL, QUERIES, evts, query, table
from .schema import Entity, Schema

KEYS = {"customer": "c_custkey", "nation": "n_nationkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def facts(spark: SparkSession, sf: str) -> FactSpace:
    """The driver's tables as predicates: n-ary by table name, and binary ones per column."""
    return FactSpace.from_tables(spark, {t: table(spark, sf, t) for t in TABLES}, KEYS)


# predicates, filters, arithmetic


@query("SELECT n_nationkey AS n, n_name AS name FROM nation WHERE n_regionkey = 1")
def pred_const_filter(spark, sf):
    return evaluate(facts(spark, sf), [("pred", "nation", ["$n", "$name", 1])])


@query("SELECT DISTINCT l_linenumber AS x, l_linenumber AS s FROM lineitem WHERE l_linenumber = l_suppkey")
def pred_self_equality(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_linenumber", "l_suppkey")
    return evaluate(facts(spark, sf).with_relations({"pair": pairs}), [("pred", "pair", ["$x", "$x"]), ("eq", "$s", "$x")])


@query("SELECT DISTINCT c_custkey AS c, c_mktsegment AS seg, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey")
def conj_equi_join(spark, sf):
    return evaluate(facts(spark, sf), [("pred", "customer:c_mktsegment", ["$c", "$seg"]), ("pred", "orders:o_custkey", ["$o", "$c"])])


@query("SELECT r_regionkey AS r, n_nationkey AS n FROM region CROSS JOIN nation WHERE r_regionkey < n_nationkey AND r_regionkey <> n_regionkey")
def cross_join_theta(spark, sf):
    return evaluate(facts(spark, sf), [("pred", "region", ["$r", "$rn"]), ("pred", "nation", ["$n", "$nn", "$nr"]), ("lt", "$r", "$n"), ("ne", "$r", "$nr")], ["$r", "$n"])


@query("""SELECT s.s_suppkey AS s, p.p_partkey AS p FROM supplier s JOIN part p ON p.p_size >= s.s_nationkey AND p.p_size <= s.s_nationkey + 1""")
def range_join(spark, sf):
    body = [
        ("pred", "supplier:s_nationkey", ["$s", "$n"]), ("addc", "$hi", "$n", 1),
        ("pred", "part:p_size", ["$p", "$z"]), ("ge", "$z", "$n"), ("le", "$z", "$hi"),
    ]
    return evaluate(facts(spark, sf), body, ["$s", "$p"])


@query("SELECT o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice >= 200000 AND o_totalprice < 400000")
def cmp_filters(spark, sf):
    return evaluate(facts(spark, sf), [("pred", "orders:o_totalprice", ["$o", "$p"]), ("ge", "$p", 200000), ("lt", "$p", 400000)])


@query("SELECT p_partkey AS p, p_size AS z FROM part WHERE p_size IN (1, 5, 7)")
def in_filter(spark, sf):
    return evaluate(facts(spark, sf), [("pred", "part:p_size", ["$p", "$z"]), ("in", "$z", [1, 5, 7, "9"])])


@query("SELECT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'")
def ne_filter(spark, sf):
    return evaluate(facts(spark, sf), [("pred", "orders:o_orderstatus", ["$o", "$s"]), ("ne", "$s", "F")])


@query("SELECT p_partkey AS p, p_size AS z, (p_size + p_partkey)::BIGINT AS a, (p_partkey - p_size)::BIGINT AS b, (-p_size)::BIGINT AS m, (p_size * 3)::BIGINT AS t FROM part")
def arith_bind(spark, sf):
    body = [("pred", "part:p_size", ["$p", "$z"]), ("add", "$a", "$z", "$p"), ("sub", "$b", "$p", "$z"), ("neg", "$m", "$z"), ("mulc", "$t", "$z", 3)]
    return evaluate(facts(spark, sf), body)


@query("""SELECT DISTINCT a.l_orderkey AS o, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def arith_check(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    body = [("pred", "line", ["$o", "$x"]), ("pred", "line", ["$o", "$y"]), ("addc", "$y", "$x", 1)]
    return evaluate(facts(spark, sf).with_relations({"line": lines}), body)


# aggregates

ORDERS_OF = [("pred", "orders:o_custkey", ["$o", "$c"])]
PRICES_OF = [*ORDERS_OF, ("pred", "orders:o_totalprice", ["$o", "$p"])]


@query("SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS n FROM customer")
def agg_count_per_row(spark, sf):
    return evaluate(facts(spark, sf), [("pred", "customer:c_nationkey", ["$c", "$k"]), ("eq", "$n", ("count", None, ORDERS_OF))], ["$c", "$n"])


@query("""SELECT c_custkey AS c, coalesce(sum(o_shippriority), 0)::BIGINT AS s FROM customer LEFT JOIN
(SELECT o_custkey, o_orderkey % 10 AS o_shippriority FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey""")
def agg_sum_empty_zero(spark, sf):
    prio = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("p"))
    body = [("pred", "customer:c_nationkey", ["$c", "$k"]), ("eq", "$s", ("sum", "$q", [*ORDERS_OF, ("pred", "prio", ["$o", "$q"])]))]
    return evaluate(facts(spark, sf).with_relations({"prio": prio}), body, ["$c", "$s"])


@query("SELECT c_custkey AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def agg_min_max_mean(spark, sf):
    body = [("pred", "customer:c_nationkey", ["$c", "$k"]), *(("eq", v, (kind, "$p", PRICES_OF)) for v, kind in (("$lo", "min"), ("$hi", "max"), ("$mean", "mean")))]
    return evaluate(facts(spark, sf), body, ["$c", "$lo", "$hi", "$mean"]).withColumn("mean", F.round("mean", 4))


@query("SELECT o_custkey AS c FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def agg_having(spark, sf):
    return evaluate(facts(spark, sf), [("pred", "customer:c_nationkey", ["$c", "$k"]), ("ge", ("count", None, ORDERS_OF), 12)], ["$c"])


@query("""SELECT c_custkey AS c FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)
> (SELECT coalesce(sum(n), 0) FROM (SELECT n_regionkey * 4 AS n FROM nation WHERE n_nationkey = c_nationkey))""")
def agg_two_sides(spark, sf):
    four = table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") * 4).alias("n"))
    body = [("pred", "customer:c_nationkey", ["$c", "$k"]), ("gt", ("count", None, ORDERS_OF), ("sum", "$v", [("pred", "four", ["$k", "$v"])]))]
    return evaluate(facts(spark, sf).with_relations({"four": four}), body, ["$c"])


@query("SELECT a.s_suppkey AS s, (SELECT count(*) FROM supplier b WHERE b.s_nationkey < a.s_nationkey)::BIGINT AS n FROM supplier a")
def agg_noneq_correlation(spark, sf):
    body = [("pred", "supplier:s_nationkey", ["$s", "$k"]), ("eq", "$n", ("count", None, [("pred", "supplier:s_nationkey", ["$t", "$j"]), ("lt", "$j", "$k")]))]
    return evaluate(facts(spark, sf), body, ["$s", "$n"])


# negation, union, rules


@query("SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def not_exists(spark, sf):
    return evaluate(facts(spark, sf), [("pred", "customer:c_nationkey", ["$c", "$k"]), ("not", [*PRICES_OF, ("gt", "$p", 300000)])], ["$c"])


@query("""SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal)""")
def not_or_branches(spark, sf):
    body = [("pred", "customer:c_acctbal", ["$c", "$b"]), ("not", [*ORDERS_OF, ("pred", "orders:o_orderstatus", ["$o", "F"])]), ("not", [*PRICES_OF, ("lt", "$p", "$b")])]
    return evaluate(facts(spark, sf), body, ["$c"])


@query("SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE value > 150")
def or_union_distinct(spark, sf):
    space = facts(spark, sf).with_relations({"event": evts(spark, sf).select("event_id", "user_id", "event_type", "value")})
    return evaluate(space, [[("pred", "event", ["$e", "$u", "purchase", "$v"])], [("pred", "event", ["$e", "$u", "$t", "$v"]), ("gt", "$v", 150)]], ["$u"])


@query("""WITH a AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT s_suppkey, r_name FROM supplier JOIN a ON s_nationkey = n_nationkey) SELECT s_suppkey AS s, r_name AS r FROM b WHERE r_name <> 'ASIA'""")
def ruleref_chain(spark, sf):
    registry = rules.RuleRegistry([
        rules.RuleSpec("nation_region", "1", ["$n", "$r"], [("pred", "nation:n_regionkey", ["$n", "$k"]), ("pred", "region", ["$k", "$r"])]),
        rules.RuleSpec("supplier_region", "1", ["$s", "$r"], [("pred", "supplier:s_nationkey", ["$s", "$n"]), ("ruleref", "nation_region", "1", ["$n", "$r"])]),
    ])
    return rules.run_rule(facts(spark, sf), rules.RuleSpec("top", "1", ["$s", "$r"], [("ruleref", "supplier_region", "1", ["$s", "$r"]), ("ne", "$r", "ASIA")]), registry)


@query("SELECT s_nationkey AS n FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def ruleref_union(spark, sf):
    space = rules.run_program(facts(spark, sf), [
        rules.Clause("busy", ["$n"], [("pred", "supplier:s_nationkey", ["$s", "$n"])]),
        rules.Clause("busy", ["$n"], [("pred", "customer:c_nationkey", ["$c", "$n"]), ("pred", "customer:c_acctbal", ["$c", "$b"]), ("gt", "$b", 9000)]),
    ])
    return evaluate(space, [("pred", "busy", ["$n"])])


def _rules():
    rich = rules.Rule("rich", [("pred", "customer:c_acctbal", ["$c", "$b"]), ("gt", "$b", 8000)], {"who": rules.Port("$c", "customer")})
    building = rules.Rule("building", [("pred", "customer:c_mktsegment", ["$c", "BUILDING"])], {"who": rules.Port("$c", "customer")})
    big = rules.Rule("big", [*PRICES_OF, ("gt", "$p", 250000)], {"who": rules.Port("$c", "customer"), "order": rules.Port("$o", "order")})
    return rich, building, big


@query("""SELECT DISTINCT c_custkey AS who, o_orderkey AS ord FROM customer JOIN orders ON o_custkey = c_custkey
WHERE o_totalprice > 250000 AND (c_acctbal > 8000 OR c_mktsegment = 'BUILDING')""")
def ruleexpr_dnf(spark, sf):
    rich, building, big = _rules()
    a, b, o = rich.as_("a"), building.as_("b"), big.as_("o")
    expr = rules.any_of(rules.all_of(a, o).join(a.who.eq(o.who)), rules.all_of(b, o).join(b.who.eq(o.who)))
    return rules.evaluate_expr(facts(spark, sf), expr, {"who": o.who, "ord": o.order})


@query("SELECT DISTINCT c_custkey AS who, o_orderkey AS ord FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 250000 AND c_acctbal > 8000")
def port_join(spark, sf):
    rich, _, big = _rules()
    o = big.as_("o")
    return rules.evaluate_expr(facts(spark, sf), rules.all_of(rich.as_("a"), o).join_by_ports("who"), {"who": o.who, "ord": o.order})


@query("""SELECT DISTINCT c_custkey AS who, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey
WHERE c_acctbal > 8000 AND o_totalprice > 250000 AND c_nationkey >= 5""")
def policy_compare_navigate(spark, sf):
    home = rules.Rule("home", [("pred", "customer:c_nationkey", ["$c", "$n"])], {"who": rules.Port("$c", "customer"), "nation": rules.Port("$n", "nation"), "number": rules.Port("$n", "int")})
    rich, _, big = _rules()
    a, o, h = rich.as_("a"), big.as_("o"), home.as_("h")
    policy = rules.policy_all(a, o, h, rules.Unify(a.who, o.who), rules.Unify(a.who, h.who), rules.Compare("ge", h.number, rules.Literal(5)))
    return rules.evaluate_policy(facts(spark, sf), policy, {"who": a.who, "nation": rules.Nav(h.nation, "nation:n_name")})


@query("""SELECT target, candidate AS c FROM (SELECT 'vip' AS target, c_custkey AS candidate FROM customer WHERE c_acctbal > 9500
UNION SELECT 'watch', c_custkey FROM customer WHERE c_acctbal > 9500)""")
def inference_heads(spark, sf):
    found = rules.inference(facts(spark, sf), [("pred", "customer:c_acctbal", ["$c", "$b"]), ("gt", "$b", 9500)], {"vip": ["$c"], "watch": ["$c"]}, "vips")
    return found.select("target", F.get_json_object(F.col("args")[0], "$.v").cast("long").alias("c"))


@query("SELECT c_custkey AS c, n_name AS nation, try_cast(c_mktsegment AS BIGINT) AS seg FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 10")
def query_slots(spark, sf):
    space = facts(spark, sf)
    low = table(spark, sf, "nation").where("n_nationkey < 10").select("n_nationkey", "n_name")
    slots = {"c": rules.Slot("$c"), "nation": rules.Slot("$k", "low:name", "null"), "seg": rules.Slot("$g", kind="long", mismatch="null")}
    return rules.query(space.with_relations({"low:name": low}), [("pred", "customer:c_nationkey", ["$c", "$k"]), ("pred", "customer:c_mktsegment", ["$c", "$g"])], slots)


# the ledger's views; events stand for claims: event_id is the sequence


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def chosen_latest(spark, sf):
    return views.chosen(evts(spark, sf).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type = 'error')")
def active_not_revoked(spark, sf):
    e = evts(spark, sf)
    revocations = e.where("event_type = 'error'").select((F.col("event_id") - 1).alias("revoked_asrt_id"))
    return views.active(e.select("event_id"), revocations, "event_id")


def _meta_ledger(spark, sf):
    """Events as metadata: users are assertions, types keys, and a small value unsets."""
    e = evts(spark, sf)
    keep = F.col("value") >= 5
    log = e.select(
        F.col("user_id").cast("string").alias("asrt_id"), F.col("event_type").alias("key"), F.when(keep, F.lit("str")).alias("kind"),
        F.when(keep, F.col("event_id").cast("string")).alias("value"), F.floor(F.col("event_id") / 100).alias("tx_seq"), (F.col("event_id") % 100).cast("int").alias("op_ordinal"),
    )
    claims = log.select("asrt_id").distinct().select("asrt_id", *[F.lit(None).cast(t).alias(n) for n, t in (("seq", "long"),)], F.lit(0).cast("long").alias("tx_seq"), F.lit(0).alias("op_ordinal"))
    defaults = spark.range(1).select(F.lit(0).cast("long").alias("tx_seq"), F.lit("channel").alias("key"), F.lit("str").alias("kind"), F.lit("web").alias("value"))
    return views.Ledger.of(spark, claims=claims, claim_meta=log, tx_defaults=defaults)


META_SQL = """WITH m AS (SELECT user_id::VARCHAR AS asrt_id, event_type AS key, arg_max(CASE WHEN value >= 5 THEN event_id::VARCHAR ELSE '' END, event_id) AS v
FROM events WHERE {where} GROUP BY 1, 2)
SELECT asrt_id, key, v AS value FROM m WHERE v <> '' UNION ALL SELECT DISTINCT user_id::VARCHAR, 'channel', 'web' FROM events"""


@query(META_SQL.format(where="event_id <= 4050"))
def meta_as_of(spark, sf):
    return views.effective_meta(_meta_ledger(spark, sf), (40, 50)).select("asrt_id", "key", "value")


@query(META_SQL.format(where="true"))
def meta_unset(spark, sf):
    return views.effective_meta(_meta_ledger(spark, sf)).select("asrt_id", "key", "value")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS f, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') END AS t FROM orders)
WHERE f <= '1996-06-15' AND (t IS NULL OR t > '1996-06-15')""")
def valid_at(spark, sf):
    o = table(spark, sf, "orders")
    day = "yyyy-MM-dd"
    rows = o.select("o_orderkey", F.date_format("o_orderdate", day).alias("valid_from"), F.when(F.col("o_orderstatus") != "O", F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"), day)).alias("valid_to"))
    return views.valid_at(rows, "1996-06-15").select("o_orderkey")


@query("""SELECT c_custkey, c_mktsegment, coalesce(list_sort(list(DISTINCT o_orderkey)), []) AS orders FROM customer JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey, c_mktsegment HAVING list_contains(list(o_orderkey), 10)""")
def entity_find_pivot(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    customer = Entity("Customer", (("c_custkey", "int"),), (("c_mktsegment", "string"), ("orders", "int", "multi")))

    def about(key: str) -> Column:
        return entity_ref_column("Customer", [("c_custkey", "int")], F.col(key)).alias("a0")

    space = FactSpace(
        spark,
        {
            "Customer:exists": c.select(about("c_custkey")),
            "customer:c_custkey": c.select(about("c_custkey"), F.col("c_custkey").alias("a1")),
            "customer:c_mktsegment": c.select(about("c_custkey"), F.col("c_mktsegment").alias("a1")),
            "customer:orders": o.select(about("o_custkey"), F.col("o_orderkey").alias("a1")),
        },
    )
    found = views.find(space, Schema((customer,)), "Customer", orders=10)
    # find gives multi-valued fields as texts
    numbers = F.array_sort(F.col("orders").cast(f"array<{dict(o.dtypes)['o_orderkey']}>"))
    return found.select("c_custkey", "c_mktsegment", numbers.alias("orders"))


# paths


@query("""SELECT DISTINCT r_regionkey AS n0, n_nationkey AS n1, c_custkey AS n2, o_orderkey AS n3 FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_regionkey = 2""")
def relation_path_forward(spark, sf):
    space = _graph(spark, sf)
    return paths.relation_path(space, "regions", [paths.Step("has_nation"), paths.Step("has_customer"), paths.Step("has_order")], [None, None, "ordered"], [(0, "eq", 2)])


@query("""SELECT DISTINCT o_orderkey AS n0, c_custkey AS n1, n_nationkey AS n2 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_regionkey = 1""")
def relation_path_reverse(spark, sf):
    one = table(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey")
    space = _graph(spark, sf).with_relations({"region one": one})
    return paths.relation_path(space, "ordered", [paths.Step("has_order", False), paths.Step("has_customer", False)], [None, "region one"])


def _graph(spark, sf):
    t = {n: table(spark, sf, n) for n in ("region", "nation", "customer", "orders")}
    return FactSpace(spark, {
        "regions": t["region"].select("r_regionkey"), "ordered": t["orders"].select("o_orderkey"), "has_nation": t["nation"].select("n_regionkey", "n_nationkey"),
        "has_customer": t["customer"].select("c_nationkey", "c_custkey"), "has_order": t["orders"].select("o_custkey", "o_orderkey"),
    })


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 2 + 1) % 25 AS t, round(0.5 + (n_nationkey % 5) / 10.0, 6) AS c FROM nation WHERE (n_nationkey * 2 + 1) % 25 > n_nationkey
UNION ALL SELECT n_nationkey, n_nationkey + 1, round(0.4 + (n_nationkey % 7) / 20.0, 6) FROM nation WHERE n_nationkey < 24),
d AS (SELECT s, t, max(c) AS c FROM e GROUP BY s, t),
p(s, t, c, k, path) AS (SELECT s, t, c, 1, [s, t] FROM d UNION ALL SELECT p.s, d.t, least(p.c, d.c), k + 1, list_append(path, d.t) FROM p JOIN d ON d.s = p.t WHERE k < 24)
SELECT s AS source, t AS target, c::DOUBLE AS confidence, k AS depth, (SELECT min(k) FROM p q WHERE q.s = p.s AND q.t = p.t) AS min_support_depth
FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY c DESC, k, path) AS r FROM p) p WHERE r = 1""")
def widest_path(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    a = n.select(F.col("n").alias("source"), ((F.col("n") * 2 + 1) % 25).cast("int").alias("target"), F.round(F.lit(0.5) + (F.col("n") % 5) / 10, 6).alias("confidence")).where("target > source")
    b = n.where("n < 24").select(F.col("n").alias("source"), (F.col("n") + 1).alias("target"), F.round(F.lit(0.4) + (F.col("n") % 7) / 20, 6).alias("confidence"))
    return paths.widest_paths(a.union(b)).select("source", "target", "confidence", "depth", "min_support_depth")


# evidence


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id // 10 DESC, event_id::VARCHAR) AS r FROM events) WHERE r = 1""")
def mapping_prefer_source(spark, sf):
    rows = _mapping(spark, sf)
    return evidence.resolve_mapping(rows, ["user_id"], ["event_type"], "prefer_source", ["purchase", "click"]).select("user_id", "event_type", F.col("asrt_id").cast("long").alias("event_id"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 10 DESC, event_id::VARCHAR) AS r FROM events) WHERE r = 1""")
def mapping_latest(spark, sf):
    rows = _mapping(spark, sf)
    return evidence.resolve_mapping(rows, ["user_id"], ["event_type"], "latest_by_ingested_at_then_min_assertion_id").select("user_id", "event_type", F.col("asrt_id").cast("long").alias("event_id"))


def _mapping(spark, sf):
    return evts(spark, sf).select("user_id", "event_type", F.col("event_id").cast("string").alias("asrt_id"), F.floor(F.col("event_id") / 10).alias("ingested_at"), F.col("event_type").alias("source"))


@query("""SELECT user_id AS subject, event_type AS relation, k AS object, confidence, claim_id FROM (SELECT user_id, event_type, event_id % 3 AS k, round(value / 1000, 6) AS confidence, event_id::VARCHAR AS claim_id,
row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY round(value / 1000, 6) DESC, event_id::VARCHAR) AS r FROM events) WHERE r = 1""")
def max_evidence(spark, sf):
    e = evts(spark, sf)
    rows = e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("relation"), (F.col("event_id") % 3).alias("object"), (F.col("value") / 1000).alias("confidence"), F.lit("log").alias("source_type"), F.col("event_id").cast("string").alias("claim_id"))
    return evidence.max_evidence(rows).drop("source_type")


def _conditions(spark, sf):
    return evts(spark, sf).select("user_id", F.col("event_id").cast("string").alias("condition_key"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4 / 4).alias("weight"), F.when(F.col("event_id") % 5 != 0, F.round(F.col("event_id") % 10 / 10, 1)).alias("confidence"))


@query("""SELECT user_id, min(CASE WHEN event_id % 4 <> 0 THEN round((event_id % 4) / 4.0 * CASE WHEN event_id % 5 <> 0 THEN (event_id % 10) / 10.0 ELSE 1.0 END, 6) END)::DOUBLE AS certainty FROM events GROUP BY user_id""")
def certainty_bottleneck(spark, sf):
    return evidence.certainty(_conditions(spark, sf), ["user_id"], "bottleneck")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 4 <> 0 THEN (event_id % 4) / 4.0 END::DOUBLE AS w, CASE WHEN event_id % 5 <> 0 THEN (event_id % 10) / 10.0 ELSE 1.0 END::DOUBLE AS c FROM events),
s AS (SELECT *, sum(w) OVER (PARTITION BY user_id) AS total FROM e) SELECT user_id, round(sum(round(w / total * c, 6)), 6) AS certainty FROM s GROUP BY user_id""")
def certainty_additive(spark, sf):
    return evidence.certainty(_conditions(spark, sf), ["user_id"], "additive")


@query("""WITH e AS (SELECT user_id, event_id::VARCHAR AS condition_key, CASE WHEN event_id % 4 <> 0 THEN round((event_id % 4) / 4.0 * CASE WHEN event_id % 5 <> 0 THEN (event_id % 10) / 10.0 ELSE 1.0 END, 6) END::DOUBLE AS impact FROM events)
SELECT user_id, condition_key, (row_number() OVER (PARTITION BY user_id ORDER BY impact NULLS LAST, condition_key))::INTEGER AS place, coalesce(impact = min(impact) OVER (PARTITION BY user_id), false) AS is_bottleneck FROM e""")
def condition_ranking(spark, sf):
    return evidence.ranked_conditions(_conditions(spark, sf), ["user_id"]).select("user_id", "condition_key", "place", "is_bottleneck")


# what-if


@query("""SELECT n, name, change FROM (SELECT n_nationkey AS n, n_name AS name, 'removed' AS change FROM nation WHERE n_nationkey = 6
UNION ALL SELECT n_nationkey, n_name, 'added' FROM nation WHERE n_nationkey = 4)""")
def overlay_diff(spark, sf):
    space = facts(spark, sf)
    body = [("pred", "nation:n_regionkey", ["$n", 1]), ("pred", "nation:n_name", ["$n", "$name"])]
    changed = scenario.overlay(space, [scenario.RemoveFact("nation:n_regionkey", (6, 1)), scenario.ReplaceFact("nation:n_regionkey", (4, 4), (4, 1))])
    return scenario.diff(evaluate(space, body), evaluate(changed, body))


@query("SELECT n_nationkey AS n, CASE WHEN n_nationkey = 7 THEN 'A' ELSE n_name END AS name FROM nation UNION ALL SELECT 7, 'B'")
def scenario_set_exact(spark, sf):
    patched = scenario.apply_scenario(facts(spark, sf), [scenario.SetMembers("nation:n_name", 7, ("A", "B"))])
    return evaluate(patched, [("pred", "nation:n_name", ["$n", "$name"])])


@query("SELECT c_custkey AS c, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey <> 5")
def scenario_without_entity(spark, sf):
    space = facts(spark, sf).only(["customer:c_nationkey", "nation:n_name"])
    # customers are told apart from nations by a reference of their own
    renamed = space.with_relations({"customer:c_nationkey": space["customer:c_nationkey"].select(F.concat(F.lit("c"), F.col("c_custkey")).alias("c"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("n")), "nation:n_name": space["nation:n_name"].select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("n"), "n_name")})
    patched = scenario.apply_scenario(renamed, [scenario.WithoutEntity("n5")])
    out = evaluate(patched, [("pred", "customer:c_nationkey", ["$c", "$n"]), ("pred", "nation:n_name", ["$n", "$name"])], ["$c", "$name"])
    return out.withColumn("c", F.substring("c", 2, 20).cast("long"))


@query("""SELECT c_custkey AS c, CASE WHEN a AND b THEN 'shared' WHEN a THEN 'primary_only' ELSE 'candidate_only' END AS side
FROM (SELECT c_custkey, c_acctbal > 5000 AS a, c_nationkey < 10 AS b FROM customer) WHERE a OR b""")
def variant_compare(spark, sf):
    space = facts(spark, sf)
    a = evaluate(space, [("pred", "customer:c_acctbal", ["$c", "$b"]), ("gt", "$b", 5000)], ["$c"])
    b = evaluate(space, [("pred", "customer:c_nationkey", ["$c", "$n"]), ("lt", "$n", 10)], ["$c"])
    return scenario.compare_variants(a, b)


# explanations

CASES = [[("pred", "customer:c_acctbal", ["$c", "$b"]), ("gt", "$b", 5000)], [("pred", "customer:c_nationkey", ["$c", "$n"]), ("lt", "$n", 10)]]


def _signed(spark, sf) -> FactSpace:
    """Balances and nations of customers as assertions with ids."""
    c = table(spark, sf, "customer")
    return FactSpace(spark, {
        "customer:c_acctbal": c.select("c_custkey", "c_acctbal", F.concat(F.lit("b"), "c_custkey").alias("_asrt")),
        "customer:c_nationkey": c.select("c_custkey", "c_nationkey", F.concat(F.lit("n"), "c_custkey").alias("_asrt")),
    })


@query("""SELECT c_custkey AS c, CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END AS "case", 0 AS condition,
CASE WHEN c_acctbal > 5000 THEN 'customer:c_acctbal' ELSE 'customer:c_nationkey' END AS predicate,
CASE WHEN c_acctbal > 5000 THEN 'b' ELSE 'n' END || c_custkey AS assertion FROM customer WHERE c_acctbal > 5000 OR c_nationkey < 10""")
def witness_first_branch(spark, sf):
    return explain.explain_columns(explain.witnesses(_signed(spark, sf), CASES, ["$c"])).select("c", "case", "condition", "predicate", "assertion")


@query("""SELECT c_custkey AS c, CASE WHEN c_acctbal > 5000 AND c_nationkey < 10 THEN '0,1' WHEN c_acctbal > 5000 THEN '0' ELSE '1' END AS cases
FROM customer WHERE c_acctbal > 5000 OR c_nationkey < 10""")
def witness_all_branches(spark, sf):
    got = explain.witnesses(_signed(spark, sf), CASES, ["$c"], first=False)
    return got.withColumn("cases", F.array_join("cases", ","))


@query("""SELECT c_custkey AS c, CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END AS "case", NOT (c_acctbal > 5000 AND c_custkey % 3 = 0) AS stands FROM customer WHERE c_acctbal > 5000 OR c_nationkey < 10""")
def recheck_lost_assertions(spark, sf):
    space = _signed(spark, sf)
    found = explain.witnesses(space, CASES, ["$c"])
    less = space.with_relations({"customer:c_acctbal": space["customer:c_acctbal"].where("c_custkey % 3 <> 0")})
    return explain.recheck(found, less).drop("witnesses")


@query("""SELECT c, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'same' ELSE 'changed' END AS change FROM
(SELECT c_custkey AS c, CASE WHEN c_acctbal > 5000 THEN 'b' WHEN c_nationkey < 10 THEN 'n' END AS old,
CASE WHEN c_acctbal > 5000 AND c_custkey % 3 <> 0 THEN 'b' WHEN c_nationkey < 10 THEN 'n' END AS new FROM customer) WHERE old IS NOT NULL OR new IS NOT NULL""")
def proof_changes(spark, sf):
    space = _signed(spark, sf)
    less = space.with_relations({"customer:c_acctbal": space["customer:c_acctbal"].where("c_custkey % 3 <> 0")})
    before, after = (explain.witnesses(s, CASES, ["$c"]).drop("case") for s in (space, less))
    return explain.proof_diff(before, after, ["c"])


@query("""SELECT n, name, CASE WHEN n % 5 = 0 THEN 'removed' END AS change FROM (SELECT n_nationkey AS n, n_name AS name, n_regionkey AS r FROM nation) WHERE false
UNION ALL SELECT n_nationkey, n_name, 'removed' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_name, 'added' FROM nation WHERE n_regionkey = 3 AND n_nationkey > 5""")
def rule_variant_changes(spark, sf):
    body = [("pred", "nation:n_regionkey", ["$n", 1]), ("pred", "nation:n_name", ["$n", "$name"])]
    variant = scenario.add_conditions(scenario.replace_literal(body, 0, 0, 1, 3), {0: [("gt", "$n", 5)]})
    return scenario.compare_rule(facts(spark, sf), body, variant, ["$n", "$name"])


@query("""SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 1) > 0 AS some, (SELECT count(*) FROM nation WHERE n_regionkey = 1) = 5 AS five,
(SELECT count(*) FROM nation WHERE n_regionkey = 1 AND n_nationkey IN (1, 2)) = 2 AS has, false AS exactly""")
def expectations_of_a_rule(spark, sf):
    got = evaluate(facts(spark, sf), [("pred", "nation:n_regionkey", ["$n", 1])], ["$n"])
    some = table(spark, sf, "nation").where("n_nationkey IN (1, 2)").select(F.col("n_nationkey").alias("n"))
    answers = (scenario.expect(got, "exists"), scenario.expect(got, "count_eq", 5), scenario.expect(got, "contains", some), scenario.expect(got, "set_equals", some))
    return spark.createDataFrame([answers], "some boolean, five boolean, has boolean, exactly boolean")


@query("""SELECT c_custkey AS c, CASE WHEN c_acctbal > 5000 OR c_nationkey < 10 THEN 'passed' ELSE 'failed' END AS status,
CASE WHEN c_acctbal > 5000 THEN 0 WHEN c_nationkey < 10 THEN 1 ELSE 0 END AS "case", CASE WHEN c_acctbal > 5000 OR c_nationkey < 10 THEN NULL ELSE 1 END AS failed_condition FROM customer""")
def why_not_universe(spark, sf):
    return explain.why_not(facts(spark, sf), CASES, table(spark, sf, "customer").select(F.col("c_custkey").alias("c")))


@query("""SELECT 0 AS "case", 0 AS condition, count(*)::BIGINT AS solutions FROM customer UNION ALL SELECT 0, 1, count(*) FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT 1, 0, count(*) FROM customer UNION ALL SELECT 1, 1, count(*) FROM customer WHERE c_nationkey < 10""")
def frontier_counts(spark, sf):
    return explain.frontier(facts(spark, sf), CASES)


@query("""SELECT CASE WHEN c_acctbal > 5000 OR c_nationkey < 10 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN c_acctbal > 5000 THEN 0 WHEN c_nationkey < 10 THEN 1 ELSE 0 END AS "case",
CASE WHEN c_acctbal > 5000 OR c_nationkey < 10 THEN NULL ELSE 1 END AS failed_condition, CASE WHEN c_acctbal > 5000 OR c_nationkey < 10 THEN 2 ELSE 1 END AS held FROM customer WHERE c_custkey = 7""")
def diagnose_binding(spark, sf):
    return explain.diagnose(facts(spark, sf), CASES, {"$c": 7})


# functions


@query("SELECT p_partkey, p_size, p_size // 10 AS decade FROM part")
def product_function_udf(spark, sf):
    return scalar.apply_function(table(spark, sf, "part").select("p_partkey", "p_size"), lambda z: z // 10, ["p_size"], "decade", "int")


@query("SELECT DISTINCT p_brand FROM part WHERE starts_with(lower(trim(p_brand)), 'brand#1')")
def candidate_casefold_prefix(spark, sf):
    return scalar.candidates(table(spark, sf, "part"), "p_brand", " BRAND#1", None, "prefix")[0]


# time and uncertainty


@query("""SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01')) // 900000000 AS bin_from,
(epoch_us(ts) + 3600000000 - epoch_us(TIMESTAMP '2000-01-01') + 899999999) // 900000000 AS bin_to FROM events""")
def time_binned(spark, sf):
    e = evts(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("valid_from"))
    e = e.withColumn("valid_to", F.col("valid_from") + F.expr("INTERVAL 1 HOUR"))
    start, end = F.lit("2000-01-01").cast("timestamp"), F.lit("2040-01-01").cast("timestamp")
    return uncertain.time_binned(e, start, end, timedelta(minutes=15)).select("event_id", "bin_from", "bin_to")


@query("""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS f, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS t FROM orders),
b AS (SELECT f AS b FROM o UNION SELECT t FROM o WHERE t IS NOT NULL UNION SELECT '1990-01-01' UNION SELECT '2010-01-01'), r AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS k FROM b)
SELECT o_orderkey, x.k AS active_from, y.k AS active_to FROM o JOIN r x ON x.b = f LEFT JOIN r y ON y.b = t""")
def valid_boundaries(spark, sf):
    o = table(spark, sf, "orders")
    day = "yyyy-MM-dd"
    rows = o.select("o_orderkey", F.date_format("o_orderdate", day).alias("valid_from"), F.when(F.col("o_orderstatus") != "O", F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), day)).alias("valid_to"))
    return uncertain.boundary_steps(rows, "1990-01-01", "2010-01-01").select("o_orderkey", "active_from", "active_to")


@query("""WITH RECURSIVE r(n, k) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION SELECT e.t, k + 1 FROM r JOIN
(SELECT n_nationkey AS s, n_nationkey + 1 AS t FROM nation UNION ALL SELECT n_nationkey, n_nationkey * 3 FROM nation WHERE n_nationkey > 0) e ON e.s = n WHERE k < 6)
SELECT n AS node, 'reached' AS label, 0.5::DOUBLE AS lo, 1.0::DOUBLE AS hi, min(k) AS step FROM r WHERE k > 0 GROUP BY n""")
def interval_fixpoint(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    edges = n.select(F.col("n").alias("source"), (F.col("n") + 1).alias("target")).union(n.where("n > 0").select("n", F.col("n") * 3)).withColumn("kind", F.lit("e"))
    start = n.where("n = 0").select(F.col("n").alias("node"), F.lit("start").alias("label"), F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0).alias("from"), F.lit(None).cast("int").alias("to"))
    rs = [uncertain.IntervalRule("start", "e", "reached", 0.5, 1.0), uncertain.IntervalRule("reached", "e", "reached", 0.5, 1.0)]
    return uncertain.interval_fixpoint(start, edges, rs, 6)


@query("""WITH l AS (SELECT o_custkey, o_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 0.5 ELSE 0.25 END AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
x AS (SELECT o_custkey, o_orderkey, product(p) AS q FROM l GROUP BY ALL), y AS (SELECT o_custkey, 1 - product(1 - q) AS p FROM x GROUP BY o_custkey)
SELECT o_custkey, round(CASE WHEN o_custkey % 2 = 0 THEN 0.5 ELSE 1 END * p, 9) AS p FROM y""")
def prob_independent_or(spark, sf):
    """Proofs per order; those of every second customer also share one uncertain fact, so the exact solver counts them."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.monotonically_increasing_id().cast("string").alias("fact"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    proofs = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.col("o_orderkey").alias("proof"), "fact", F.when(F.col("l_quantity") > 25, 0.5).otherwise(0.25).alias("p"))
    common = orders.where("o_custkey % 2 = 0").join(proofs.select(F.col("proof").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    common = common.select("o_custkey", F.col("o_orderkey").alias("proof"), F.concat(F.lit("c"), "o_custkey").alias("fact"), F.lit(0.5).alias("p"))
    return uncertain.answer_probability(proofs.unionByName(common), ["o_custkey"]).withColumn("p", F.round("p", 9))


@query("""WITH x AS (SELECT c_custkey AS c, 1 - (CASE WHEN c_acctbal > 5000 THEN 1 - 0.5 * 0.8 ELSE 1 END) * (CASE WHEN c_nationkey < 10 THEN 1 - 0.25 ELSE 1 END) AS p FROM customer)
SELECT c, round(p, 9)::DOUBLE AS p FROM x WHERE p > 0""")
def prob_branch_chances(spark, sf):
    space = _signed(spark, sf)
    unsure = space["customer:c_acctbal"].withColumn("_p", F.lit(0.8))
    space = space.with_relations({"customer:c_acctbal": unsure})
    return uncertain.rule_probability(space, CASES, ["$c"], case_probabilities=[0.5, 0.25]).withColumn("p", F.round("p", 9))


@query("""SELECT event_id::VARCHAR AS asrt_id, CASE WHEN event_id % 4 = 0 THEN 0.9 WHEN event_id % 4 = 1 THEN 0.3 WHEN event_id % 4 = 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS p FROM events""")
def fact_probabilities(spark, sf):
    """Own namespace over the shared one, the last event of each; else the middle of a bound; else 1."""
    e = evts(spark, sf).select(F.col("event_id"), F.col("event_id").cast("string").alias("asrt_id"))

    def said(rows, namespace, key, value, seq, kind="float"):
        return rows.select("asrt_id", F.lit(namespace).alias("namespace"), F.lit("semantic").alias("category"), F.lit(key).alias("key"), F.lit(kind).alias("kind"), F.lit(value).alias("value"), F.lit(seq).alias("seq"))

    zero, one, two = (e.where(F.col("event_id") % 4 == k) for k in range(3))
    parts = [said(zero, "shared", "probability", "0.1", 9), said(zero, "problog", "probability", "0.2", 1), said(zero, "problog", "probability", "0.9", 2), said(one, "shared", "probability", "0.3", 1), said(one, "other", "probability", "0.7", 5), said(one, "problog", "probability", "true", 7, "bool"), said(two, "shared", "bound", "[0.4, 0.6]", 1)]
    return uncertain.fact_probability(e.select("asrt_id"), reduce(DataFrame.unionByName, parts), "midpoint")


@query("""SELECT c_custkey, (c_custkey % 5) / 10.0::DOUBLE AS lower, (c_custkey % 7 + 5) / 12.0::DOUBLE AS upper, ((c_custkey % 5) / 10.0::DOUBLE + (c_custkey % 7 + 5) / 12.0::DOUBLE) / 2 AS midpoint,
CASE WHEN (c_custkey % 5) / 10.0::DOUBLE = (c_custkey % 7 + 5) / 12.0::DOUBLE THEN (c_custkey % 5) / 10.0::DOUBLE ELSE 0.75 END AS identity_probability FROM customer""")
def bounds_as_points(spark, sf):
    low, high = (F.col("c_custkey") % 5) / 10, (F.col("c_custkey") % 7 + 5) / 12
    cols = [uncertain.point_of_bound(low, high, how, 0.75).alias(how) for how in ("lower", "upper", "midpoint", "identity_probability")]
    return table(spark, sf, "customer").select("c_custkey", *cols)


@query("""WITH RECURSIVE s(n, k) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n + 3, k + 1 FROM s JOIN nation ON n_nationkey = n + 3 AND n_regionkey <> 2 WHERE k < 5)
SELECT n::INTEGER AS a0, 0.6::DOUBLE AS lo, 1.0::DOUBLE AS hi, k AS step FROM s WHERE k > 0""")
def interval_program_two_atoms(spark, sf):
    """Reached from three nations on, over edges that are sure enough, into nations of some regions."""
    n = table(spark, sf, "nation")
    sure = [F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0).alias("from"), F.lit(None).cast("int").alias("to")]
    edges = n.select(F.col("n_nationkey").alias("a0"), (F.col("n_nationkey") + 3).cast("int").alias("a1"), F.lit(0.8).alias("lo"), F.lit(0.9).alias("hi"), *sure[2:])
    weak = n.select(F.col("n_nationkey").alias("a0"), (F.col("n_nationkey") + 1).cast("int").alias("a1"), F.lit(0.3).alias("lo"), F.lit(0.9).alias("hi"), *sure[2:])
    given = {"edge": edges.union(weak), "open": n.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("a0"), *sure), "on": n.where("n_nationkey < 3").select(F.col("n_nationkey").alias("a0"), *sure)}
    body = [("pred", "on", ["$x"]), ("pred", "edge", ["$x", "$y"]), ("pred", "open", ["$y"])]
    rule = uncertain.IntervalClause("on", ("$y",), body, (0.6, 1.0), None, {"on": (0.5, 1.0), "edge": (0.7, 1.0)})
    return uncertain.interval_program(given, [rule], 5)["on"]


@query("SELECT s AS o_custkey, round(sum(w), 9) AS p FROM (SELECT DISTINCT o_custkey AS s, o_orderkey % 3 AS arm, CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM orders) GROUP BY s")
def weighted_choice(spark, sf):
    arms = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 3).cast("int").alias("arm"))
    return uncertain.weighted_choice(arms, ["o_custkey"], ["0.5", "0.3", "0.2"]).withColumn("p", F.round("p", 9))


@query("""SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS n FROM customer
WHERE c_mktsegment = 'BUILDING' AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 3""")
def flagship(spark, sf):
    """Customers of a segment with three orders or more."""
    body = [("pred", "customer", ["$c", "$name", "$k", "$b", "BUILDING"]), ("eq", "$n", ("count", None, ORDERS_OF)), ("ge", "$n", 3)]
    return evaluate(facts(spark, sf), body, ["$c", "$n"])


from . import ledger_queries  # noqa: E402,F401  (registers its own)

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
