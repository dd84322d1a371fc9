"""Registered queries over ledgers made from the driver's tables: views, reads, premises, writes, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalar
from .functions.encoding import REF_PREFIX, entity_ref_column
from .operators import evidence, paths, views, writes
from .operators.views import Ledger
from .plans import dsl, engines, rules
from .plans.compile import FactSpace, evaluate
from .registry import evts, query, table
from .schema import Entity, PredicateSpec, Schema
from .sources import audit
from .sources.shared import fresh_path

KIND = PredicateSpec("person:kind", ("entity_ref", "string"))
KINDS = Schema(extra=(KIND,))
PERSON = REF_PREFIX + "person:"


def person(user) -> Column:
    return F.concat(F.lit(PERSON), user)


def short(ref: str = "e_ref") -> Column:
    """``u`` and the user of a reference."""
    return F.concat(F.lit("u"), F.substring(F.col(ref), len(PERSON) + 1, 20))


#: The ledger of :func:`events_ledger` in SQL.  c: claims with their effective class ``p``; r: revocations with their revoker's.
LEDGER = """WITH c AS (SELECT 'a' || event_id AS asrt_id, event_id, event_id AS seq, 'u' || user_id AS e_ref, event_type AS v,
CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'draft' WHEN event_id % 5 = 1 THEN 'checked' WHEN (event_id // 100) % 2 = 0 THEN 'checked' END AS p FROM events),
r AS (SELECT 'a' || (event_id - 1) AS asrt_id, event_id % 21 = 0 AS draft FROM events WHERE event_id % 7 = 0 AND event_id > 0)
"""
LIVE = "asrt_id NOT IN (SELECT asrt_id FROM r)"


def events_ledger(spark, sf) -> Ledger:
    """Each event claims its user's kind; every seventh revokes the one before.

    Claims have a class by events of metadata: one in ten is set and unset again, and of those
    without any event every second transaction has a default.  Every third revoker is a draft.
    """
    e = evts(spark, sf)
    i = F.col("event_id")
    name, tx, at = F.concat(F.lit("a"), i), F.floor(i / 100), (i % 100).cast("int")
    claims = e.select(name.alias("asrt_id"), i.alias("seq"), tx.alias("tx_seq"), at.alias("op_ordinal"), F.lit(KIND.name).alias("pred_id"), person("user_id").alias("e_ref"), F.array(F.struct(F.lit("string").alias("tag"), F.col("event_type").alias("value"))).alias("args"))
    word = F.lit("provenance_class")

    def said(rows, who, value, tx_seq=tx):
        return rows.select(who.alias("asrt_id"), word.alias("key"), F.when(value.isNotNull(), "str").alias("kind"), value.alias("value"), tx_seq.alias("tx_seq"), at.alias("op_ordinal"))

    revoker = F.concat(F.lit("r"), i)
    meta = [
        said(e.where(i % 5 == 0), name, F.lit("draft")), said(e.where(i % 5 == 1), name, F.lit("checked")),
        said(e.where(i % 10 == 0), name, F.lit(None).cast("string"), tx + 1), said(e.where((i % 21 == 0) & (i > 0)), revoker, F.lit("draft")),
    ]
    defaults = e.select(tx.alias("tx_seq")).where("tx_seq % 2 = 0").distinct().select("tx_seq", word.alias("key"), F.lit("str").alias("kind"), F.lit("checked").alias("value"))
    revs = e.where((i % 7 == 0) & (i > 0)).select(revoker.alias("revoker_asrt_id"), F.concat(F.lit("a"), i - 1).alias("revoked_asrt_id"), tx.alias("tx_seq"))
    notes = e.where("event_type = 'error'").select(name.alias("asrt_id"), F.lit("shared").alias("namespace"), F.lit("semantic").alias("category"), F.when(i % 2 == 0, "probability").otherwise("bound").alias("key"), F.lit("float").alias("kind"), F.col("user_id").cast("string").alias("value"), F.lit("log").alias("origin"), F.lit(None).cast("string").alias("derivation"))
    return Ledger.of(spark, claims=claims, claim_meta=reduce(DataFrame.unionByName, meta), tx_defaults=defaults, revocations=revs, annotations=notes)


def kinds(ledger: Ledger) -> DataFrame:
    """(e_ref, kind) that rules see."""
    return evaluate(views.project(ledger, KINDS), [("pred", KIND.name, ["$e_ref", "$kind"])]).withColumn("e_ref", short())


# views


@query(LEDGER + f"SELECT e_ref, arg_max(v, seq) AS kind FROM c WHERE {LIVE} GROUP BY e_ref")
def project_chosen(spark, sf):
    return kinds(events_ledger(spark, sf))


@query(LEDGER + f"SELECT e_ref AS a0, arg_max(v, seq) AS a1, arg_max(asrt_id, seq) AS assertion FROM c WHERE {LIVE} GROUP BY e_ref")
def project_witness(spark, sf):
    return views.predicate_rows(events_ledger(spark, sf), KIND).select(short("a0").alias("a0"), "a1", F.col("_asrt").alias("assertion"))


@query(LEDGER + f"SELECT 'person:kind' AS pred_id, count(*) AS claims, count(*) FILTER (WHERE {LIVE}) AS active FROM c")
def project_audit(spark, sf):
    return views.projection_audit(events_ledger(spark, sf))


@query(LEDGER + f"SELECT e_ref AS a0, string_agg(asrt_id, ',' ORDER BY asrt_id) AS active, arg_max(asrt_id, seq) AS chosen FROM c WHERE {LIVE} GROUP BY e_ref HAVING count(*) > 1")
def conflicting_claims(spark, sf):
    return views.conflicts(events_ledger(spark, sf), KIND).withColumns({"active": F.array_join("active", ","), "a0": short("a0")})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 10 <> 0")
def entity_domain(spark, sf):
    """Customers that have a whole identity (not every seventh) under the reference that it hashes to (not every tenth)."""
    spec = Entity("Customer", (("key", "int"), ("name", "string")))
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    own = entity_ref_column("Customer", list(spec.identity), F.col("c_custkey"), F.col("c_name"))
    c = c.withColumn("e_ref", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("other:"), "c_custkey")).otherwise(own))

    def claims(rows, field, tag, value, n):
        arg = F.array(F.struct(F.lit(tag).alias("tag"), value.cast("string").alias("value")))
        return rows.select(F.concat(F.lit(field), "c_custkey").alias("asrt_id"), (F.col("c_custkey") * 2 + n).alias("seq"), F.lit(1).cast("long").alias("tx_seq"), F.lit(n).alias("op_ordinal"), F.lit(f"customer:{field}").alias("pred_id"), "e_ref", arg.alias("args"))

    ledger = Ledger.of(spark, claims=claims(c, "key", "int", F.col("c_custkey"), 0).unionByName(claims(c.where("c_custkey % 7 <> 0"), "name", "string", F.col("c_name"), 1)))
    found = views.entity_domain(ledger, Schema((spec,)), "Customer")
    return found.join(c, F.col("a0") == F.col("e_ref")).select("c_custkey", "c_name")


def _customers(spark, sf) -> tuple[FactSpace, Schema]:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    spec = Entity("Customer", (("key", "int"),), (("segment", "string"), ("order", "int", "multi")))
    ref = entity_ref_column("Customer", [("key", "int")], F.col("key"))
    who = c.select(F.col("c_custkey").alias("key"), "c_mktsegment").withColumn("a0", ref)
    orders = o.select(F.col("o_custkey").alias("key"), "o_orderkey").withColumn("a0", ref)
    space = FactSpace(spark, {"Customer:exists": who.select("a0"), "customer:key": who.select("a0", F.col("key").alias("a1")), "customer:segment": who.where("key % 4 <> 0").select("a0", F.col("c_mktsegment").alias("a1")), "customer:order": orders.select("a0", F.col("o_orderkey").alias("a1"))})
    return space, Schema((spec,))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment, count(DISTINCT o_orderkey) AS n, coalesce(min(o_orderkey::VARCHAR), '') AS first
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def entities_hydrated(spark, sf):
    """Every customer with all fields; a missing single one is null, a missing multi one empty."""
    got = views.entities(*_customers(spark, sf), "Customer")
    return got.select("key", "segment", F.size("order").cast("long").alias("n"), F.coalesce(F.get("order", F.lit(0)), F.lit("")).alias("first"))


# reads


@query(LEDGER + f"SELECT asrt_id, e_ref FROM c WHERE {LIVE} AND v = 'click' AND p = 'checked'")
def find_claims(spark, sf):
    return views.assertions(events_ledger(spark, sf), predicate=KIND.name, value="click", tag="string", meta={"provenance_class": "checked"}).select("asrt_id", short().alias("e_ref"))


@query("SELECT 'a' || event_id AS asrt_id, user_id::VARCHAR AS value FROM events WHERE event_type = 'error' AND event_id % 2 = 0")
def find_annotations(spark, sf):
    return views.annotations_of(events_ledger(spark, sf), namespace="shared", key="probability").select("asrt_id", "value")


@query("""SELECT 'a' || event_id AS asrt_id, 'draft' AS value, event_id // 100 AS tx_seq FROM events WHERE event_id % 5 = 0 UNION ALL SELECT 'a' || event_id, 'checked', event_id // 100 FROM events WHERE event_id % 5 = 1
UNION ALL SELECT 'a' || event_id, NULL, event_id // 100 + 1 FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'r' || event_id, 'draft', event_id // 100 FROM events WHERE event_id % 21 = 0 AND event_id > 0""")
def meta_events(spark, sf):
    return views.meta_history(events_ledger(spark, sf), key="provenance_class").select("asrt_id", "value", "tx_seq")


@query(LEDGER + f"SELECT e_ref, arg_max(v, seq) AS kind FROM c WHERE {LIVE} AND event_id % 3 = 0 GROUP BY e_ref")
def named_view(spark, sf):
    ledger = events_ledger(spark, sf)
    named = views.NamedViews(ledger)
    named.create("thirds", ledger.claims.where("seq % 3 = 0"))
    return kinds(named.get("thirds"))


# premises


SEEN = "SELECT e_ref, arg_max(v, seq) AS kind FROM c WHERE {seen} AND asrt_id NOT IN (SELECT asrt_id FROM r WHERE {revoker}) GROUP BY e_ref"


@query(LEDGER + SEEN.format(seen="p IS DISTINCT FROM 'draft'", revoker="NOT draft"))
def premise_exclusion(spark, sf):
    """A draft that revokes does not revoke."""
    return kinds(views.premise_scope(events_ledger(spark, sf), [views.MetaExclusion("provenance_class", ("draft",))]))


@query(LEDGER + SEEN.format(seen="p = 'checked'", revoker="true"))
def premise_allow(spark, sf):
    return kinds(views.premise_scope(events_ledger(spark, sf), [views.PremiseAllowance(KIND.name, "provenance_class", ("checked",))]))


@query(LEDGER + SEEN.format(seen="p IS DISTINCT FROM 'checked' AND p IS DISTINCT FROM 'draft'", revoker="NOT draft"))
def premise_block(spark, sf):
    found = views.premise_scope(events_ledger(spark, sf), [views.PremiseBlock(KIND.name, "provenance_class", ("checked",)), views.MetaExclusion("provenance_class", ("draft",))])
    return kinds(found)


@query(LEDGER + f"SELECT e_ref, arg_max(v, seq) AS kind FROM c WHERE {LIVE} AND event_id NOT IN (3, 10, 998) GROUP BY e_ref")
def evidence_without(spark, sf):
    return kinds(views.evidence_scope(events_ledger(spark, sf), ["a3", "a10", "a998"]))


# writes


def _items(rows: DataFrame, value="event_type", **more) -> DataFrame:
    nothing = [F.lit(None).cast("string").alias(k) for k in writes.META_KEYS]
    arg = F.array(F.struct(F.lit("string").alias("tag"), F.col(value).alias("value")))
    return rows.select(F.lit(KIND.name).alias("pred_id"), person("user_id").alias("e_ref"), arg.alias("args"), *nothing, F.col("event_id").alias("ordinal"), *[c.alias(k) for k, c in more.items()])


@query("""WITH one AS (SELECT user_id, event_type, min(event_id) AS k FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
two AS (SELECT user_id, event_type, min(event_id) AS k FROM events e WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.user_id = e.user_id AND one.event_type = e.event_type) GROUP BY ALL)
SELECT 'u' || user_id AS e_ref, event_type AS kind, 1::BIGINT AS tx_seq, (row_number() OVER (ORDER BY k) - 1)::INTEGER AS op_ordinal, row_number() OVER (ORDER BY k) AS seq FROM one
UNION ALL SELECT 'u' || user_id, event_type, 2, (row_number() OVER (ORDER BY k) - 1)::INTEGER, 1000000000 + row_number() OVER (ORDER BY k) FROM two""")
def ingest_idempotent(spark, sf):
    """Every second event, then all, then all again: equal items are written once, in the order given."""
    e = evts(spark, sf)
    ledger = Ledger.of(spark)
    for tx, rows in ((1, e.where("event_id % 2 = 0")), (2, e), (3, e)):
        ledger = writes.append_claims(ledger, _items(rows), tx, (tx - 1) * 1_000_000_000)
    return ledger.claims.select(short().alias("e_ref"), F.col("args")[0]["value"].alias("kind"), "tx_seq", "op_ordinal", "seq")


@query("""SELECT e_ref, arg_max(event_type, k) AS kind FROM (SELECT 'u' || user_id AS e_ref, event_type, min(event_id) AS k FROM events GROUP BY ALL) GROUP BY e_ref""")
def ingest_last_wins(spark, sf):
    return kinds(writes.append_claims(Ledger.of(spark), _items(evts(spark, sf)), 1))


@query("SELECT 'u' || user_id AS e_ref, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def add_as_multiset(spark, sf):
    ledger = writes.append_claims(Ledger.of(spark), _items(evts(spark, sf), op=F.lit("add")), 1)
    return ledger.claims.groupBy(short().alias("e_ref"), F.col("args")[0]["value"].alias("kind")).agg(F.count_distinct("asrt_id").alias("n"))


@query(LEDGER + f"SELECT v AS kind, count(*) AS n FROM c WHERE {LIVE} AND NOT (v = 'click' AND event_id % 3 = 0) GROUP BY v")
def retract_claims(spark, sf):
    ledger = events_ledger(spark, sf)
    out = writes.retract(ledger, ledger.claims.where("args[0].value = 'click' AND seq % 3 = 0"), "cleaner", 10**6)
    return views.active(out.claims, out.revocations).groupBy(F.col("args")[0]["value"].alias("kind")).agg(F.count("*").alias("n"))


@query(LEDGER + f"""SELECT e_ref, CASE WHEN bool_or(v = 'error') THEN 'fault' ELSE arg_max(v, seq) END AS kind FROM c WHERE {LIVE} GROUP BY e_ref""")
def replace_claims(spark, sf):
    ledger = events_ledger(spark, sf)
    old = views.active(ledger.claims, ledger.revocations).where("args[0].value = 'error'")
    anew = old.select(F.substring("e_ref", len(PERSON) + 1, 20).alias("user_id")).distinct().select("user_id", F.lit("fault").alias("v"), F.xxhash64("user_id").alias("event_id"))
    return kinds(writes.replace_claims(ledger, old, _items(anew, "v"), "editor", 10**6, 10**9))


@query(LEDGER + "SELECT coalesce(p, 'none') || CASE WHEN v = 'view' THEN '+seen' ELSE '' END AS said, count(*) AS n FROM c GROUP BY ALL")
def append_metadata(spark, sf):
    ledger = events_ledger(spark, sf)
    seen = ledger.claims.where("args[0].value = 'view'").select("asrt_id", F.lit("seen").alias("key"), F.lit("str").alias("kind"), F.lit("+seen").alias("value"), (F.col("tx_seq") + 5).alias("tx_seq"), F.lit(0).alias("op_ordinal"))
    meta = views.effective_meta(writes.append_meta(ledger, seen)).groupBy("asrt_id").pivot("key", ["provenance_class", "seen"]).agg(F.first("value"))
    said = F.concat(F.coalesce("provenance_class", F.lit("none")), F.coalesce("seen", F.lit("")))
    return ledger.claims.join(meta, "asrt_id", "left").groupBy(said.alias("said")).agg(F.count("*").alias("n"))


@query(LEDGER + f""", gone AS (SELECT asrt_id FROM c WHERE event_id % 11 = 0), kept AS (SELECT v FROM c WHERE {LIVE} AND asrt_id NOT IN (SELECT asrt_id FROM gone)
UNION ALL SELECT v FROM (SELECT DISTINCT e_ref, v FROM c WHERE v IN ('click', 'view')))
SELECT 'claims of ' || v AS what, count(*) AS n FROM kept GROUP BY v UNION ALL SELECT 'not one of the enum', count(*) FROM c WHERE v NOT IN ('click', 'view') UNION ALL SELECT 'unknown assertion', 1""")
def ingest_collect(spark, sf):
    """Values and retractions in one batch; what does not fit is told, the rest goes in."""
    e = evts(spark, sf)
    schema = Schema(extra=(PredicateSpec(KIND.name, KIND.args, enum=("click", "view")),))
    sets = _items(e, op=F.lit("set"), asrt_id=F.lit(None).cast("string"))
    away = e.where("event_id % 11 = 0").withColumn("event_id", F.col("event_id") + 10**9)
    away = _items(away, op=F.lit("retract"), asrt_id=F.concat(F.lit("a"), F.col("event_id") - 10**9))
    lost = away.limit(1).withColumns({"asrt_id": F.lit("nothing"), "ordinal": F.lit(-1).cast("long")})
    ledger, errors = writes.ingest(events_ledger(spark, sf), reduce(DataFrame.unionByName, [sets, away, lost]), schema, 10**6, "collect", 10**9)
    live = views.active(ledger.claims, ledger.revocations).groupBy(F.concat(F.lit("claims of "), F.col("args")[0]["value"]).alias("what")).agg(F.count("*").alias("n"))
    return live.unionByName(errors.groupBy(F.col("error").alias("what")).agg(F.count("*").alias("n")))


@query("""SELECT DISTINCT user_id::VARCHAR || '/' || event_type AS candidate_key,
CASE WHEN event_type = 'click' THEN 'duplicate' ELSE 'new' END AS status, event_type <> 'click' AS written FROM events""")
def accept_dedup(spark, sf):
    rows = evts(spark, sf).select("event_type", F.concat_ws("/", "user_id", "event_type").alias("candidate_key"))
    fresh, report = writes.accept(rows, rows.where("event_type = 'click'"))
    fresh = fresh.select(F.col("candidate_key").alias("k"), F.lit(True).alias("w"))
    return report.join(fresh, F.col("candidate_key") == F.col("k"), "left").select("candidate_key", "status", F.coalesce("w", F.lit(False)).alias("written"))


@query("""WITH k AS (SELECT event_id AS k, list_filter([event_id // 10, event_id // 100, event_id // 1000, event_id // 10000, event_id // 100000], lambda x: x > 0) AS up FROM events WHERE event_id > 0)
SELECT k::VARCHAR AS candidate_key, CASE WHEN k % 13 = 0 THEN 'FAILED_VALIDATION' WHEN len(list_filter(up, lambda x: x % 13 = 0)) > 0 THEN 'BLOCKED_DEPENDENCY' ELSE 'ACCEPTED' END AS status,
CASE WHEN k % 13 <> 0 AND len(list_filter(up, lambda x: x % 13 = 0)) = 0 THEN len(up)::INTEGER END AS level FROM k""")
def accept_in_dependency_order(spark, sf):
    """A candidate needs the one a tenth of its number."""
    i = F.col("event_id")
    e = evts(spark, sf).where(i > 0)
    key = i.cast("string")
    c = e.select(key.alias("candidate_key"), F.when(i >= 10, F.array(F.floor(i / 10).cast("string"))).otherwise(F.array().cast("array<string>")).alias("needs"), F.when(i % 13 == 0, "bad").alias("error"))
    items = _items(e, candidate_key=key)
    ledger, report = writes.accept_many(Ledger.of(spark), c, items, 1, "best_effort")
    return report.select("candidate_key", "status", "level")


# evidence, audits, rules


@query("SELECT user_id, event_type, max(round(value / 1000, 6)) AS p FROM events GROUP BY ALL")
def max_probability(spark, sf):
    return evidence.max_probability(evts(spark, sf).withColumn("p", F.round(F.col("value") / 1000, 6)), ["user_id", "event_type"])


@query("""SELECT event_type AS target, count(*) AS candidates, count(*) FILTER (WHERE event_id % 3 = 0) AS with_evidence, count(*) FILTER (WHERE event_id % 4 = 0) AS decided FROM events GROUP BY event_type""")
def audit_coverage(spark, sf):
    """Candidates, evidence and decisions written as an audit package and read back."""
    e = evts(spark, sf)
    i, name = F.col("event_id"), F.col("event_id").cast("string")
    run = F.concat(F.lit("run"), F.col("user_id"))
    path = fresh_path(spark, "audit")
    audit.export(spark, path, {
        "candidates": e.select(run.alias("run_id"), name.alias("candidate_id"), name.alias("candidate_key"), F.col("event_type").alias("target"), F.lit(0.5).alias("confidence")),
        "evidence": e.where(i % 3 == 0).select(name.alias("candidate_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("condition"), F.lit("p").alias("predicate"), name.alias("asrt_id")),
        "decisions": e.where(i % 4 == 0).select(name.alias("candidate_id"), F.lit("accept").alias("decision"), F.lit(None).cast("string").alias("reason"), i.alias("decided_at")),
    }, "none")
    package = audit.Package(spark, path)
    open_ = package.undecided().groupBy("target").agg(F.count("*").alias("open"))
    return package.coverage().join(open_, "target", "left").select("target", "candidates", "with_evidence", (F.col("candidates") - F.coalesce("open", F.lit(0))).alias("decided"))


@query("""SELECT n_nationkey AS source, (n_nationkey + 2)::INTEGER AS target FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey + 1 > 20 OR n_nationkey % 7 = 3""")
def broken_paths(spark, sf):
    """Paths over one to three nations: some use an edge that is not there, some end elsewhere, some are empty."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    edges = n.where("n <= 20").select(F.col("n").alias("source"), (F.col("n") + 1).alias("target")).unionByName(n.where("n % 7 <> 3").select(F.col("n").alias("source"), (F.col("n") + 50).alias("target")))
    k = F.col("n")
    way = F.when(k % 4 == 0, F.array().cast("array<int>")).when(k % 7 == 3, F.array(k, k + 1)).otherwise(F.array(k, k + 1, k + 2))
    known = edges.unionByName(n.where("n <= 20").select((F.col("n") + 1).alias("source"), (F.col("n") + 2).alias("target")))
    return paths.invalid_paths(n.select(k.alias("source"), (k + 2).alias("target"), way.alias("path")), known)


@query("""WITH e AS (SELECT n_nationkey AS s, CASE WHEN n_nationkey % 3 = 0 THEN 'monitors' ELSE 'depends_on' END AS r, (n_nationkey * 2 + 1) % 25 AS o FROM nation
UNION ALL SELECT n_nationkey, 'is_component_of', (n_nationkey + 5) % 25 FROM nation)
SELECT DISTINCT a.s AS subject, a.r AS relation, b.o AS object, a.o AS via FROM e a JOIN e b ON a.o = b.s WHERE a.s <> b.o AND (a.r = 'depends_on' AND b.r = 'depends_on' OR a.r = 'monitors' AND b.r = 'is_component_of')""")
def two_hop_relations(spark, sf):
    n = F.col("n_nationkey")
    t = table(spark, sf, "nation")
    a = t.select(n.alias("subject"), F.when(n % 3 == 0, "monitors").otherwise("depends_on").alias("relation"), ((n * 2 + 1) % 25).cast("int").alias("object"))
    b = t.select(n.alias("subject"), F.lit("is_component_of").alias("relation"), ((n + 5) % 25).cast("int").alias("object"))
    return evidence.two_hop(a.unionByName(b))


@query("""SELECT c_custkey AS c, min(o_totalprice) AS low, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def agg_without_a_value(spark, sf):
    """A smallest order needs an order; a sum does not, but customers without any have no row for the first."""
    space = FactSpace.from_tables(spark, {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")}, {"customer": "c_custkey"})
    of = [("pred", "orders", ["$o", "$c", "$p"])]
    got = evaluate(space, [("pred", "customer:c_name", ["$c", "$n"]), ("eq", "$low", ("min", "$p", of)), ("eq", "$total", ("sum", "$p", of))], ["$c", "$low", "$total"])
    return got


@query("SELECT o_orderkey AS o FROM orders WHERE o_orderkey % 97 > 40")
def integers_in_texts(spark, sf):
    """Texts that are decimal integers are ordered as numbers."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).cast("string").alias("t"))
    return evaluate(FactSpace(spark, {"said": o}), [("pred", "said", ["$o", "$t"]), ("gt", "$t", 40)], ["$o"])


@query("SELECT o_orderkey, 'order ' || o_orderkey || ' is ' || o_orderstatus || ' for %nobody' AS text, o_orderkey % 3 <> 1 AS is_time FROM orders")
def templates_and_times(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k, "o_orderstatus")
    said = F.when(k % 3 == 0, "2020-02-29T10:00:00Z").when(k % 3 == 1, "2021-02-29").otherwise("2021-02-28")
    return o.select(k, scalar.template("order %o_orderkey is %o_orderstatus for %nobody", ["o_orderkey", "o_orderstatus"]).alias("text"), scalar.is_iso8601(said).alias("is_time"))


@query("SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rule_as_text(spark, sf):
    space = FactSpace.from_tables(spark, {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}, {"customer": "c_custkey", "orders": "o_orderkey"})
    return evaluate(space, dsl.parse_body('customer:c_mktsegment(c, "BUILDING"), customer:c_acctbal(c, b), b > 100, not { orders:o_custkey(o, c) }'), ["$c", "$b"])


@query("SELECT DISTINCT o_custkey AS c FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3")
def match_entities(spark, sf):
    space = FactSpace.from_tables(spark, {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}, {"customer": "c_custkey", "orders": "o_orderkey"})
    return rules.match(space, "$c", [("pred", "orders:o_custkey", ["$o", "$c"]), ("pred", "customer:c_nationkey", ["$c", "$n"])], {"$n": 3})


@query("SELECT s_suppkey AS s, p_partkey AS p FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal / 10 + 900 AND s_acctbal / 10 + 925")
def range_join_by_cells(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"), (F.col("s_acctbal") / 10 + 900).alias("low"), (F.col("s_acctbal") / 10 + 925).alias("high"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("p"), "p_retailprice")
    return paths.range_join(p, s, "p_retailprice", "low", "high", 25).select("s", "p")


@query("""WITH u AS (SELECT n_regionkey AS r, 0.1 * (n_nationkey % 5 + 1) AS p FROM nation WHERE n_nationkey < 10),
o AS (SELECT r_regionkey AS r, coalesce((SELECT product(1 - p) FROM u WHERE u.r = r_regionkey), 1) AS none FROM region)
SELECT r::INTEGER AS r, round(none, 9)::DOUBLE AS p FROM o WHERE none > 0""")
def prob_of_absence(spark, sf):
    """Regions none of whose first ten nations is open, where each is open by chance: negation, by worlds."""
    n = table(spark, sf, "nation").where("n_nationkey < 10").select("n_nationkey", "n_regionkey", F.concat(F.lit("o"), "n_nationkey").alias("_asrt"), ((F.col("n_nationkey") % 5 + 1) / 10).alias("_p"))
    space = FactSpace(spark, {"open": n, "region": table(spark, sf, "region").select("r_regionkey")})
    body = [("pred", "region", ["$r"]), ("not", [("pred", "open", ["$n", "$r"])])]
    return engines.Engines().run(space, body, ["$r"], engines.Profile("worlds")).withColumn("p", F.round("p", 9))


@query("""SELECT event_id::VARCHAR AS candidate_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS evidence, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'accept' ELSE 'reject' END END AS decision, event_id % 8 = 0 AS written FROM events""")
def audit_status(spark, sf):
    e = evts(spark, sf)
    i, name = F.col("event_id"), F.col("event_id").cast("string")
    run = F.concat(F.lit("run"), F.col("user_id"))
    path = fresh_path(spark, "audit")
    first = e.where(i % 4 == 0).select(name.alias("candidate_id"), F.lit("reject").alias("decision"), F.lit("later").alias("reason"), i.alias("decided_at"))
    audit.export(spark, path, {
        "candidates": e.select(run.alias("run_id"), name.alias("candidate_id"), name.alias("candidate_key"), F.col("event_type").alias("target"), F.lit(0.5).alias("confidence")),
        "evidence": e.where(i % 3 == 0).select(name.alias("candidate_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("condition"), F.lit("p").alias("predicate"), name.alias("asrt_id")),
        "decisions": first.unionByName(first.where("decided_at % 8 = 0").withColumns({"decision": F.lit("accept"), "decided_at": F.col("decided_at") + 1})),
        "writes": e.where(i % 8 == 0).select(run.alias("run_id"), name.alias("candidate_id"), name.alias("asrt_id"), i.alias("written_at")),
    }, "none")
    return audit.Package(spark, path).status()
