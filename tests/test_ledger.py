"""The ledger: views, metadata, premises, writes, stores, files, and what is uncertain."""

import random
import threading
from datetime import timedelta
from itertools import combinations, pairwise
from math import prod

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from claimloom import FactSpace, RuleError, evaluate
from claimloom.functions import encoding, scalar
from claimloom.operators import evidence, paths, uncertain, views, writes
from claimloom.operators.views import CLAIM_META, CLAIMS, REVOCATIONS, TX_DEFAULTS, Ledger
from claimloom.schema import Entity, PredicateSpec, Relationship, Schema
from claimloom.sources import audit, provider, shared, store, tsv
from claimloom.streaming import latest

USER = Entity("DomainUser", (("user_id", "string"), ("tenant_id", "int")), (("name", "string"), ("tag", "string", "multi")))
SCHEMA = Schema((USER,), (Relationship("Friends", (("strength", "int"),)),))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ref(u, t):
    return encoding.entity_ref("DomainUser", [("user_id", "string", u), ("tenant_id", "int", t)])


A, B = ref("a", 1), ref("b", 2)


def claim(k, pred, e, *args, tx=1):
    return (f"c{k}", k, tx, k, pred, e, [{"tag": t, "value": v} for t, v in args])


CLAIM_ROWS = [
    claim(1, "domain_user:user_id", A, ("string", "a")),
    claim(2, "domain_user:tenant_id", A, ("int", "1")),
    claim(3, "domain_user:user_id", B, ("string", "b")),  # no tenant: B is incomplete
    claim(4, "domain_user:name", A, ("string", "old")),
    claim(5, "domain_user:name", A, ("string", "new")),
    claim(6, "domain_user:name", A, ("string", "revoked"), tx=2),
    claim(7, "domain_user:tag", A, ("string", "x")),
    claim(8, "domain_user:tag", A, ("string", "y")),
    claim(9, "DomainUser:exists", B),  # stored existence counts for nothing
    claim(10, "friends:strength", A, ("entity_ref", B), ("int", "3")),
    claim(11, "friends:strength", A, ("entity_ref", B), ("int", "5"), tx=2),
]


@pytest.fixture(scope="module")
def ledger(spark):
    meta = [
        ("c4", "source", "str", "s1", 1, 1), ("c4", "source", "str", "s2", 2, 1), ("c5", "source", "str", "s1", 1, 2), ("c5", "source", None, None, 3, 1),
        ("c5", "valid_from", "str", "2020-01-01", 1, 3), ("c6", "source", "str", "s9", 1, 4), ("r1", "source", "str", "s9", 1, 5),
    ]
    return Ledger.of(
        spark,
        claims=spark.createDataFrame(CLAIM_ROWS, CLAIMS),
        claim_meta=spark.createDataFrame(meta, CLAIM_META),
        tx_defaults=spark.createDataFrame([(1, "source", "str", "base"), (1, "channel", "str", "web")], TX_DEFAULTS),
        revocations=spark.createDataFrame([("r1", "c6", 2)], REVOCATIONS),
    )


def test_active_and_chosen(ledger):
    facts = views.project(ledger, SCHEMA)
    assert rows(facts["domain_user:name"]) == [(A, "new", "c5")]
    assert rows(facts["domain_user:tag"]) == [(A, "x", "c7"), (A, "y", "c8")]
    assert rows(facts["friends:strength"]) == [(A, B, 5, "c11")]
    assert [r["a0"] for r in facts["DomainUser:exists"].collect()] == [A]
    assert rows(evaluate(facts, [("pred", "DomainUser:exists", ["$u"]), ("pred", "domain_user:tag", ["$u", "$t"])], ["$t"])) == [("x",), ("y",)]
    assert rows(views.project(ledger.as_of(1), SCHEMA, ["friends:strength"])["friends:strength"]) == [(A, B, 3, "c10")]
    assert rows(views.conflicts(ledger, SCHEMA["domain_user:name"])) == [(A, ["c4", "c5"], "c5")]
    assert {r["pred_id"]: (r["claims"], r["active"]) for r in views.projection_audit(ledger).collect()}["domain_user:name"] == (3, 2)


def test_wrong_number_of_arguments_raises(spark):
    bad = Ledger.of(spark, claims=spark.createDataFrame([claim(1, "domain_user:name", A)], CLAIMS))
    with pytest.raises(PySparkException, match="wrong number"):
        views.project(bad, SCHEMA)["domain_user:name"].collect()


def test_effective_metadata(ledger):
    got = {(r["asrt_id"], r["key"]): r["value"] for r in views.effective_meta(ledger).where("key = 'source'").collect()}
    assert got[("c4", "source")] == "s2" and got[("c1", "source")] == "base"
    assert ("c5", "source") not in got  # unset, and the default does not come back
    early = {(r["asrt_id"], r["key"]): r["value"] for r in views.effective_meta(ledger, (1, 2)).collect()}
    assert early[("c4", "source")] == "s1" and early[("c5", "source")] == "s1" and ("c3", "source") not in early
    assert [r["tx_seq"] for r in views.meta_history(ledger, "c4").collect()] == [1, 2]


def test_premises_hide_revokers_too(spark, ledger):
    scoped = views.premise_scope(ledger, [views.MetaExclusion("source", ("s9",))])
    assert "c6" not in {r["asrt_id"] for r in scoped.claims.collect()}
    assert scoped.revocations.count() == 0
    only = views.premise_scope(ledger, [views.PremiseAllowance("domain_user:name", "source", ("s2",))])
    assert {r["asrt_id"] for r in only.claims.where("pred_id = 'domain_user:name'").collect()} == {"c4"}
    loose = views.premise_scope(ledger, [views.PremiseAllowance("domain_user:name", "source", ("s2",), absent_ok=True)])
    assert {r["asrt_id"] for r in loose.claims.where("pred_id = 'domain_user:name'").collect()} == {"c4", "c5"}
    block = views.premise_scope(ledger, [views.PremiseBlock("domain_user:name", "source", ("s2",))])
    assert {r["asrt_id"] for r in block.claims.where("pred_id = 'domain_user:name'").collect()} == {"c5", "c6"}
    assert views.evidence_scope(ledger, ["c4"]).claims.count() == len(CLAIM_ROWS) - 1
    with pytest.raises(RuleError):
        views.evidence_scope(ledger, ["nope"])


def test_valid_time(spark):
    df = spark.createDataFrame([("a", "2020", "2021"), ("b", "2020", None), ("c", None, None), ("d", "2021", None)], "k string, valid_from string, valid_to string")
    assert rows(views.valid_at(df, "2020").select("k")) == [("a",), ("b",)]
    assert rows(views.valid_at(df, "2021").select("k")) == [("b",), ("d",)]


def test_reads(spark, ledger):
    got = views.assertions(ledger, predicate="domain_user:name", e_ref=A)
    assert [r["asrt_id"] for r in got.collect()] == ["c4", "c5"]
    assert views.assertions(ledger, predicate="domain_user:name", only_active=False).count() == 3
    assert views.assertions(ledger, meta={"source": "s2"}).first()["asrt_id"] == "c4"
    assert views.one(views.assertions(ledger, value="x"))["asrt_id"] == "c7"
    with pytest.raises(RuleError):
        views.one(views.assertions(ledger, predicate="domain_user:tag"))
    assert views.by_ids(ledger, ["c1", "zz"]).count() == 1
    with pytest.raises(RuleError):
        views.by_ids(ledger, ["zz"], strict=True)
    facts = views.project(ledger, SCHEMA)
    assert rows(views.find(facts, SCHEMA, "DomainUser", tag="x").select("user_id", "tenant_id", "name", "tag")) == [("a", 1, "new", ["x", "y"])]
    assert views.find(facts, SCHEMA, "DomainUser", tag="q").count() == 0
    assert ledger.restricted(spark.createDataFrame([("c4",)], "asrt_id string")).claims.count() == 1


def test_schema_rules():
    assert SCHEMA["friends:strength"].group == (0, 1)
    bigger = SCHEMA.extended([Entity("DomainUser", USER.identity, (*USER.fields, ("age", "int")))])
    assert bigger["domain_user:age"] and bigger.digest() != SCHEMA.digest()
    for bad in (lambda: SCHEMA.extended([Entity("DomainUser", (("user_id", "string"),), USER.fields)]), lambda: SCHEMA.extended([Entity("DomainUser", USER.identity, ())]), lambda: SCHEMA.extended(relationships=[Relationship("Friends", (("strength", "int"), ("x", "int")))]), lambda: PredicateSpec("p", ("float64",), enum=(1.0,)), lambda: PredicateSpec("p", ("what",)), lambda: Schema((USER, USER))):
        with pytest.raises(RuleError):
            bad()


def item(pred, e, args, **meta):
    return (pred, e, args, *(meta.get(k) for k in writes.META_KEYS))


def test_writes_are_idempotent(spark):
    items = [item("domain_user:name", A, [{"tag": "string", "value": "n"}], source="s"), item("domain_user:name", A, [{"tag": "string", "value": "n"}], source="s"), item("domain_user:name", A, [{"tag": "string", "value": "n"}], source="t")]
    batch = spark.createDataFrame(items, writes.ITEMS)
    one = writes.append_claims(Ledger.of(spark), batch, 1)
    assert one.claims.count() == 2 and sorted(r["seq"] for r in one.claims.collect()) == [1, 2]
    assert writes.append_claims(one, batch, 2, 10).claims.count() == 2
    ids = one.claims.select("asrt_id")
    gone = writes.retract(one, ids, "r", 2)
    assert views.active(gone.claims, gone.revocations).count() == 0
    assert writes.retract(gone, ids, "r", 3).revocations.count() == 2
    assert writes.append_claims(gone, batch, 4, 10).claims.count() == 4  # revoked claims may be written again
    for bad in (lambda: writes.retract(gone, gone.revocations.select(F.col("revoker_asrt_id").alias("asrt_id")), "r", 5), lambda: writes.retract(one, spark.createDataFrame([("zz",)], "asrt_id string"), "r", 5), lambda: writes.retract(one, ids, "r", 5, ["domain_user:name"])):
        with pytest.raises(RuleError):
            bad()
    assert writes.delete_entity(one, A, "d", 6).revocations.count() == 2
    assert views.active(*(lambda x: (x.claims, x.revocations))(writes.replace_claims(one, ids, batch, "r", 7, 20))).count() == 2


def test_ingest_validates(spark):
    schema = Schema((USER,), extra=(PredicateSpec("color", ("entity_ref", "string"), enum=("red", "blue")), PredicateSpec("code", ("entity_ref", "string"), pattern="[A-Z]+")))
    def s(v):
        return [{"tag": "string", "value": v}]

    batch = spark.createDataFrame([item("color", A, s("red")), item("color", A, s("green")), item("code", A, s("ab")), item("nope", A, s("x")), item("color", A, [{"tag": "int", "value": "1"}]), item("color", A, [])], writes.ITEMS)
    batch = batch.coalesce(1)
    part, errors = writes.ingest(Ledger.of(spark), batch, schema, 1)
    assert part.claims.count() == 1 and [r["error"] for r in errors.collect()] == ["not one of the enum"]  # what came before it is in
    good, errors = writes.ingest(Ledger.of(spark), batch, schema, 1, "collect")
    assert good.claims.count() == 1 and sorted(r["error"] for r in errors.collect()) == ["not one of the enum", "pattern not met", "unknown predicate", "wrong number of arguments", "wrong type"]


def kinds(ledger, e_ref=A, pred="color"):
    return [r["v"] for r in views.active(ledger.claims, ledger.revocations).where((F.col("e_ref") == e_ref) & (F.col("pred_id") == pred)).orderBy("seq").select(F.col("args")[0]["value"].alias("v")).collect()]


COLORS = Schema((USER,), extra=(PredicateSpec("color", ("entity_ref", "string")),))


def test_later_items_win(spark):
    for n in range(3):
        values = [f"v{(k * 7 + n) % 40}" for k in range(40)]
        batch = writes.Batch(COLORS)
        for v in values:
            batch.set("color", A, v)
        batch.set("color", A, values[3])  # held already by an earlier item, so it is skipped
        ledger = batch.apply(Ledger.of(spark), 1, 100)
        got = ledger.claims.orderBy("seq").collect()
        assert [r["args"][0]["value"] for r in got] == values
        assert [r["op_ordinal"] for r in got] == list(range(40)) and [r["seq"] for r in got] == list(range(101, 141))
        assert views.predicate_rows(ledger, COLORS["color"]).first()["a1"] == values[-1]
        assert views.effective_meta(ledger, (1, 5)).where("key = 'ingest_key'").count() == 6


def test_numbers_follow_the_order_across_ranges(spark):
    df = spark.range(5000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).repartition(7)
    got = [(r["x"], r["_place"]) for r in writes.numbered(df, "x", 100).collect()]
    assert [p for _, p in sorted(got)] == list(range(5000))


def test_ingest_with_retractions(spark):
    kind = f"{writes.ITEMS}, ordinal long, op string, asrt_id string"

    def put(k, v, op="set", asrt=None):
        return (*item("color", A, [{"tag": "string", "value": v}]), k, op, asrt)

    one = writes.ingest(Ledger.of(spark), spark.createDataFrame([put(0, "red"), put(1, "blue"), put(2, "blue", "add"), put(3, "red")], kind), COLORS, 1)[0]
    assert kinds(one) == ["red", "blue", "blue"]
    red = one.claims.where("args[0].value = 'red'").first()["asrt_id"]
    again, errors = writes.ingest(one, spark.createDataFrame([put(0, "red"), put(1, None, "retract", red), put(2, "red"), put(3, "green")], kind), COLORS, 2, first_seq=10)
    assert errors.count() == 0 and kinds(again) == ["blue", "blue", "red", "green"]  # skipped, retracted, written anew
    bad = [put(0, "x"), put(1, None, "retract", "nothing"), put(2, "y"), put(3, "z", "what")]
    part, errors = writes.ingest(again, spark.createDataFrame(bad, kind), COLORS, 3)
    assert [tuple(r) for r in errors.collect()] == [(1, "unknown assertion")] and "x" in kinds(part) and "y" not in kinds(part)
    most, errors = writes.ingest(again, spark.createDataFrame(bad, kind), COLORS, 3, "collect")
    assert rows(errors) == [(1, "unknown assertion"), (3, "unknown operation")] and {"x", "y"} <= set(kinds(most))


def test_plans_for_entities(spark):
    empty = Ledger.of(spark)
    who = {"user_id": "u", "tenant_id": 4}
    plan = writes.plan_entity(empty, SCHEMA, "DomainUser", who, {"name": "n", "tag": ["x", "y"]}, source="s")
    assert plan.is_new and plan.error is None and len(plan.items) == len(USER.identity) + 3
    one = plan.apply(empty, 1)
    assert views.has_entity(one, SCHEMA, "DomainUser", **who) and not views.has_entity(one, SCHEMA, "DomainUser", user_id="u", tenant_id=5)
    row = views.entity_of(one, SCHEMA, "DomainUser", **who).first()
    assert (row["e_ref"], row["name"], row["tag"]) == (plan.e_ref, "n", ["x", "y"])
    more = writes.plan_entity(one, SCHEMA, "DomainUser", who, {"name": "m"})
    assert not more.is_new and views.entity_of(more.apply(one, 2, 10), SCHEMA, "DomainUser", **who).first()["name"] == "m"
    for plan in (writes.plan_entity(empty, SCHEMA, "DomainUser", who, create=False), writes.plan_entity(empty, SCHEMA, "DomainUser", {}), writes.plan_entity(empty, SCHEMA, "DomainUser", who, {"what": 1}), writes.plan_entity(empty, SCHEMA, "Nobody", who)):
        assert plan.error
        with pytest.raises(RuleError):
            plan.apply(empty, 1)


def test_accepting_many(spark):
    c = spark.createDataFrame([("a", ["b"], None), ("b", [], None), ("c", ["d"], None), ("d", [], "bad value")], "candidate_key string, needs array<string>, error string")
    items = spark.createDataFrame([(*item("color", A, [{"tag": "string", "value": k}]), k) for k in "abcd"], f"{writes.ITEMS}, candidate_key string")
    some, report = writes.accept_many(Ledger.of(spark), c, items, 1, "best_effort")
    assert kinds(some) == ["b", "a"]
    assert {r["candidate_key"]: r["status"] for r in report.collect()} == {"a": "ACCEPTED", "b": "ACCEPTED", "c": "BLOCKED_DEPENDENCY", "d": "FAILED_VALIDATION"}
    none, report = writes.accept_many(Ledger.of(spark), c, items, 1)
    assert kinds(none) == [] and {r["error"] for r in report.collect()} == {"ATOMIC_ROLLBACK", "BLOCKED_DEPENDENCY", "bad value"}
    assert kinds(writes.accept_many(Ledger.of(spark), c.where("candidate_key < 'c'"), items, 1)[0]) == ["b", "a"]


def test_two_writers_meet(spark, tmp_path):
    """Writers that have all seen a free name try to take it at once; one gets it."""
    files = shared.Files(spark, str(tmp_path))
    told = threading.Barrier(6)
    got = []

    def write(k):
        told.wait()
        got.append((files.create(f"{tmp_path}/name", str(k)), str(k)))

    writers = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert [k for ok, k in got if ok] == [files.read(f"{tmp_path}/name")] and files.names(str(tmp_path)) == ["name"]


def test_commits_of_two_writers(spark, tmp_path, monkeypatch):
    ws = store.Workspace.create(spark, str(tmp_path / "ws"), "digest")
    other = store.Workspace(spark, str(tmp_path / "ws"))
    claims = spark.createDataFrame(CLAIM_ROWS[:2], CLAIMS)
    state = store.Workspace._state

    def enters(self, *a):  # the other writer commits after this one has read the head and written its rows
        monkeypatch.setattr(store.Workspace, "_state", state)
        other.commit({"claims": claims}, 0)
        return state(self, *a)

    monkeypatch.setattr(store.Workspace, "_state", enters)
    with pytest.raises(store.HeadMoved):
        ws.commit({"claims": claims}, 0)
    assert ws.head()["tx"] == 1 and ws.ledger().claims.count() == 2 and ws.verify()


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Cluster()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.work_dir(Session())


def test_accepting(spark):
    c = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "candidate_key string, v int")
    fresh, report = writes.accept(c, spark.createDataFrame([("b",)], "candidate_key string"))
    assert rows(fresh) == [("a", 1)] and rows(report) == [("a", "new"), ("b", "duplicate")]
    assert writes.accept(c, c, dry_run=True)[0].count() == 0
    deps = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b", "a"]), ("d", ["x"]), ("e", ["d"]), ("f", ["g"]), ("g", ["f"])], "candidate_key string, needs array<string>")
    got = {r["candidate_key"]: (r["level"], r["status"]) for r in writes.accept_in_order(deps).collect()}
    no = (None, "blocked_dependency")
    assert got == {"a": (0, "accepted"), "b": (1, "accepted"), "c": (2, "accepted"), "d": no, "e": no, "f": no, "g": no}


def test_accepting_a_long_chain(spark):
    deps = spark.createDataFrame([(f"k{n}", [f"k{n - 1}"] if n else []) for n in range(70)], "candidate_key string, needs array<string>")
    assert rows(writes.accept_in_order(deps)) == sorted((f"k{n}", n, "accepted") for n in range(70))
    with pytest.raises(RuleError, match="still become ready"):
        writes.accept_in_order(deps, max_rounds=2)


def test_workspace(spark, tmp_path):
    ws = store.Workspace.create(spark, str(tmp_path / "ws"), "digest")
    with pytest.raises(RuleError):
        store.Workspace.create(spark, str(tmp_path / "ws"), "digest")
    claims = spark.createDataFrame(CLAIM_ROWS[:5], CLAIMS)
    first = ws.commit({"claims": claims}, 0)
    with pytest.raises(store.HeadMoved):
        ws.commit({"claims": claims}, 0)
    digest = ws.create_view("named", claims.where("asrt_id <> 'c1'").select("asrt_id"))
    ws.commit({"claims": spark.createDataFrame(CLAIM_ROWS[5:], CLAIMS), "revocations": spark.createDataFrame([("r1", "c6", 2)], REVOCATIONS)}, 1)
    assert ws.ledger().claims.count() == len(CLAIM_ROWS) and ws.ledger(1).claims.count() == 5
    assert ws.view("named").claims.count() == 4 and digest.startswith("lthash16-v2:")
    assert ws.verify() and ws.head()["state"] != first["state"]
    added = [f"claims/c{k}".encode() for k in range(6, 12)] + [b"revocations/r1"]
    assert encoding.updated(first["state"], added) == ws.head()["state"]
    assert encoding.updated(ws.head()["state"], removed=added) == first["state"]


def test_set_digest_is_of_the_set(spark):
    elements = [f"e{k}".encode() for k in range(50)]
    df = spark.createDataFrame([(bytearray(e),) for e in elements + elements[:7]], "e binary").repartition(5)
    want = encoding.updated(encoding.state_token(np.zeros(encoding.LANES, np.uint16)), elements)
    assert encoding.set_digest(df, "e") == want == encoding.set_digest(df.repartition(2), "e")


def test_encodings():
    assert encoding.float_hex(-0.0) == "0x0000000000000000" and encoding.float_of_hex(encoding.float_hex(-1.5)) == -1.5
    assert encoding.value_bytes("int", -12) == b"-12" and len(encoding.value_bytes("time", 5)) == 8
    for tag, v in (("int", True), ("int", 2**63), ("float64", float("nan")), ("uuid", "X"), ("entity_ref", "x"), ("bool", 1), ("string", 5)):
        with pytest.raises(ValueError):
            encoding.value_bytes(tag, v)
    assert ref("a", 1) != ref("a", 2) and ref("a", 1).startswith("idref_v1:DomainUser:")
    terms = [("string", "x")]
    k = encoding.ingest_key("p", A, terms, {"source": "s"})
    assert k != encoding.ingest_key("p", A, terms, {"source": "t"}) and k != encoding.ingest_key("p", A, terms, {"source": "s", "version": "2"})


def test_tsv(spark, tmp_path):
    cells = ["plain", "tab\there", "line\nbreak", "back\\slash", "\\t", "\\\\n", "", "\r"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    tsv.write_tsv(df, str(tmp_path / "t"))
    assert rows(tsv.read_tsv(spark, str(tmp_path / "t"), [("k", "int"), ("c", "string")])) == rows(df)
    with pytest.raises(PySparkException, match="cells"):
        tsv.read_tsv(spark, str(tmp_path / "t"), [("k", "int")]).collect()


def test_audit_package(spark, tmp_path):
    at = str(tmp_path / "pkg")
    records = {
        "runs": spark.createDataFrame([("r", "rule", "1", 1, 2, 2, "ok")], audit.KINDS["runs"]),
        "candidates": spark.createDataFrame([("r", "c1", "k1", "t", 0.5), ("r", "c2", "k2", "t", None)], audit.KINDS["candidates"]),
        "evidence": spark.createDataFrame([("c1", 1, "p", "a2"), ("c1", 0, "p", "a1")], audit.KINDS["evidence"]),
        "decisions": spark.createDataFrame([("c1", "accepted", "", 5)], audit.KINDS["decisions"]),
        "writes": spark.createDataFrame([("r", "c1", "a9", 6)], audit.KINDS["writes"]),
    }
    audit.export(spark, at, records, "d")
    pkg = audit.Package(spark, at)
    assert rows(pkg.run_summary()) == [("r", "rule", "ok", 2, 1, 0)]
    assert rows(pkg.coverage()) == [("t", 2, 1)]
    assert [r["asrt_id"] for r in pkg.trace("c1").collect()] == ["a1", "a2"]
    assert [r["event"] for r in pkg.timeline("c1").collect()] == ["accepted", "written"]
    assert [r["candidate_id"] for r in pkg.undecided().collect()] == ["c2"]
    audit.export(spark, at + "2", {"candidates": records["candidates"].where("candidate_id = 'c1'")}, "d")
    assert rows(pkg.diff(audit.Package(spark, at + "2"), "candidates", "candidate_id")) == [("c2", "removed")]
    with pytest.raises(RuleError):
        audit.export(spark, at + "3", {"what": records["runs"]}, "d")
    with pytest.raises(RuleError):
        audit.Package(spark, str(tmp_path))


def test_provider_replaces(spark, ledger):
    facts = views.project(ledger, SCHEMA)
    new = spark.createDataFrame([(A, "given")], "e string, n string")
    got = provider.provide(facts, SCHEMA, ["domain_user:name"], lambda s: {"domain_user:name": new})
    assert rows(got["domain_user:name"]) == [(A, "given")]
    for bad in ({}, {"domain_user:name": spark.createDataFrame([(A, 1)], "e string, n long")}):
        with pytest.raises(RuleError):
            provider.provide(facts, SCHEMA, ["domain_user:name"], lambda s, bad=bad: bad)


# evidence, paths


def test_evidence(spark):
    df = spark.createDataFrame([("s", "r", "o", 0.5, "b", "2"), ("s", "r", "o", 0.5000001, "a", None), ("s", "r", "o", 0.4, "a", "1"), ("s", "r", "p", 0.1, "z", None)], "subject string, relation string, object string, confidence double, source_type string, claim_id string")
    assert rows(evidence.max_evidence(df)) == [("s", "r", "o", 0.5, "a", None), ("s", "r", "p", 0.1, "z", None)]
    hops = spark.createDataFrame([("a", "depends_on", "b"), ("b", "depends_on", "c"), ("m", "monitors", "a"), ("a", "is_component_of", "z"), ("c", "depends_on", "b")], "subject string, relation string, object string")
    assert rows(evidence.two_hop(hops)) == [("a", "depends_on", "c", "b"), ("m", "monitors", "z", "a")]
    cond = spark.createDataFrame([("k", "c1", 0.5, 0.8), ("k", "c2", 1.0, None), ("k", "c3", None, 0.1), ("j", "c1", None, None)], "k string, condition_key string, weight double, confidence double")
    assert rows(evidence.certainty(cond, ["k"])) == [("j", None), ("k", 0.4)]
    assert rows(evidence.certainty(cond, ["k"], "additive")) == [("j", None), ("k", round(round(0.5 / 1.5 * 0.8, 6) + round(1 / 1.5, 6), 6))]
    assert [(r["condition_key"], r["is_bottleneck"]) for r in evidence.ranked_conditions(cond.where("k = 'k'"), ["k"]).orderBy("place").collect()] == [("c1", True), ("c2", False), ("c3", False)]
    maps = spark.createDataFrame([("k", "v", "a2", 5, "s1"), ("k", "w", "a1", 5, "s2"), ("j", "v", "a3", 1, "s1"), ("j", "v", "a4", 2, "s1")], "k string, v string, asrt_id string, ingested_at long, source string")
    assert rows(evidence.resolve_mapping(maps, ["k"], ["v"], "prefer_source", ["s2"])) == [("j", "v", "a4", "single_value"), ("k", "w", "a1", "prefer_source")]
    assert rows(evidence.resolve_mapping(maps, ["k"], ["v"], "latest_by_ingested_at_then_min_assertion_id").where("k = 'k'").select("v", "asrt_id")) == [("w", "a1")]
    with pytest.raises(PySparkException, match="conflict"):
        evidence.resolve_mapping(maps, ["k"], ["v"]).collect()
    assert rows(evidence.mapping_conflicts(maps, ["k"], ["v"])) == [("k", 2, "a1")]
    with pytest.raises(RuleError):
        evidence.resolve_mapping(maps, ["k"], ["v"], "max_confidence")


def brute_widest(edges):
    """Every simple path; cycles never make a path better."""
    out = {}
    best = {}
    for s, t, c in edges:
        best[s, t] = max(best.get((s, t), 0), round(c, 6))

    def go(path, conf):
        for (a, b), c in best.items():
            if a == path[-1] and (b not in path or b == path[0]):
                new, low = [*path, b], min(conf, c)
                k = path[0], b
                out.setdefault(k, []).append((-low, len(new) - 1, new))
                if b != path[0]:
                    go(new, low)

    for s in {a for a, _ in best}:
        go([s], 2.0)
    return {k: (-min(v)[0], min(v)[1], min(v)[2], min(x[1] for x in v)) for k, v in out.items()}


def test_widest_paths_equal_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.choice("abcdef"), rng.choice("abcdef"), rng.choice([0.3, 0.5, 0.9, 1 / 3])) for _ in range(14)]
    df = spark.createDataFrame(edges, "source string, target string, confidence double")
    got = {(r["source"], r["target"]): (r["confidence"], r["depth"], r["path"], r["min_support_depth"]) for r in paths.widest_paths(df).collect()}
    assert got == brute_widest(edges)
    found = paths.widest_paths(df)
    assert paths.invalid_paths(found, df).count() == 0
    broken = spark.createDataFrame([("a", "b", ["a", "zz", "b"]), ("a", "b", []), ("q", "b", ["a", "b"])], "source string, target string, path array<string>")
    assert rows(paths.invalid_paths(broken, df)) == [("a", "b"), ("q", "b")]
    with pytest.raises(RuleError, match="rounds"):
        paths.widest_paths(spark.createDataFrame(list((a, b, 1.0) for a, b in pairwise("abcdefgh")), "source string, target string, confidence double"), max_rounds=2)


def test_relation_paths(spark):
    from claimloom import FactSpace

    facts = FactSpace(spark, {"user": spark.createDataFrame([("u1",), ("u2",)], "u string"), "team": spark.createDataFrame([("t1",)], "t string"), "member": spark.createDataFrame([("u1", "t1", "lead"), ("u2", "t2", "dev")], "u string, t string, role string")})
    step = paths.Step
    assert rows(paths.relation_path(facts, "user", [step("member")], ["team"])) == [("u1", "t1", "lead")]
    assert rows(paths.relation_path(facts, "user", [step("member")])) == [("u1", "t1", "lead"), ("u2", "t2", "dev")]
    assert rows(paths.relation_path(facts, "team", [step("member", False)], ["user"])) == [("t1", "u1", "lead")]
    assert paths.limited(paths.relation_path(facts, "user", [step("member")]), 2).count() == 2
    for bad in (lambda: paths.limited(facts["user"], 1), lambda: paths.limited(facts["user"], 0), lambda: paths.relation_path(facts, "user", []), lambda: paths.relation_path(facts, "user", [step("member")] * 33)):
        with pytest.raises(RuleError):
            bad()


# uncertainty and time


def inclusion_exclusion(proofs, p):
    """The same probability by inclusion and exclusion, for few proofs."""
    total = 0.0
    for n in range(1, len(proofs) + 1):
        for some in combinations(proofs, n):
            total += (-1) ** (n + 1) * prod(p[f] for f in frozenset().union(*some))
    return total


def test_exact_probability_of_shared_proofs():
    rng = random.Random(2)
    for _ in range(60):
        p = {k: rng.random() for k in "abcdefg"}
        proofs = [frozenset(rng.sample("abcdefg", rng.randrange(1, 4))) for _ in range(rng.randrange(1, 7))]
        assert uncertain.disjunction(proofs, p) == pytest.approx(inclusion_exclusion(proofs, p))
    p, group = {"x1": 0.2, "x2": 0.5, "y": 0.3}, {"x1": "x", "x2": "x"}
    assert uncertain.disjunction([frozenset(["x1"]), frozenset(["x2"])], p, group) == pytest.approx(0.7)
    assert uncertain.disjunction([frozenset(["x1", "x2"])], p, group) == pytest.approx(0.0)
    assert uncertain.disjunction([frozenset(["x1", "y"]), frozenset(["x2"])], p, group) == pytest.approx(0.5 + 0.2 * 0.3)
    big = [frozenset([f"a{k}", f"a{(k + j) % 60}"]) for k in range(60) for j in (1, 7, 23)]
    with pytest.raises(RuleError, match="share"):
        uncertain.disjunction(big, {f"a{k}": 0.5 for k in range(60)})


def test_answer_probability(spark):
    df = spark.createDataFrame([("q", "1", "a", 0.5), ("q", "1", "b", 0.5), ("q", "2", "a", 0.5), ("q", "2", "c", 0.5), ("r", "1", "a", 0.5), ("r", "2", "b", 0.5)], "k string, proof string, fact string, p double")
    assert {r["k"]: r["p"] for r in uncertain.answer_probability(df, ["k"]).collect()} == pytest.approx({"q": 0.5 * 0.75, "r": 0.75})
    arms = df.withColumn("choice", F.when(F.col("fact").isin("a", "b"), "g")).where("k = 'r'")
    assert uncertain.answer_probability(arms, ["k"], exclusive=True).first()["p"] == pytest.approx(1.0)
    with pytest.raises(RuleError, match="exactly 1"):
        uncertain.weighted_choice(df, ["k"], ["0.3", "0.3", "0.3"])


def test_probability_of_a_rule(spark):
    from claimloom import FactSpace
    from claimloom.plans import scenario

    edge = spark.createDataFrame([("a", "b", "e1", 0.5), ("b", "d", "e2", 0.5), ("a", "c", "e3", 0.5), ("c", "d", "e4", 1.0), ("a", "e", "e5", 1.0), ("e", "f", "e6", 1.0)], "x string, y string, _asrt string, _p double")
    facts = FactSpace(spark, {"edge": edge, "ok": spark.createDataFrame([("d",), ("f",)], "x string")})
    body = [("pred", "edge", ["$x", "$y"]), ("pred", "edge", ["$y", "$z"]), ("pred", "ok", ["$z"])]
    got = {(r["x"], r["z"]): r["p"] for r in uncertain.rule_probability(facts, body, ["$x", "$z"]).collect()}
    assert got == pytest.approx({("a", "d"): 1 - 0.75 * 0.5, ("a", "f"): 1.0})
    either = [[("pred", "edge", ["$x", "b"])], [("pred", "edge", ["$x", "$y"]), ("eq", "$y", "c")]]
    assert uncertain.rule_probability(facts, either, ["$x"]).first()["p"] == pytest.approx(0.75)
    more = scenario.apply_scenario(facts, [scenario.EnsureRelation("edge", "q", "d")], p=0.25)
    assert uncertain.rule_probability(more, [("pred", "edge", ["$x", "d"]), ("eq", "$x", "q")], ["$x"]).first()["p"] == 0.25
    with pytest.raises(RuleError, match="no probability"):
        uncertain.rule_probability(facts, [("pred", "ok", ["$x"]), ("not", [("pred", "edge", ["$x", "$y"])])], ["$x"])
    with pytest.raises(RuleError, match="at most 1"):
        scenario.apply_scenario(facts, [], p=2)


def test_branches_with_chances_of_their_own(spark):
    edge = spark.createDataFrame([("a", "b", "e1", 0.5), ("a", "c", "e2", 1.0), ("d", "b", "e3", 1.0)], "a0 string, a1 string, _asrt string, _p double")
    facts = FactSpace(spark, {"edge": edge, "sure": spark.createDataFrame([("a",)], "a0 string")})
    body = [[("pred", "edge", ["$x", "$y"])], [("pred", "sure", ["$x"])]]
    got = {r["x"]: r["p"] for r in uncertain.rule_probability(facts, body, ["$x"], case_probabilities=[0.4, 0.25]).collect()}
    # a chance per binding of the first branch, one of the second
    assert got == pytest.approx({"a": 1 - (1 - 0.5 * 0.4) * (1 - 0.4) * (1 - 0.25), "d": 0.4})
    assert {r["p"] for r in uncertain.rule_probability(facts, body[:1], ["$x"]).collect()} == {1.0}
    for bad in ([0.5], [0.5, 0.0], [0.5, 1.5], [True, 0.5]):
        with pytest.raises(RuleError):
            uncertain.rule_probability(facts, body, ["$x"], case_probabilities=bad)


def test_interval_rules_over_several_atoms(spark):
    def table(rows, n):
        return spark.createDataFrame(rows, ", ".join(f"a{k} string" for k in range(n)) + ", lo double, hi double, from int, to int")

    facts = {"friend": table([("j", "m", 1.0, 1.0, 0, None), ("z", "m", 0.6, 0.9, 0, None), ("j", "z", 0.0, 0.2, 0, None)], 2), "popular": table([("m", 1.0, 1.0, 0, 1)], 1), "cat": table([("z", 1.0, 1.0, 0, None)], 1)}
    rule = uncertain.IntervalClause("popular", ("$x",), [[("pred", "popular", ["$y"]), ("pred", "friend", ["$x", "$y"])], [("pred", "cat", ["$x"]), ("pred", "popular", ["j"])]], (1.0, 1.0), {1: (0.3, 0.8)}, {"friend": (0.7, 1.0)})
    got = uncertain.interval_program(facts, [rule], 3)["popular"]
    assert rows(got) == [("j", 1.0, 1.0, 1), ("z", 0.3, 0.8, 2)]
    wide = uncertain.IntervalClause("popular", ("$x",), rule.where, (0.5, 1.0), None, {"friend": (0.5, 1.0)}, 2)
    assert rows(uncertain.interval_program(facts, [wide], 3)["popular"]) == [("j", 0.5, 1.0, 2), ("z", 0.5, 1.0, 2)]
    assert rows(uncertain.interval_program(facts, [wide], 1)["popular"]) == []
    with pytest.raises(RuleError):
        uncertain.interval_program(facts, [uncertain.IntervalClause("x", ("$x",), [("pred", "cat", ["$x"]), ("ne", "$x", "a")])], 1)


def test_fact_probability(spark):
    facts = spark.createDataFrame([(x,) for x in "abcde"], "asrt_id string")
    notes = spark.createDataFrame([("a", "problog", "probability", "num", "0.2", 1), ("a", "shared", "probability", "num", "0.9", 2), ("b", "shared", "probability", "num", "0.4", 1), ("b", "shared", "probability", "num", "0.6", 2), ("c", "shared", "bound", "json", "[0.2,0.4]", 1), ("e", "problog", "probability", "bool", "true", 1)], "asrt_id string, namespace string, key string, kind string, value string, seq int").withColumn("category", F.lit("semantic"))
    got = {r["asrt_id"]: r["p"] for r in uncertain.fact_probability(facts, notes, "midpoint").collect()}
    assert got == pytest.approx({"a": 0.2, "b": 0.6, "c": 0.3, "d": 1.0, "e": 1.0})
    with pytest.raises(PySparkException, match="bound"):
        uncertain.fact_probability(facts, notes).collect()
    bad = spark.createDataFrame([("a", "problog", "probability", "num", "1.5", 1, "semantic")], notes.schema)
    with pytest.raises(PySparkException, match="range"):
        uncertain.fact_probability(facts, bad).collect()


def test_bins_and_boundaries(spark):
    assert scalar.bin_size("PT15M") == scalar.bin_size("15m") == timedelta(minutes=15) and scalar.bin_size("P2D") == timedelta(days=2)
    for bad in ("P0D", "1w", "PT5S"):
        with pytest.raises(ValueError):
            scalar.bin_size(bad)
    start, end = F.lit("2020-01-01").cast("timestamp"), F.lit("2020-01-03").cast("timestamp")
    df = spark.createDataFrame([("a", "2020-01-01 01:00", "2020-01-01 02:00"), ("b", None, None), ("c", "2020-01-02", "2020-01-02 00:00:00.000001")], "k string, f string, t string")
    df = df.select("k", F.col("f").cast("timestamp").alias("valid_from"), F.col("t").cast("timestamp").alias("valid_to"))
    assert rows(uncertain.time_binned(df, start, end, timedelta(hours=1)).select("k", "bin_from", "bin_to")) == [("a", 1, 2), ("b", 0, None), ("c", 24, 25)]
    for step, f, t in ((timedelta(hours=7), "2020-01-01", None), (timedelta(hours=1), "2019-12-31", None), (timedelta(hours=1), "2020-01-01", "2020-01-04"), (timedelta(hours=1), "2020-01-02", "2020-01-01")):
        bad = spark.createDataFrame([(f, t)], "f string, t string").select(F.col("f").cast("timestamp").alias("valid_from"), F.col("t").cast("timestamp").alias("valid_to"))
        with pytest.raises(PySparkException):
            uncertain.time_binned(bad, start, end, step).collect()
    texts = spark.createDataFrame([("a", "2020-02", "2020-03"), ("b", None, "2020-02"), ("c", "2020-02", None)], "k string, valid_from string, valid_to string")
    assert rows(uncertain.boundary_steps(texts, "2020-01", "2021").select("k", "active_from", "active_to")) == [("a", 1, 2), ("b", 0, 1), ("c", 1, None)]


def test_interval_rules(spark):
    nodes = spark.createDataFrame([("m", "pop", 0.5, 1.0, 0, None), ("z", "pop", 0.1, 1.0, 0, None)], "node string, label string, lo double, hi double, `from` int, `to` int")
    edges = spark.createDataFrame([("m", "j", "friend"), ("j", "k", "friend"), ("z", "q", "friend")], "source string, target string, kind string")
    got = uncertain.interval_fixpoint(nodes, edges, [uncertain.IntervalRule("pop", "friend", "pop", 0.6, 1.0, 0.5)], 3)
    assert rows(got) == [("j", "pop", 0.6, 1.0, 1), ("k", "pop", 0.6, 1.0, 2)]


# functions, streaming


def test_functions(spark):
    df = spark.createDataFrame([(" Straße ",), ("STRASSE",), (None,)], "t string")
    assert rows(df.select(scalar.casefold("t"))) == [("strasse",), ("strasse",), (None,)]
    found, more = scalar.candidates(df, "t", "strass", 1, "prefix")
    assert found.count() == 1 and more
    calls = scalar.apply_function(spark.createDataFrame([(1,), (1,), (None,), (3,)], "n int"), lambda n: -1 if n is None or n != n else int(n) * 2, ["n"], "m", "int", check=True)
    assert rows(calls) == [(1, 2), (1, 2), (3, 6), (None, -1)]
    iso = {"2020-01-01": True, "2020-13-01": False, "2020-01-01T10:00Z": True, "2020-01-01 10:00:00+01:00": True, "x": False}
    got = spark.createDataFrame([(k,) for k in iso], "t string").select("t", scalar.is_iso8601(F.col("t")).alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in got} == iso
    assert spark.createDataFrame([("a", None)], "x string, y string").select(scalar.template("<%x|%y> 5% %z", ["x", "y"]).alias("r")).first()["r"] == "<a|> 5% %z"


def test_streaming_latest(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    shape = "user long, kind string, seq long, ts timestamp"
    spark.createDataFrame([(1, "a", 1, None), (1, "b", 2, None), (2, "a", 3, None)], "user long, kind string, seq long, ts timestamp").withColumn("ts", F.timestamp_seconds("seq")).coalesce(1).write.parquet(src)

    def run():
        stream = spark.readStream.schema(shape).parquet(src)
        q = latest.latest_per_key(stream, ["user"], "seq", out, str(tmp_path / "cp"))()
        q.awaitTermination()

    run()
    spark.createDataFrame([(1, "c", 9, None)], shape).withColumn("ts", F.timestamp_seconds("seq")).coalesce(1).write.mode("append").parquet(src)
    run()
    assert rows(latest.current(spark, out, ["user"], "seq", shape).select("user", "kind")) == [(1, "c"), (2, "a")]
    stream = spark.readStream.schema(shape).parquet(src)
    q = latest.windowed_counts(latest.deduplicated(stream, "seq", "ts"), "ts", ["kind"], "5 seconds", "1 second").writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] in (None, 3, 4)


def test_named_views(spark, ledger):
    named = views.NamedViews(ledger)
    one = spark.createDataFrame([("c4",), ("c4",)], "asrt_id string")
    named.create("v", one)
    assert named.names() == ["v"] and named.get("v").claims.count() == 1
    named.update("v", spark.createDataFrame([("c4",), ("c5",)], "asrt_id string"))
    assert named.get("v").claims.count() == 2
    named.delete("v")
    for bad in (lambda: named.get("v"), lambda: named.create("w", spark.createDataFrame([("zz",)], "asrt_id string"))):
        with pytest.raises(RuleError):
            bad()


def test_staged_batches(spark):
    batch = writes.Batch(SCHEMA).set("domain_user:name", A, "n", source="s").add("domain_user:tag", A, "x")
    batch = writes.Batch.from_json(batch.to_json(), SCHEMA)
    empty = Ledger.of(spark)
    assert [r["status"] for r in batch.preview(empty).collect()] == ["write", "write"]
    one = batch.apply(empty, 1)
    assert one.claims.count() == 2
    assert [r["status"] for r in batch.preview(one).collect()] == ["skip", "write"]  # an added value is written again
    gone = writes.Batch(SCHEMA).retract(one.claims.first()["asrt_id"]).apply(one, 2)
    assert views.active(gone.claims, gone.revocations).count() == 1
    for bad in (lambda: batch.set("domain_user:name", A), lambda: batch.set("domain_user:name", A, "n", what="x"), lambda: writes.Batch.from_json(batch.to_json(), Schema())):
        with pytest.raises(RuleError):
            bad()
