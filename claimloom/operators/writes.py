"""Writes: batches of claims, revocations and metadata that are appended, never changed."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.encoding import entity_ref, ingest_key
from ..plans.ir import RuleError
from ..schema import PredicateSpec, Schema
from ..sources.shared import materialize
from .views import Ledger, active, effective_meta, entity_domain

#: A batch's items: what is claimed, from where, and for when.
ITEMS = "pred_id string, e_ref string, args array<struct<tag:string,value:string>>, source string, source_loc string, trace_id string, valid_from string, valid_to string, version string"
#: Columns that items may have besides: their order (else the order of the rows), what to do with them
#: (``set``, ``add`` or ``retract``; else set), and the assertion to retract.
OPTIONAL = {"ordinal": "long", "op": "string", "asrt_id": "string"}
META_KEYS = ("source", "source_loc", "trace_id", "valid_from", "valid_to", "version")


@F.pandas_udf(StringType())
def _keys(items: pd.DataFrame) -> pd.Series:
    out = []
    for r in items.to_dict("records"):
        terms = [(a["tag"], _typed(a["tag"], a["value"])) for a in r["args"]]
        out.append(ingest_key(r["pred_id"], r["e_ref"], terms, {k: r[k] for k in META_KEYS}))
    return pd.Series(out)


def _typed(tag: str, value: str):
    if tag in ("int", "time"):
        return int(value)
    if tag == "float64":
        return float(value)
    if tag == "bool":
        return value == "true"
    return value.encode() if tag == "bytes" else value


def with_keys(items: DataFrame) -> DataFrame:
    """Add ``ingest_key``: equal for the same claim from the same place and time."""
    return items.withColumn("ingest_key", _keys(F.struct("pred_id", "e_ref", "args", *META_KEYS)))


def new_only(items: DataFrame, held: DataFrame, key: str = "ingest_key") -> DataFrame:
    """Items whose key is not held, each once.  ``held`` has the keys of active claims, so a revoked claim is written again."""
    return items.dropDuplicates([key]).join(held.select(key), key, "left_anti")


def ordered(items: DataFrame) -> DataFrame:
    """Items with all of :data:`OPTIONAL`'s columns, written, so that their order stays."""
    if "ordinal" not in items.columns:
        items = items.withColumn("ordinal", F.monotonically_increasing_id())
    for name, kind in OPTIONAL.items():
        if name not in items.columns:
            items = items.withColumn(name, F.lit("set" if name == "op" else None).cast(kind))
    return materialize(items, "batch")


def numbered(rows: DataFrame, order: str, per_part: int = 100_000) -> DataFrame:
    """Add ``_place``: 0 and up in the order of a number, by sums over its ranges, so no task sees all rows."""
    parts = min(1024, 1 + rows.count() // per_part)
    edges = sorted(set(rows.approxQuantile(order, [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(order))) if edges else F.lit(0)
    rows = rows.withColumn("_b", part)
    before = F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = rows.groupBy("_b").agg(F.count("*").alias("n")).select("_b", before.alias("_base"))  # at most 1024 rows
    own = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return rows.withColumn("_own", own).join(F.broadcast(base), "_b").withColumn("_place", (F.col("_base") + F.col("_own") - 1).cast("long")).drop("_b", "_own", "_base")


def append_claims(ledger: Ledger, items: DataFrame, tx_seq: int, first_seq: int = 0) -> Ledger:
    """The ledger with a batch added, in the items' order: of two claims on one field the later wins.

    An item to ``set`` is skipped if an active claim has its ingest key, or an earlier item of the
    batch; one to ``add`` is always written.  A claim has the sequence number ``first_seq`` + 1 and
    up, and its ordinal within the transaction from 0, both without repeats.
    """
    return _append(ledger, ordered(items).where("op <> 'retract'"), tx_seq, first_seq)


def _append(ledger: Ledger, items: DataFrame, tx_seq: int, first_seq: int, leaving: DataFrame | None = None) -> Ledger:
    """``leaving``: (asrt_id, gone) of active claims that the batch revokes at an ordinal."""
    live = active(ledger.claims, ledger.revocations).select("asrt_id")
    held = effective_meta(ledger).where("key = 'ingest_key'").join(live, "asrt_id", "left_semi").select("asrt_id", F.col("value").alias("ingest_key"))
    # a key is held until its last claim is revoked
    until = held.withColumn("gone", F.lit(None).cast("long")) if leaving is None else held.join(leaving, "asrt_id", "left")
    never = F.lit((1 << 63) - 1).cast("long")
    held = until.groupBy("ingest_key").agg(F.max(F.coalesce("gone", never)).alias("until"))
    keyed = materialize(with_keys(items), "batch")
    sets = keyed.where("op = 'set'").join(held, "ingest_key", "left").where("until IS NULL OR until < ordinal")
    names = [c for c in keyed.columns if c != "ingest_key"]
    sets = sets.groupBy("ingest_key").agg(F.min_by(F.struct(*names), "ordinal").alias("_first")).select("ingest_key", "_first.*")
    fresh = sets.unionByName(keyed.where("op = 'add'"))
    rows = numbered(materialize(fresh, "batch"), "ordinal")
    # the same key may come again after a revocation, so the id holds the transaction too, and of an added one its place
    own = F.when(F.col("op") == "add", F.concat(F.lit("/"), "_place")).otherwise("")
    rows = rows.withColumn("asrt_id", F.concat(F.lit("asrt:"), F.sha2(F.encode(F.concat(F.concat_ws("/", "ingest_key", F.lit(str(tx_seq))), own), "UTF-8"), 256)))
    rows = rows.withColumns({"tx_seq": F.lit(tx_seq).cast("long"), "op_ordinal": F.col("_place").cast("int"), "seq": F.lit(first_seq + 1).cast("long") + F.col("_place")})
    rows = materialize(rows, "appended")
    claims = rows.select("asrt_id", "seq", "tx_seq", "op_ordinal", "pred_id", "e_ref", "args")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("ingest_key", *META_KEYS)])
    meta = rows.select("asrt_id", F.explode(pairs).alias("m"), "tx_seq", "op_ordinal").where("m.value IS NOT NULL")
    meta = meta.select("asrt_id", "m.key", F.lit("str").alias("kind"), "m.value", "tx_seq", "op_ordinal")
    return Ledger(ledger.claims.unionByName(claims), ledger.claim_meta.unionByName(meta), ledger.tx_defaults, ledger.revocations, ledger.annotations)


def retract(ledger: Ledger, ids: DataFrame, revoker: str, tx_seq: int, protected: Sequence[str] = ()) -> Ledger:
    """The ledger with these assertions revoked.  Doing it again changes nothing.

    Revoking a revocation, an unknown assertion, or a claim of a ``protected`` predicate
    (identity fields, existence anchors) is an error.
    """
    ids = ids.select("asrt_id").distinct()
    if not ids.join(ledger.revocations.select(F.col("revoker_asrt_id").alias("asrt_id")), "asrt_id", "left_semi").isEmpty():
        raise RuleError("a revocation cannot be revoked")
    if lost := ids.join(ledger.claims, "asrt_id", "left_anti").limit(1).collect():
        raise RuleError(f"unknown assertion: {lost[0][0]}")
    if protected and not ledger.claims.where(F.col("pred_id").isin(*protected)).join(ids, "asrt_id", "left_semi").isEmpty():
        raise RuleError("identity and existence claims are protected")
    fresh = ids.join(ledger.revocations.select(F.col("revoked_asrt_id").alias("asrt_id")), "asrt_id", "left_anti")
    rows = fresh.select(F.concat(F.lit(f"{revoker}:"), F.col("asrt_id")).alias("revoker_asrt_id"), F.col("asrt_id").alias("revoked_asrt_id"), F.lit(tx_seq).cast("long").alias("tx_seq"))
    return Ledger(ledger.claims, ledger.claim_meta, ledger.tx_defaults, ledger.revocations.unionByName(rows), ledger.annotations)


def replace_claims(ledger: Ledger, ids: DataFrame, items: DataFrame, revoker: str, tx_seq: int, first_seq: int = 0) -> Ledger:
    """Revoke and claim anew in one batch."""
    return append_claims(retract(ledger, ids, revoker, tx_seq), items, tx_seq, first_seq)


def delete_entity(ledger: Ledger, e_ref: str, revoker: str, tx_seq: int) -> Ledger:
    """Revoke all active claims about an entity."""
    ids = active(ledger.claims.where(F.col("e_ref") == e_ref), ledger.revocations).select("asrt_id")
    return retract(ledger, ids, revoker, tx_seq)


def append_meta(ledger: Ledger, events: DataFrame) -> Ledger:
    """Add metadata events; an event without kind and value unsets its key."""
    return Ledger(ledger.claims, ledger.claim_meta.unionByName(events), ledger.tx_defaults, ledger.revocations, ledger.annotations)


def append_annotations(ledger: Ledger, rows: DataFrame) -> Ledger:
    return Ledger(ledger.claims, ledger.claim_meta, ledger.tx_defaults, ledger.revocations, ledger.annotations.unionByName(rows))


def value_errors(items: DataFrame, schema: Schema) -> DataFrame:
    """Items with an ``error``: unknown predicate, wrong number or tags of arguments, enum or pattern not met."""
    checks: Column = F.lit("unknown predicate")
    for p in schema.predicates():
        checks = F.when(F.col("pred_id") == p.name, _value_error(p)).otherwise(checks)
    return items.withColumn("error", checks).where("error IS NOT NULL")


def _value_error(p: PredicateSpec) -> Column:
    rest = list(p.args[1:])
    out = F.when(F.size("args") != len(rest), F.lit("wrong number of arguments"))
    if rest:
        tags = F.transform("args", lambda a: a["tag"])
        out = out.when(tags != F.array(*[F.lit(t) for t in rest]), F.lit("wrong type"))
        last = F.element_at("args", len(rest))["value"]
        if p.enum:
            out = out.when(~last.isin(*[str(v) for v in p.enum]), F.lit("not one of the enum"))
        if p.pattern:
            out = out.when(~last.rlike(f"^(?:{p.pattern})$"), F.lit("pattern not met"))
    return out


def item_errors(ledger: Ledger, items: DataFrame, schema: Schema) -> DataFrame:
    """(ordinal, error) of items that cannot be applied."""
    values = value_errors(items.where("op IN ('set', 'add')"), schema).select("ordinal", "error")
    unknown = items.where("op = 'retract'").join(ledger.claims.select("asrt_id"), "asrt_id", "left_anti").select("ordinal", F.lit("unknown assertion").alias("error"))
    strange = items.where("op IS NULL OR op NOT IN ('set', 'add', 'retract')").select("ordinal", F.lit("unknown operation").alias("error"))
    guarded = [p.name for p in schema.predicates() if p.role in ("identity", "exists")]
    kept = ledger.claims.where(F.col("pred_id").isin(*guarded)).select("asrt_id") if guarded else ledger.claims.select("asrt_id").limit(0)
    guard = items.where("op = 'retract'").join(kept, "asrt_id", "left_semi").select("ordinal", F.lit("identity and existence claims are protected").alias("error"))
    return reduce(DataFrame.unionByName, [values, unknown, strange, guard])


def ingest(ledger: Ledger, items: DataFrame, schema: Schema, tx_seq: int, mode: str = "stop", first_seq: int = 0, revoker: str = "ingest") -> tuple[Ledger, DataFrame]:
    """Apply items in order; returns the ledger and (ordinal, error) of those that could not be.

    ``stop``: what comes before the first error goes in, and that error is returned; ``collect``:
    all good items go in.  Items of one ledger state are checked against it: a retraction
    names a claim that was there before the batch.  Retracting a revoked claim does nothing;
    a field set again after its retraction is written.
    """
    if mode not in ("stop", "collect"):
        raise RuleError(f"unknown mode: {mode}")
    items = ordered(items)
    errors = materialize(item_errors(ledger, items, schema), "errors")
    if mode == "stop":
        first = errors.agg(F.min("ordinal")).first()[0]
        if first is not None:
            errors = errors.where(F.col("ordinal") == first)
            items = items.where(F.col("ordinal") < first)
    else:
        items = items.join(errors.select("ordinal"), "ordinal", "left_anti")
    gone = materialize(items.where("op = 'retract'").groupBy("asrt_id").agg(F.min("ordinal").alias("gone")), "retracted")
    out = _append(ledger, items.where("op <> 'retract'"), tx_seq, first_seq, gone)
    if not gone.isEmpty():
        out = retract(out, gone, revoker, tx_seq)
    return out, errors


def accept(candidates: DataFrame, existing: DataFrame, key: str = "candidate_key", dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Candidates to write, each once, and a report (key, status: new or duplicate)."""
    once = candidates.dropDuplicates([key])
    status = once.join(existing.select(F.col(key).alias("_held")).distinct(), F.col(key) == F.col("_held"), "left")
    report = status.select(key, F.when(F.col("_held").isNull(), F.lit("new")).otherwise(F.lit("duplicate")).alias("status"))
    fresh = status.where(F.col("_held").isNull()).drop("_held")
    return (fresh.limit(0) if dry_run else fresh), report


def accept_in_order(candidates: DataFrame, key: str = "candidate_key", needs: str = "needs", failed: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(key, level, status): candidates by level of dependency.

    A candidate is ``accepted`` at the level after its last need; one that needs a ``failed`` or
    unknown candidate, or itself through others, is ``blocked_dependency``.  Levels are
    found a round at a time over tables, until none becomes ready; where ``max_rounds`` ends
    it before that, RuleError is raised.
    """
    keys = candidates.select(key).where(F.col(key).isNotNull()).distinct()
    if failed is not None:
        keys = keys.join(failed.select(key), key, "left_anti")
    edges = candidates.select(key, F.explode(needs).alias("need")).join(keys, key, "left_semi")
    edges = materialize(edges, "needs")
    ready = keys.join(edges.select(key), key, "left_anti")
    done = None
    level = 0
    while True:
        ready = materialize(ready.withColumn("level", F.lit(level)), "level")
        if ready.isEmpty():
            break
        if level == max_rounds:
            raise RuleError(f"candidates still become ready after {max_rounds} rounds")
        done = ready if done is None else done.unionByName(ready)
        # needs that are met go; who loses the last one is ready
        left = materialize(edges.join(ready.select(F.col(key).alias("need")), "need", "left_anti"), "needs")
        ready = edges.select(key).distinct().join(left.select(key), key, "left_anti")
        edges = left
        level += 1
    rest = candidates.select(key).distinct()
    if done is None:
        return rest.withColumns({"level": F.lit(None).cast("int"), "status": F.lit("blocked_dependency")})
    out = rest.join(done, key, "left")
    return out.withColumn("status", F.when(F.col("level").isNull(), F.lit("blocked_dependency")).otherwise(F.lit("accepted")))


def accept_many(ledger: Ledger, candidates: DataFrame, items: DataFrame, tx_seq: int, mode: str = "atomic", first_seq: int = 0, key: str = "candidate_key", needs: str = "needs") -> tuple[Ledger, DataFrame]:
    """Write candidates' items in order of dependency; returns the ledger and (key, level, status, error).

    ``candidates`` has a key, the keys it needs, and ``error`` (null: valid); ``items`` are theirs by key.
    ``best_effort``: failed ones are FAILED_VALIDATION, what needs them is BLOCKED_DEPENDENCY, the others
    are ACCEPTED and written.  ``atomic``: with any that is not accepted nothing is written, and those
    that would have been are FAILED_RUNTIME with ATOMIC_ROLLBACK.
    """
    if mode not in ("atomic", "best_effort"):
        raise RuleError(f"unknown mode: {mode}")
    failed = materialize(candidates.where("error IS NOT NULL").select(key, "error").dropDuplicates([key]), "failed")
    placed = accept_in_order(candidates, key, needs, failed.select(key)).join(failed, key, "left")
    status = F.when(F.col("error").isNotNull(), "FAILED_VALIDATION").when(F.col("status") == "accepted", "ACCEPTED").otherwise("BLOCKED_DEPENDENCY")
    error = F.coalesce("error", F.when(F.col("status") != "accepted", "BLOCKED_DEPENDENCY"))
    report = materialize(placed.select(key, "level", status.alias("status"), error.alias("error")), "accepted")
    if mode == "atomic" and not report.where("status <> 'ACCEPTED'").isEmpty():
        undone = F.col("status") == "ACCEPTED"
        return ledger, report.withColumns({"error": F.when(undone, "ATOMIC_ROLLBACK").otherwise(F.col("error")), "status": F.when(undone, "FAILED_RUNTIME").otherwise(F.col("status"))})
    good = ordered(items).join(report.where("status = 'ACCEPTED'").select(key, "level"), key)
    # a candidate's items come after those of all that it needs
    good = numbered_by(good, ["level", "ordinal"]).drop(key, "level")
    return append_claims(ledger, good, tx_seq, first_seq), report


def numbered_by(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``ordinal`` anew, rising in the order of several columns (sorted ranges, numbered within and across)."""
    return materialize(rows.orderBy(*order).drop("ordinal").withColumn("ordinal", F.monotonically_increasing_id()), "ordered")


@dataclass
class EntityPlan:
    """What writing to an entity would do: its reference, whether it is new, the items, and why it cannot be."""

    e_ref: str | None
    is_new: bool
    items: list[dict]
    error: str | None = None

    def apply(self, ledger: Ledger, tx_seq: int, first_seq: int = 0) -> Ledger:
        if self.error:
            raise RuleError(self.error)
        if not self.items:
            return ledger
        frame = ledger.claims.sparkSession.createDataFrame([(*(i[c] for c in ("pred_id", "e_ref", "args", *META_KEYS)), k) for k, i in enumerate(self.items)], f"{ITEMS}, ordinal long")
        return append_claims(ledger, frame, tx_seq, first_seq)


def plan_entity(ledger: Ledger, schema: Schema, entity: str, identity: Mapping[str, object], fields: Mapping[str, object] | None = None, create: bool = True, **meta: str) -> EntityPlan:
    """Plan the writing of fields (multi-valued ones: lists) to the entity of an identity, which is made if ``create``.

    The identity is complete and has no other field.  A new entity's identity claims come first.
    """
    spec = next((e for e in schema.entities if e.name == entity), None)
    if spec is None:
        return EntityPlan(None, False, [], f"unknown entity: {entity}")
    if set(identity) != {n for n, _ in spec.identity}:
        return EntityPlan(None, False, [], f"{entity} is identified by {sorted(n for n, _ in spec.identity)}")
    by_field = {p.field: p for p in schema.predicates() if p.owner == entity and p.role == "field"}
    if unknown := set(fields or {}) - set(by_field):
        return EntityPlan(None, False, [], f"{entity} has no field {sorted(unknown)}")
    try:
        e_ref = entity_ref(entity, [(n, t, identity[n]) for n, t in spec.identity])
    except ValueError as e:
        return EntityPlan(None, False, [], str(e))
    own = replace(ledger, claims=ledger.claims.where(F.col("e_ref") == e_ref))  # filters reach the scan
    is_new = entity_domain(own, schema, entity).isEmpty()
    if is_new and not create:
        return EntityPlan(e_ref, True, [], f"there is no such {entity}")
    batch = Batch(schema)
    own_name = {p.field: p.name for p in schema.predicates() if p.owner == entity and p.role == "identity"}
    if is_new:
        for n, _ in spec.identity:
            batch.set(own_name[n], e_ref, identity[n], **meta)
    for n, v in (fields or {}).items():
        for one in v if by_field[n].cardinality == "multi" and isinstance(v, (list, tuple)) else [v]:
            batch.set(by_field[n].name, e_ref, one, **meta)
    bad = value_errors(batch.frame(ledger), schema).select("error").limit(1).collect() if batch.items else []
    return EntityPlan(e_ref, is_new, batch.items, bad[0][0] if bad else None)


def union_ledgers(parts: Sequence[Ledger]) -> Ledger:
    """Several ledgers' tables together."""
    names = ("claims", "claim_meta", "tx_defaults", "revocations", "annotations")
    return Ledger(**{n: reduce(DataFrame.unionByName, [getattr(p, n) for p in parts]) for n in names})


def meta_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


class Batch:
    """Staged writes that are previewed, sent as JSON, and applied in one transaction."""

    def __init__(self, schema: Schema) -> None:
        self.schema = schema
        self.items: list[dict] = []
        self.retracted: list[str] = []

    def set(self, predicate: str, e_ref: str, *values, **meta: str) -> Batch:
        """Stage a claim; values follow the predicate's arguments after the entity."""
        spec = self.schema[predicate]
        if len(values) != len(spec.args) - 1:
            raise RuleError(f"{predicate} takes {len(spec.args) - 1} values")
        if unknown := set(meta) - set(META_KEYS):
            raise RuleError(f"unknown metadata: {sorted(unknown)}")
        shown = [{"tag": t, "value": str(v).lower() if t == "bool" else str(v)} for t, v in zip(spec.args[1:], values, strict=True)]
        self.items.append({"pred_id": predicate, "e_ref": e_ref, "args": shown, **{k: meta.get(k) for k in META_KEYS}, "op": "set"})
        return self

    def add(self, predicate: str, e_ref: str, *values, **meta: str) -> Batch:
        """Stage a claim that is written even where an equal one is held."""
        self.set(predicate, e_ref, *values, **meta)
        self.items[-1]["op"] = "add"
        return self

    def retract(self, asrt_id: str) -> Batch:
        self.retracted.append(asrt_id)
        return self

    def to_json(self) -> str:
        return json.dumps({"schema": self.schema.digest(), "items": self.items, "retracted": self.retracted}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str, schema: Schema) -> Batch:
        said = json.loads(text)
        if said["schema"] != schema.digest():
            raise RuleError("the batch is of another schema")
        out = cls(schema)
        out.items, out.retracted = said["items"], said["retracted"]
        return out

    def frame(self, ledger: Ledger) -> DataFrame:
        """The items with their place in the batch."""
        return ledger.claims.sparkSession.createDataFrame([(*(i[c] for c in ("pred_id", "e_ref", "args", *META_KEYS)), i.get("op", "set"), k) for k, i in enumerate(self.items)], f"{ITEMS}, op string, ordinal long")

    def preview(self, ledger: Ledger) -> DataFrame:
        """(pred_id, e_ref, status): what applying would do: write, skip (held already) or refuse."""
        items = with_keys(self.frame(ledger))
        live = active(ledger.claims, ledger.revocations).select("asrt_id")
        held = effective_meta(ledger).where("key = 'ingest_key'").join(live, "asrt_id", "left_semi").select(F.col("value").alias("ingest_key")).distinct().withColumn("held", F.lit(True))
        bad = with_keys(value_errors(self.frame(ledger), self.schema).drop("error")).select("ingest_key").distinct().withColumn("bad", F.lit(True))
        out = items.join(held, "ingest_key", "left").join(bad, "ingest_key", "left")
        return out.select("pred_id", "e_ref", F.when(F.col("bad"), "refuse").when(F.col("held") & (F.col("op") == "set"), "skip").otherwise("write").alias("status"))

    def apply(self, ledger: Ledger, tx_seq: int, first_seq: int = 0, revoker: str = "batch") -> Ledger:
        """All of it, or RuleError and nothing."""
        if self.items and not value_errors(self.frame(ledger), self.schema).isEmpty():
            raise RuleError("the batch has items that do not fit the schema")
        if self.retracted:
            ids = ledger.claims.sparkSession.createDataFrame([(i,) for i in self.retracted], "asrt_id string")
            ledger = retract(ledger, ids, revoker, tx_seq)
        return append_claims(ledger, self.frame(ledger), tx_seq, first_seq) if self.items else ledger
