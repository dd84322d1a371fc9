"""The fact ledger's tables and the views over them.

Tables (see the survey, section 1): claims, claim_meta, tx_meta_defaults, revocations and
annotations.  Nothing is updated: a view is always a join or a grouping over events.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encoding import entity_ref, entity_ref_column
from ..plans.compile import FactSpace
from ..plans.ir import RuleError
from ..schema import SPARK_TYPES, PredicateSpec, Schema

#: Schemas of the ledger's tables.  An argument's value is text; ``tag`` says what it means.
CLAIMS = "asrt_id string, seq long, tx_seq long, op_ordinal int, pred_id string, e_ref string, args array<struct<tag:string,value:string>>"
CLAIM_META = "asrt_id string, key string, kind string, value string, tx_seq long, op_ordinal int"
TX_DEFAULTS = "tx_seq long, key string, kind string, value string"
REVOCATIONS = "revoker_asrt_id string, revoked_asrt_id string, tx_seq long"
ANNOTATIONS = "asrt_id string, namespace string, category string, key string, kind string, value string, origin string, derivation string"


@dataclass(frozen=True)
class Ledger:
    """The five tables as DataFrames, wherever they come from."""

    claims: DataFrame
    claim_meta: DataFrame
    tx_defaults: DataFrame
    revocations: DataFrame
    annotations: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Ledger:
        """A ledger in which tables that are not given are empty."""
        kinds = {"claims": CLAIMS, "claim_meta": CLAIM_META, "tx_defaults": TX_DEFAULTS, "revocations": REVOCATIONS, "annotations": ANNOTATIONS}
        return cls(**{n: tables[n] if n in tables else spark.createDataFrame([], k) for n, k in kinds.items()})

    def as_of(self, tx_seq: int) -> Ledger:
        """What was there once this transaction was committed."""
        return replace(self, **{n: getattr(self, n).where(F.col("tx_seq") <= tx_seq) for n in ("claims", "claim_meta", "tx_defaults", "revocations")})

    def restricted(self, ids: DataFrame) -> Ledger:
        """Reads limited to a set of assertions (a column ``asrt_id``), with what belongs to them."""
        keep = ids.select("asrt_id").distinct()
        return replace(
            self,
            claims=self.claims.join(keep, "asrt_id", "left_semi"),
            claim_meta=self.claim_meta.join(keep, "asrt_id", "left_semi"),
            annotations=self.annotations.join(keep, "asrt_id", "left_semi"),
            revocations=self.revocations.join(keep, F.col("revoked_asrt_id") == keep["asrt_id"], "left_semi"),
        )


def active(claims: DataFrame, revocations: DataFrame, key: str = "asrt_id") -> DataFrame:
    """Claims that nothing revokes."""
    return claims.join(revocations.select(F.col("revoked_asrt_id").alias(key)), key, "left_anti")


def chosen(rows: DataFrame, keys: Sequence[str], order: str | Column = "seq") -> DataFrame:
    """The latest row of each key.

    One aggregation with partial results on the map side: of a key with very many rows each
    task sends one.
    """
    others = [c for c in rows.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def claim_value(arg: Column, tag: str) -> Column:
    """A stored argument as its tag's Spark type."""
    if tag == "bytes":
        return F.unbase64(F.translate(arg["value"], "-_", "+/"))
    return arg["value"].cast(SPARK_TYPES[tag])


def predicate_rows(ledger: Ledger, spec: PredicateSpec, every: bool = False) -> DataFrame:
    """A predicate's rows ``a0 .. an, _asrt, _seq``: active, and chosen unless it is multi-valued or ``every``."""
    n = len(spec.args)
    own = active(ledger.claims.where(F.col("pred_id") == spec.name), ledger.revocations)
    ok = F.size("args") == n - 1
    wrong = F.raise_error(F.concat(F.lit(f"{spec.name}: a claim has a wrong number of arguments: "), F.col("asrt_id")))
    cols = [F.when(ok, F.col("e_ref")).otherwise(wrong.cast("string")).alias("a0")]
    cols += [claim_value(F.get("args", F.lit(k - 1)), spec.args[k]).alias(f"a{k}") for k in range(1, n)]
    rows = own.select(*cols, F.col("asrt_id").alias("_asrt"), F.col("seq").alias("_seq"))
    if spec.cardinality == "single" and not every:
        rows = chosen(rows, [f"a{g}" for g in spec.group], "_seq")
    return rows


def entity_domain(ledger: Ledger, schema: Schema, entity: str) -> DataFrame:
    """(a0, _asrt): entities whose identity is complete and hashes to their reference.

    Stored ``:exists`` claims are not consulted; ``_asrt`` is derived from the identity claims.
    """
    spec = next((e for e in schema.entities if e.name == entity), None)
    if spec is None:
        raise RuleError(f"unknown entity: {entity}")
    parts = []
    for k, (name, _) in enumerate(spec.identity):
        pred = next(p for p in schema.predicates() if p.owner == entity and p.field == name and p.role == "identity")
        parts.append(predicate_rows(ledger, pred).select("a0", F.col("a1").alias(f"_v{k}"), F.col("_asrt").alias(f"_s{k}")))
    joined = reduce(lambda a, b: a.join(b, "a0"), parts)
    ref = entity_ref_column(entity, list(spec.identity), *[F.col(f"_v{k}") for k in range(len(parts))])
    supports = F.array_join(F.array_sort(F.array(*[F.col(f"_s{k}") for k in range(len(parts))])), ",")
    return joined.where(ref == F.col("a0")).select("a0", F.concat(F.lit("exists:"), F.sha2(F.encode(supports, "UTF-8"), 256)).alias("_asrt"))


def project(ledger: Ledger, schema: Schema, names: Sequence[str] | None = None, every: bool = False) -> FactSpace:
    """The view that rules see: each predicate's active and chosen rows, lazily."""
    relations, keys = {}, {}
    for spec in schema.predicates():
        if names is None or spec.name in names:
            rows = entity_domain(ledger, schema, spec.owner) if spec.role == "exists" else predicate_rows(ledger, spec, every).drop("_seq")
            relations[spec.name] = rows
            if spec.role == "exists" or spec.cardinality == "single" and not every:
                keys[spec.name] = tuple(f"a{g}" for g in spec.group)
    return FactSpace(ledger.claims.sparkSession, relations, keys)


def projection_audit(ledger: Ledger) -> DataFrame:
    """(pred_id, claims, active) counts."""
    live = active(ledger.claims, ledger.revocations).groupBy("pred_id").agg(F.count("*").alias("active"))
    return ledger.claims.groupBy("pred_id").agg(F.count("*").alias("claims")).join(live, "pred_id", "left").na.fill(0, ["active"])


# metadata


def effective_meta(ledger: Ledger, boundary: tuple[int, int] | None = None) -> DataFrame:
    """(asrt_id, key, kind, value): the last event of each key up to a boundary, inclusive.

    An event without kind and value unsets the key.  A transaction's default fills only keys
    that have no event at all, so an unset key stays unset.
    """
    events, claims, defaults = ledger.claim_meta, ledger.claims, ledger.tx_defaults
    at = F.struct("tx_seq", "op_ordinal")
    if boundary:
        limit = F.struct(F.lit(boundary[0]).cast("long").alias("tx_seq"), F.lit(boundary[1]).alias("op_ordinal"))
        events = events.where(at <= limit)
        claims = claims.where(F.struct("tx_seq", "op_ordinal") <= limit)
    last = events.groupBy("asrt_id", "key").agg(F.max_by(F.struct("kind", "value"), at).alias("m"))
    inherited = claims.select("asrt_id", "tx_seq").join(defaults, "tx_seq").join(last.select("asrt_id", "key"), ["asrt_id", "key"], "left_anti")
    return last.where("m.kind IS NOT NULL").select("asrt_id", "key", "m.kind", "m.value").unionByName(inherited.select("asrt_id", "key", "kind", "value"))


def meta_history(ledger: Ledger, asrt_id: str | None = None, key: str | None = None) -> DataFrame:
    """All metadata events in order."""
    rows = ledger.claim_meta
    for c, v in (("asrt_id", asrt_id), ("key", key)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows.orderBy("tx_seq", "op_ordinal")


def export_meta_history(ledger: Ledger, path: str) -> None:
    """All metadata events as JSON lines."""
    ledger.claim_meta.write.json(path, ignoreNullFields=False)


def import_meta_history(ledger: Ledger, path: str) -> Ledger:
    """The ledger with the events of a file that it does not hold yet; events of unknown assertions are an error."""
    events = ledger.claims.sparkSession.read.schema(CLAIM_META).json(path)
    known = ledger.claims.select("asrt_id").union(ledger.revocations.select("revoker_asrt_id"))
    if lost := events.join(known, "asrt_id", "left_anti").select("asrt_id").limit(1).collect():
        raise RuleError(f"unknown assertion: {lost[0][0]}")
    on = [events[c].eqNullSafe(ledger.claim_meta[c]) for c in ("asrt_id", "key", "kind", "value", "tx_seq", "op_ordinal")]
    return replace(ledger, claim_meta=ledger.claim_meta.unionByName(events.join(ledger.claim_meta, on, "left_anti").distinct()))


def valid_at(rows: DataFrame, t: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows valid at an ISO text: from ``start`` up to before ``end``.  Texts compare as texts; no start, no match."""
    return rows.where((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))


# premises


@dataclass(frozen=True)
class MetaExclusion:
    """Hide assertions whose metadata value is one of these; no value, no hiding."""

    key: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class PremiseAllowance:
    """Of one predicate, only assertions with these values; without a value only if ``absent_ok``."""

    predicate: str
    key: str
    allowed: tuple[str, ...]
    absent_ok: bool = False


@dataclass(frozen=True)
class PremiseBlock:
    """Of one predicate, hide assertions with these values."""

    predicate: str
    key: str
    blocked: tuple[str, ...]


def admissible(rows: DataFrame, rules: Sequence[MetaExclusion | PremiseAllowance | PremiseBlock], predicate: Column | None = None) -> DataFrame:
    """Rows (with one column per metadata key) that no rule hides."""
    keep: Column = F.lit(True)
    for r in rules:
        value = F.col(f"`{r.key}`")
        match r:
            case MetaExclusion(_, values):
                hidden = F.coalesce(value.isin(*values), F.lit(False))
            case PremiseAllowance(name, _, allowed, absent_ok):
                hidden = F.coalesce(~value.isin(*allowed), F.lit(not absent_ok))
                hidden = hidden & (F.lit(True) if predicate is None else predicate == name)
            case PremiseBlock(name, _, blocked):
                hidden = F.coalesce(value.isin(*blocked), F.lit(False)) & (F.lit(True) if predicate is None else predicate == name)
        keep = keep & ~hidden
    return rows.where(keep)


def premise_scope(ledger: Ledger, rules: Sequence[MetaExclusion | PremiseAllowance | PremiseBlock]) -> Ledger:
    """The ledger without hidden assertions.  A hidden revoker does not revoke."""
    keys = sorted({r.key for r in rules})
    meta = effective_meta(ledger).where(F.col("key").isin(*keys)).groupBy("asrt_id").pivot("key", keys).agg(F.first("value"))
    seen = admissible(ledger.claims.join(meta, "asrt_id", "left"), rules, F.col("pred_id")).select(*ledger.claims.columns)
    # revokers need not be claims; those with hidden metadata drop out
    anywhere = [r for r in rules if isinstance(r, MetaExclusion)]
    revs = ledger.revocations.join(meta.withColumnRenamed("asrt_id", "revoker_asrt_id"), "revoker_asrt_id", "left")
    return replace(ledger, claims=seen, revocations=admissible(revs, anywhere).select(*ledger.revocations.columns))


def evidence_scope(ledger: Ledger, ignored: Sequence[str]) -> Ledger:
    """The ledger without these assertions, each of which must exist."""
    ids = ledger.claims.sparkSession.createDataFrame([(i,) for i in ignored], "asrt_id string")
    unknown = ids.join(ledger.claims, "asrt_id", "left_anti").limit(1).collect()
    if unknown:
        raise RuleError(f"unknown assertion: {unknown[0][0]}")
    return replace(ledger, claims=ledger.claims.join(ids, "asrt_id", "left_anti"))


# reads


def assertions(ledger: Ledger, *, predicate: str | None = None, e_ref: str | None = None, value: str | None = None, tag: str | None = None, meta: Mapping[str, str] | None = None, only_active: bool = True) -> DataFrame:
    """Claims with their metadata as a map, in order of ingestion (missing: first) and id."""
    rows = ledger.claims
    if predicate is not None:
        rows = rows.where(F.col("pred_id") == predicate)
    if e_ref is not None:
        rows = rows.where(F.col("e_ref") == e_ref)
    if value is not None:
        rows = rows.where(F.exists("args", lambda a: a["value"] == value))
    if tag is not None:
        rows = rows.where(F.exists("args", lambda a: a["tag"] == tag))
    if only_active:
        rows = active(rows, ledger.revocations)
    said = effective_meta(ledger).groupBy("asrt_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))
    rows = rows.join(said, "asrt_id", "left")
    for k, v in (meta or {}).items():
        rows = rows.where(F.col("meta")[k] == v)
    return rows.orderBy(F.coalesce(F.col("meta")["ingested_at"].cast("long"), F.lit(-1)), "asrt_id")


def by_ids(ledger: Ledger, ids: Sequence[str], strict: bool = False) -> DataFrame:
    """Claims by id; with ``strict`` an unknown id is an error."""
    want = ledger.claims.sparkSession.createDataFrame([(i,) for i in ids], "asrt_id string")
    if strict and (lost := want.join(ledger.claims, "asrt_id", "left_anti").limit(1).collect()):
        raise RuleError(f"unknown assertion: {lost[0][0]}")
    return ledger.claims.join(want, "asrt_id", "left_semi")


def one(rows: DataFrame):
    """The single row; none or several are an error."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise RuleError("no row" if not found else "more than one row")
    return found[0]


def entities(facts: FactSpace, schema: Schema, entity: str) -> DataFrame:
    """Every entity of a type with all its fields: single ones as values, multi ones as sorted arrays."""
    out = facts[f"{entity}:exists"].select(F.col("a0").alias("e_ref"))
    for p in schema.predicates():
        if p.owner != entity or p.role not in ("identity", "field"):
            continue
        rows = facts[p.name]
        if p.cardinality == "multi":
            got = rows.groupBy("a0").agg(F.array_sort(F.collect_set(F.col("a1").cast("string"))).alias(p.field))
            out = out.join(got.withColumnRenamed("a0", "e_ref"), "e_ref", "left").withColumn(p.field, F.coalesce(p.field, F.array().cast("array<string>")))
        else:
            out = out.join(rows.select(F.col("a0").alias("e_ref"), F.col("a1").alias(p.field)), "e_ref", "left")
    return out


def find(facts: FactSpace, schema: Schema, entity: str, limit: int | None = None, **filters) -> DataFrame:
    """Entities whose fields have these values (multi-valued ones: contain), in order of reference."""
    rows = entities(facts, schema, entity)
    many = {p.field for p in schema.predicates() if p.owner == entity and p.cardinality == "multi"}
    for name, v in filters.items():
        if name not in rows.columns:
            raise RuleError(f"{entity} has no field {name}")
        rows = rows.where(F.array_contains(name, str(v)) if name in many else F.col(name) == v)
    rows = rows.orderBy("e_ref")
    return rows.limit(limit) if limit is not None else rows


def entity_of(ledger: Ledger, schema: Schema, entity: str, **identity) -> DataFrame:
    """The entity of a complete identity with all its fields: one row, or none.  Only its own claims are read."""
    spec = next((e for e in schema.entities if e.name == entity), None)
    if spec is None or set(identity) != {n for n, _ in spec.identity}:
        raise RuleError(f"{entity} is no entity of that identity")
    e_ref = entity_ref(entity, [(n, t, identity[n]) for n, t in spec.identity])
    own = replace(ledger, claims=ledger.claims.where(F.col("e_ref") == e_ref))
    names = [p.name for p in schema.predicates() if p.owner == entity and p.role in ("exists", "identity", "field")]
    return entities(project(own, schema, names), schema, entity)


def has_entity(ledger: Ledger, schema: Schema, entity: str, **identity) -> bool:
    return not entity_of(ledger, schema, entity, **identity).isEmpty()


def annotations_of(ledger: Ledger, *, asrt_id: str | None = None, **equal: str) -> DataFrame:
    """Annotations, each column compared with a value if one is given, in order of their columns."""
    rows = ledger.annotations
    for name, value in {"asrt_id": asrt_id, **equal}.items():
        if name not in rows.columns:
            raise RuleError(f"annotations have no {name}")
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(*rows.columns)


def conflicts(ledger: Ledger, spec: PredicateSpec) -> DataFrame:
    """(group keys, active assertions, chosen): groups of a single-valued predicate with several active claims."""
    keys = [f"a{g}" for g in spec.group]
    rows = predicate_rows(ledger, spec, every=True)
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_asrt")).alias("active"), F.max_by("_asrt", "_seq").alias("chosen"))
    return found.where(F.size("active") > 1)


def latest_rank(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a given order.

    Spark limits each task to the first row of a key before the shuffle, so a hot key is no hot task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


class NamedViews:
    """Named sets of assertions for this session; durable ones are ``Workspace.create_view``."""

    def __init__(self, ledger: Ledger) -> None:
        self._ledger = ledger
        self._ids: dict[str, DataFrame] = {}

    def create(self, name: str, ids: DataFrame) -> None:
        """Name a set of ids (a column ``asrt_id``); a taken name or an unknown id is an error."""
        if name in self._ids:
            raise RuleError(f"there is a view {name}")
        self._put(name, ids)

    def update(self, name: str, ids: DataFrame) -> None:
        self.get(name)
        self._put(name, ids)

    def _put(self, name: str, ids: DataFrame) -> None:
        ids = ids.select("asrt_id").distinct()
        if lost := ids.join(self._ledger.claims, "asrt_id", "left_anti").limit(1).collect():
            raise RuleError(f"unknown assertion: {lost[0][0]}")
        self._ids[name] = ids

    def get(self, name: str) -> Ledger:
        """Reads limited to the set."""
        if name not in self._ids:
            raise RuleError(f"no view {name}")
        return self._ledger.restricted(self._ids[name])

    def delete(self, name: str) -> None:
        self.get(name)
        del self._ids[name]

    def names(self) -> list[str]:
        return sorted(self._ids)
