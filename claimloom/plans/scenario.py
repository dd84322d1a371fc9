"""What-if: patched relations, patched rules, and what differs between two results.

A scenario never touches stored facts.  Each operation hides rows of a relation (an anti
join) or adds rows (a union), so a patched relation is as lazy as the one it stands for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compile import FactSpace, evaluate
from .ir import Body, Cmp, Pred, RuleError, parse


@dataclass(frozen=True)
class SetValue:
    """The entity has exactly this value in a single-valued field."""

    field: str
    entity: Any
    value: Any


@dataclass(frozen=True)
class EnsureMember:
    """The entity has this among its values."""

    field: str
    entity: Any
    value: Any


@dataclass(frozen=True)
class SetMembers:
    """The entity has exactly these values."""

    field: str
    entity: Any
    values: tuple[Any, ...]


@dataclass(frozen=True)
class WithoutField:
    field: str
    entity: Any


@dataclass(frozen=True)
class WithoutValue:
    field: str
    entity: Any
    value: Any


@dataclass(frozen=True)
class WithoutRelation:
    edge: str
    source: Any
    target: Any


@dataclass(frozen=True)
class EnsureRelation:
    edge: str
    source: Any
    target: Any
    value: Any = None


@dataclass(frozen=True)
class WithoutEntity:
    """Nothing is known of the entity: neither its own rows nor references to it."""

    entity: Any


@dataclass(frozen=True)
class CreateEntity:
    """An entity that exists in the scenario only, with its fields."""

    domain: str
    entity: Any
    fields: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class WithoutAssertion:
    asrt_id: str


Op = SetValue | EnsureMember | SetMembers | WithoutField | WithoutValue | WithoutRelation | EnsureRelation | WithoutEntity | CreateEntity | WithoutAssertion


def _check(ops: Sequence[Op]) -> None:
    """Operations that contradict each other are errors, whatever their order."""
    said: dict[tuple, Op] = {}
    gone = {o.entity for o in ops if isinstance(o, WithoutEntity)}
    for o in ops:
        if not isinstance(o, WithoutEntity) and getattr(o, "entity", None) in gone:
            raise RuleError(f"the scenario removes {o.entity} and uses it")
        match o:
            case SetValue(f, e, _) | SetMembers(f, e, _) | WithoutField(f, e):
                k = ("all", f, e)
            case EnsureMember(f, e, v) | WithoutValue(f, e, v):
                if ("all", f, e) in said:
                    raise RuleError(f"the scenario sets {f} of {e} twice")
                k = ("one", f, e, v)
            case EnsureRelation(f, a, b, _) | WithoutRelation(f, a, b):
                k = ("edge", f, a, b)
            case _:
                continue
        if k in said and said[k] != o or k[0] == "all" and any(x[:3] == ("one", *k[1:]) for x in said):
            raise RuleError(f"the scenario contradicts itself: {said.get(k, o)} and {o}")
        said[k] = o


def apply_scenario(facts: FactSpace, ops: Sequence[Op], p: float = 1.0) -> FactSpace:
    """The facts as they would be.  Added facts are as probable as ``p`` where relations have probabilities."""
    if not 0 < p <= 1:
        raise RuleError("a probability is above 0 and at most 1")
    _check(ops)
    hide: dict[str, list[Column]] = {}
    add: dict[str, list[tuple]] = {}

    def cols(name: str) -> list[Column]:
        return [F.col(f"`{c}`") for c in facts.args(name)]

    def hidden(name: str, test: Column) -> None:
        hide.setdefault(name, []).append(test)

    for o in ops:
        match o:
            case SetValue(f, e, v):
                hidden(f, cols(f)[0] == F.lit(e))
                add.setdefault(f, []).append((e, v))
            case SetMembers(f, e, vs):
                hidden(f, cols(f)[0] == F.lit(e))
                add.setdefault(f, []).extend((e, v) for v in dict.fromkeys(vs))
            case EnsureMember(f, e, v):
                hidden(f, (cols(f)[0] == F.lit(e)) & (cols(f)[1] == F.lit(v)))
                add.setdefault(f, []).append((e, v))
            case WithoutField(f, e):
                hidden(f, cols(f)[0] == F.lit(e))
            case WithoutValue(f, e, v):
                hidden(f, (cols(f)[0] == F.lit(e)) & (cols(f)[1] == F.lit(v)))
            case WithoutRelation(f, a, b):
                hidden(f, (cols(f)[0] == F.lit(a)) & (cols(f)[1] == F.lit(b)))
            case EnsureRelation(f, a, b, v):
                hidden(f, (cols(f)[0] == F.lit(a)) & (cols(f)[1] == F.lit(b)))
                add.setdefault(f, []).append((a, b) if v is None else (a, b, v))
            case CreateEntity(domain, e, fields):
                for name, row in ((domain, (e,)), *((f, (e, v)) for f, v in fields)):
                    hidden(name, reduce(Column.__and__, [c == F.lit(x) for c, x in zip(cols(name), row, strict=True)]))
                    add.setdefault(name, []).append(row)
            case WithoutEntity(e):
                for name in facts.names():
                    same = [F.col(f"`{c}`") == F.lit(e) for c in facts.args(name) if _comparable(facts[name].schema[c].dataType.typeName(), e)]
                    if same:
                        hidden(name, reduce(Column.__or__, same))
            case WithoutAssertion(i):
                for name in facts.names():
                    if "_asrt" in facts[name].columns:
                        hidden(name, F.col("_asrt") == i)
    patched = {}
    for name in {*hide, *add}:
        rel = facts[name]
        if name in hide:
            rel = rel.where(~F.coalesce(reduce(Column.__or__, hide[name]), F.lit(False)))
        if name in add:
            kinds = [rel.schema[c] for c in facts.args(name)]
            rows = facts.spark.createDataFrame(list(dict.fromkeys(add[name])), ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds))
            if "_asrt" in rel.columns:
                said = F.to_json(F.struct(*[F.col(f"`{k.name}`") for k in kinds]))
                rows = rows.withColumn("_asrt", F.concat(F.lit(f"scenario:{name}:"), said))
            if "_p" in rel.columns:
                rows = rows.withColumn("_p", F.lit(p))
            rel = rel.unionByName(rows)
        patched[name] = rel
    return facts.with_relations(patched)


def _comparable(kind: str, value: Any) -> bool:
    return kind == "string" if isinstance(value, str) else kind in ("long", "integer", "short", "byte")


# overlays over single facts


@dataclass(frozen=True)
class RemoveFact:
    predicate: str
    fact: tuple[Any, ...]


@dataclass(frozen=True)
class ReplaceFact:
    """A fact with another value; its key, all arguments but the last, stays."""

    predicate: str
    fact: tuple[Any, ...]
    new: tuple[Any, ...]


def overlay(facts: FactSpace, changes: Sequence[RemoveFact | ReplaceFact]) -> FactSpace:
    """The facts with some removed or replaced; each must be visible, and be named once."""
    if len({(c.predicate, c.fact) for c in changes}) != len(changes):
        raise RuleError("a fact is changed twice")
    patched: dict[str, DataFrame] = {}
    sought: dict[str, list[tuple[RemoveFact | ReplaceFact, Column]]] = {}
    for c in changes:
        args = facts.args(c.predicate)
        if len(c.fact) != len(args):
            raise RuleError(f"{c.predicate} has {len(args)} arguments")
        if isinstance(c, ReplaceFact) and (len(c.new) != len(args) or c.new[:-1] != c.fact[:-1]):
            raise RuleError("a replaced fact keeps its key")
        rel = patched.get(c.predicate, facts[c.predicate])
        same = reduce(Column.__and__, [F.col(f"`{a}`").eqNullSafe(F.lit(v)) for a, v in zip(args, c.fact, strict=True)])
        sought.setdefault(c.predicate, []).append((c, same))
        if isinstance(c, ReplaceFact):
            last = args[-1]
            rel = rel.withColumn(last, F.when(same, F.lit(c.new[-1])).otherwise(F.col(f"`{last}`")).cast(rel.schema[last].dataType))
        else:
            rel = rel.where(~same)
        patched[c.predicate] = rel
    for name, asked in sought.items():  # one pass over a predicate says which of its facts are there
        seen = facts[name].where(reduce(Column.__or__, [s for _, s in asked])).agg(*[F.max(s).alias(f"c{k}") for k, (_, s) in enumerate(asked)]).first()
        for k, (c, _) in enumerate(asked):
            if not seen[k]:
                raise RuleError(f"{c.predicate}{c.fact} is not visible")
    return facts.with_relations(patched)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one result only, with ``change``: added or removed."""
    added = after.subtract(before).withColumn("change", F.lit("added"))
    return added.unionByName(before.subtract(after).withColumn("change", F.lit("removed")))


def compare_variants(primary: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows of either result with ``side``: shared, primary_only or candidate_only.  One grouping, no join."""
    both = primary.distinct().withColumn("_s", F.lit(1)).unionByName(candidate.distinct().withColumn("_s", F.lit(2)))
    sides = both.groupBy(*primary.columns).agg(F.sum("_s").alias("_s"))
    return sides.withColumn("side", F.element_at(F.array(F.lit("primary_only"), F.lit("candidate_only"), F.lit("shared")), F.col("_s").cast("int"))).drop("_s")


def expect(rows: DataFrame, kind: str, expected: DataFrame | int | None = None) -> bool:
    """Whether a result set equals, contains, exists or counts as expected."""
    if kind == "exists":
        return not rows.isEmpty()
    if kind == "count_eq":
        return rows.count() == expected
    lost = expected.subtract(rows).isEmpty()
    if kind == "contains":
        return lost
    if kind == "set_equals":
        return lost and rows.subtract(expected).isEmpty()
    raise RuleError(f"unknown expectation: {kind}")


# rule variants


def disable(where: Any, places: Sequence[tuple[int, int]]) -> Body:
    """The body without some atoms, each named by branch and place."""
    body = parse(where)
    for b, k in places:
        if not (0 <= b < len(body.branches) and 0 <= k < len(body.branches[b])):
            raise RuleError(f"there is no atom {(b, k)}")
    return parse(Body(tuple(tuple(a for k, a in enumerate(br) if (b, k) not in set(places)) for b, br in enumerate(body.branches))))


def replace_literal(where: Any, branch: int, place: int, old: Any, new: Any) -> Body:
    """The body with a literal of one atom replaced by another of its type."""
    body = parse(where)
    if type(old) is not type(new):
        raise RuleError("a literal is replaced by one of its type")
    try:
        atom = body.branches[branch][place]
    except IndexError:
        raise RuleError(f"there is no atom {(branch, place)}") from None

    def swap(t: Any) -> Any:
        return new if type(t) is type(old) and t == old else t

    match atom:
        case Pred(name, terms):
            changed = Pred(name, tuple(map(swap, terms)))
        case Cmp(op, left, right):
            changed = Cmp(op, swap(left), swap(right))
        case _:
            values = getattr(atom, "values", None)
            if values is None:
                raise RuleError("this atom has no literal to replace")
            changed = type(atom)(atom.var, tuple(map(swap, values)))
    if changed == atom:
        raise RuleError(f"the atom does not hold {old!r}")
    branches = [list(b) for b in body.branches]
    branches[branch][place] = changed
    return parse(Body(tuple(map(tuple, branches))))


def add_conditions(where: Any, extra: Mapping[int, Sequence[Any]]) -> Body:
    """The body with atoms added at the end of some branches."""
    body = parse(where)
    if any(not 0 <= b < len(body.branches) for b in extra):
        raise RuleError("there is no such branch")
    more = {b: parse(list(body.branches[b]) + list(atoms)).branches[0] for b, atoms in extra.items()}
    return parse(Body(tuple(more.get(b, br) for b, br in enumerate(body.branches))))


def compare_rule(facts: FactSpace, where: Any, variant: Any, select: list[str]) -> DataFrame:
    return diff(evaluate(facts, where, select), evaluate(facts, variant, select))
