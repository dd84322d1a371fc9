"""Declared schemas: entities, fields and relationships as typed predicates.

A schema is declared once and only grows.  It fixes a Spark type for every argument, so no
reader ever infers one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .plans.ir import RuleError

#: Type tags and the Spark types of their values; times are epoch nanoseconds (fixed values).
SPARK_TYPES: dict[str, T.DataType] = {
    "entity_ref": T.StringType(),
    "string": T.StringType(),
    "int": T.LongType(),
    "float64": T.DoubleType(),
    "bool": T.BooleanType(),
    "bytes": T.BinaryType(),
    "time": T.LongType(),
    "uuid": T.StringType(),
}


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


@dataclass(frozen=True)
class PredicateSpec:
    """A relation: argument tags, whether one value per group wins, and the group's arguments."""

    name: str
    args: tuple[str, ...]
    cardinality: str = "single"
    group: tuple[int, ...] = (0,)
    owner: str | None = None
    field: str | None = None
    role: str = "field"  # field, identity, exists, relationship
    enum: tuple = ()
    pattern: str | None = None

    def __post_init__(self) -> None:
        if not self.args or any(a not in SPARK_TYPES for a in self.args):
            raise RuleError(f"{self.name}: arguments must have known tags")
        if self.cardinality not in ("single", "multi"):
            raise RuleError(f"{self.name}: cardinality is single or multi")
        if list(self.group) != sorted(set(self.group)) or any(not 0 <= g < len(self.args) for g in self.group):
            raise RuleError(f"{self.name}: group places must rise and exist")
        if self.enum and self.args[-1] == "float64":
            raise RuleError(f"{self.name}: a float64 field has no enum")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f"a{k}", SPARK_TYPES[a]) for k, a in enumerate(self.args)])


@dataclass(frozen=True)
class Entity:
    """An entity type with identity fields and fields, as (name, tag) or (name, tag, cardinality)."""

    name: str
    identity: tuple[tuple[str, str], ...]
    fields: tuple[tuple, ...] = ()

    def predicates(self) -> list[PredicateSpec]:
        own = snake(self.name)
        out = [PredicateSpec(f"{self.name}:exists", ("entity_ref",), "single", (0,), self.name, None, "exists")]
        out += [PredicateSpec(f"{own}:{n}", ("entity_ref", t), "single", (0,), self.name, n, "identity") for n, t in self.identity]
        out += [PredicateSpec(f"{own}:{f[0]}", ("entity_ref", f[1]), f[2] if len(f) > 2 else "single", (0,), self.name, f[0]) for f in self.fields]
        return out


@dataclass(frozen=True)
class Relationship:
    """A field between two entities with a value: a ternary predicate, one value per pair."""

    name: str
    fields: tuple[tuple[str, str], ...]

    def predicates(self) -> list[PredicateSpec]:
        return [PredicateSpec(f"{snake(self.name)}:{n}", ("entity_ref", "entity_ref", t), "single", (0, 1), self.name, n, "relationship") for n, t in self.fields]


@dataclass
class Schema:
    entities: tuple[Entity, ...] = ()
    relationships: tuple[Relationship, ...] = ()
    extra: tuple[PredicateSpec, ...] = ()
    _by_name: dict[str, PredicateSpec] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        specs = [p for o in (*self.entities, *self.relationships) for p in o.predicates()] + list(self.extra)
        self._by_name = {p.name: p for p in specs}
        if len(self._by_name) != len(specs):
            raise RuleError("a predicate is declared twice")
        for e in self.entities:
            if not e.identity:
                raise RuleError(f"{e.name} has no identity")

    def __getitem__(self, name: str) -> PredicateSpec:
        if name not in self._by_name:
            raise RuleError(f"unknown predicate: {name}")
        return self._by_name[name]

    def predicates(self) -> list[PredicateSpec]:
        return [self._by_name[n] for n in sorted(self._by_name)]

    def to_json(self) -> str:
        """Canonical text: sorted keys, no blanks."""
        rows = [{k: v for k, v in vars(p).items() if v not in (None, ())} for p in self.predicates()]
        return json.dumps({"predicates": rows}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def digest(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def extended(self, entities: Sequence[Entity] = (), relationships: Sequence[Relationship] = (), extra: Sequence[PredicateSpec] = ()) -> Schema:
        """A schema with more in it; nothing may change, and no entity gains identity fields."""
        new_e = {e.name: e for e in self.entities} | {e.name: e for e in entities}
        new_r = {r.name: r for r in self.relationships} | {r.name: r for r in relationships}
        for old in self.entities:
            if new_e[old.name].identity != old.identity:
                raise RuleError(f"the identity of {old.name} cannot change")
        for old in self.relationships:
            if new_r[old.name].fields != old.fields:
                raise RuleError(f"{old.name} cannot gain or change relationship fields")
        out = Schema(tuple(new_e.values()), tuple(new_r.values()), (*self.extra, *extra))
        for p in self.predicates():
            if out._by_name.get(p.name) != p:
                raise RuleError(f"{p.name} cannot change or go")
        return out
