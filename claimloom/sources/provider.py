"""External relations: a provider returns whole relations for the predicates it declares."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..plans.compile import FactSpace
from ..plans.ir import RuleError
from ..schema import Schema


def provide(facts: FactSpace, schema: Schema, declared: list[str], provider: Callable[[SparkSession], Mapping[str, DataFrame]]) -> FactSpace:
    """The facts with the provider's relations in place of the stored ones; nothing is unioned.

    The provider must return every declared predicate and no other, with its arguments' types.
    """
    got = dict(provider(facts.spark))
    if sorted(got) != sorted(declared):
        raise RuleError(f"the provider gave {sorted(got)}, not {sorted(declared)}")
    for name, df in got.items():
        want = schema[name].struct()
        args = [f for f in df.schema if f.name != "_asrt"]
        if [f.dataType for f in args] != [f.dataType for f in want]:
            raise RuleError(f"{name}: expected {want.simpleString()}")
        got[name] = df.toDF(*[f.name for f in want], *(["_asrt"] if "_asrt" in df.columns else []))
    return facts.with_relations(got)
