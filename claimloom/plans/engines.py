"""Evaluators by name, and profiles that say how a body is run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame

from ..operators.paths import limited
from ..operators.uncertain import rule_probability, world_probability
from .compile import FactSpace, evaluate
from .ir import Agg, Arith, Body, Cmp, Not, Ref, RuleError, parse


class Evaluator(Protocol):
    def __call__(self, facts: FactSpace, where: Any, select: Sequence[str], **options: Any) -> DataFrame: ...


def _features(body: Body) -> set[str]:
    """What of rule bodies a body uses."""
    found = {"union"} if len(body.branches) > 1 else set()

    def look(atoms: Sequence[Any]) -> None:
        for a in atoms:
            if isinstance(a, Not):
                found.add("negation")
                for b in a.branches:
                    look(b)
            elif isinstance(a, Ref):
                found.add("reference")
            terms = (a.left, a.right) if isinstance(a, Cmp) else a.args if isinstance(a, Arith) else ()
            for t in terms:
                if isinstance(t, Agg):
                    found.add("aggregate")
                    look(t.where)

    for b in body.branches:
        look(b)
    return found


@dataclass(frozen=True)
class Engine:
    """An evaluator and the features of bodies that it takes."""

    name: str
    run: Callable[..., DataFrame]
    takes: frozenset[str] = frozenset({"union", "negation", "reference", "aggregate"})


@dataclass(frozen=True)
class Profile:
    """How to run: on which engine, with which options, and at most how many rows (more is an error)."""

    engine: str = "spark"
    row_limit: int | None = None
    options: dict[str, Any] = field(default_factory=dict)


class Engines:
    """Engines by name.  ``spark`` evaluates sets; ``proofs`` and ``worlds`` add probabilities."""

    def __init__(self) -> None:
        self._by_name: dict[str, Engine] = {}
        self.register(Engine("spark", lambda facts, where, select, **o: evaluate(facts, where, list(select), **o)))
        self.register(Engine("proofs", lambda facts, where, select, **o: rule_probability(facts, where, list(select), **o), frozenset({"union", "reference"})))
        self.register(Engine("worlds", lambda facts, where, select, **o: world_probability(facts, where, list(select), **o), frozenset({"union", "negation", "aggregate"})))

    def register(self, engine: Engine) -> None:
        if engine.name in self._by_name:
            raise RuleError(f"there is an engine {engine.name}")
        self._by_name[engine.name] = engine

    def capabilities(self) -> dict[str, list[str]]:
        return {n: sorted(e.takes) for n, e in sorted(self._by_name.items())}

    def able(self, where: Any) -> list[str]:
        """Engines that take a body."""
        needs = _features(parse(where))
        return sorted(n for n, e in self._by_name.items() if needs <= e.takes)

    def run(self, facts: FactSpace, where: Any, select: Sequence[str], profile: Profile | None = None) -> DataFrame:
        """Evaluate on the profile's engine; what it cannot do is refused before anything runs."""
        p = profile or Profile()
        if p.engine not in self._by_name:
            raise RuleError(f"unknown engine: {p.engine}")
        engine = self._by_name[p.engine]
        if lost := _features(parse(where)) - engine.takes:
            raise RuleError(f"{p.engine} does not take {sorted(lost)}")
        rows = engine.run(facts, where, select, **p.options)
        return rows if p.row_limit is None else limited(rows, p.row_limit)
