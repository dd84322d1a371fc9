"""Why and why not: witnesses, checks of one binding, and where a body stops holding."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compile import Compiler, Env, FactSpace, evaluate
from .ir import Body, Cmp, RuleError, atoms_vars, parse

Resolve = Callable[[str, str], DataFrame] | None


def witnesses(facts: FactSpace, where: Any, select: list[str] | None = None, *, first: bool = True, resolve: Resolve = None) -> DataFrame:
    """Solutions with ``case`` and ``witnesses``: the branch that holds and the assertions it used.

    With ``first`` each solution has its lowest branch and, of that, the first witnesses in
    order; otherwise all branches that hold, as ``cases``.
    """
    rows = evaluate(facts, where, select, resolve=resolve, witness=True)
    keys = [c for c in rows.columns if c not in ("_case", "_w")]
    if first:
        best = rows.groupBy(*keys).agg(F.min(F.struct("_case", "_w")).alias("_b"))
        return best.select(*keys, F.col("_b._case").alias("case"), F.col("_b._w").alias("witnesses"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("_case")).alias("cases"))


def _fixed(body: Body, binding: Mapping[str, Any]) -> Body:
    """The body with variables set from the start, so that scans are filtered by them."""
    unknown = set(binding) - {v for b in body.branches for v in atoms_vars(b)}
    if unknown:
        raise RuleError(f"the body has no {sorted(unknown)}")
    return Body(tuple((*(Cmp("eq", v, x) for v, x in binding.items()), *b) for b in body.branches))


def check_binding(facts: FactSpace, where: Any, binding: Mapping[str, Any], resolve: Resolve = None) -> DataFrame:
    """The solutions with this binding, at most one: an empty result is a no."""
    return evaluate(facts, _fixed(parse(where), binding), resolve=resolve, distinct=False).limit(1)


def frontier(facts: FactSpace, where: Any, binding: Mapping[str, Any] | None = None, resolve: Resolve = None) -> DataFrame:
    """(case, condition, solutions): how many solutions remain after each atom of each branch.

    Each count is an aggregation over a prefix of the same plan, in one result.
    """
    body = parse(where)
    n = len(binding or {})
    fixed = _fixed(body, binding or {})
    parts = []
    for case, atoms in enumerate(fixed.branches):
        compiler = Compiler(facts, resolve)
        env = compiler.run(atoms[:n]) if n else None
        for place in range(n, len(atoms)):
            env = compiler.run(atoms[place : place + 1], env)
            parts.append(compiler.frame(env).agg(F.count("*").alias("solutions")).select(F.lit(case).alias("case"), F.lit(place - n).alias("condition"), "solutions"))
    return reduce(DataFrame.unionByName, parts)


def diagnose(facts: FactSpace, where: Any, binding: Mapping[str, Any] | None = None, resolve: Resolve = None) -> DataFrame:
    """(status, case, failed_condition, held): the branch that holds, or that got furthest.

    Of branches that fail, the one with most conditions held before the first failure is
    named, then the lowest.
    """
    rows = frontier(facts, where, binding, resolve)
    body = parse(where)
    sizes = F.create_map(*[x for k, b in enumerate(body.branches) for x in (F.lit(k), F.lit(len(b)))])
    first = rows.where("solutions = 0").groupBy("case").agg(F.min("condition").alias("failed"))
    cases = rows.select("case").distinct().join(first, "case", "left")
    cases = cases.withColumn("held", F.coalesce(F.col("failed"), sizes[F.col("case")]))
    best = cases.agg(F.min(F.struct(F.col("failed").isNotNull().alias("fails"), (-F.col("held")).alias("n"), "case", "failed", "held")).alias("b"))
    return best.select(F.when(F.col("b.fails"), F.lit("failed")).otherwise(F.lit("passed")).alias("status"), F.col("b.case").alias("case"), F.col("b.failed").alias("failed_condition"), F.col("b.held").alias("held"))


def why_not(facts: FactSpace, where: Any, universe: DataFrame, resolve: Resolve = None) -> DataFrame:
    """Each row of a finite universe (columns named as variables) with ``status``, ``case`` and ``failed_condition``.

    All rows are followed at once: the universe is joined through each branch, and a row's
    place of failure is the first atom after which none of its solutions is left.
    """
    body = parse(where)
    keys = universe.columns
    universe = universe.distinct()
    results = []
    for case, atoms in enumerate(body.branches):
        kinds = {f"${c}": universe.schema[c].dataType for c in keys}
        compiler = Compiler(facts, resolve)
        env = Env(universe, kinds, None)
        alive = []
        for place, atom in enumerate(atoms):
            env = compiler.run((atom,), env)
            alive.append(compiler.frame(env).select(*[F.col(f"`{k}`") for k in keys]).distinct().withColumn("_at", F.lit(place + 1)))
        reached = reduce(DataFrame.unionByName, alive).groupBy(*keys).agg(F.max("_at").alias("held"))
        tagged = reached.withColumnsRenamed({k: f"_{k}" for k in keys})
        joined = universe.join(tagged, [F.col(f"`{k}`") == F.col(f"`_{k}`") for k in keys], "left")
        held = F.coalesce("held", F.lit(0))
        results.append(joined.select(*keys, F.lit(case).alias("case"), held.alias("held"), (held == len(atoms)).alias("ok")))
    every = reduce(DataFrame.unionByName, results)
    best = every.groupBy(*keys).agg(F.min(F.struct((~F.col("ok")).alias("bad"), (-F.col("held")).alias("n"), "case")).alias("b"))
    return best.select(*keys, F.when(F.col("b.bad"), F.lit("failed")).otherwise(F.lit("passed")).alias("status"), F.col("b.case").alias("case"), F.when(F.col("b.bad"), -F.col("b.n")).cast("int").alias("failed_condition"))


def evidence_tree(facts: FactSpace, where: Any, binding: Mapping[str, Any], resolve: Resolve = None) -> dict:
    """One binding's branches and conditions, each holds, fails or not_reached; for reading, so it is small."""
    rows = {(r["case"], r["condition"]): r["solutions"] for r in frontier(facts, where, binding, resolve).collect()}
    branches = []
    for case, atoms in enumerate(parse(where).branches):
        states, failed = [], False
        for k, atom in enumerate(atoms):
            states.append({"condition": repr(atom), "state": "not_reached" if failed else "holds" if rows[case, k] else "fails"})
            failed |= not rows[case, k]
        branches.append({"case": case, "holds": not failed, "conditions": states})
    return {"binding": dict(binding), "holds": any(b["holds"] for b in branches), "branches": branches}


def narrate(tree: dict) -> str:
    """An evidence tree as plain lines."""
    lines = [f"{'holds' if tree['holds'] else 'does not hold'} for {tree['binding']}"]
    for b in tree["branches"]:
        lines.append(f"  branch {b['case']}: {'holds' if b['holds'] else 'fails'}")
        lines += [f"    {c['state']:<11} {c['condition']}" for c in b["conditions"]]
    return "\n".join(lines)


def recheck(rows: DataFrame, facts: FactSpace) -> DataFrame:
    """Solutions with witnesses, and ``stands``: whether all assertions they used are still in the facts."""
    ids = reduce(DataFrame.union, [facts[n].select(F.col("_asrt").cast("string").alias("assertion")) for n in facts.names() if "_asrt" in facts[n].columns]).distinct()
    keys = [c for c in rows.columns if c not in ("case", "witnesses")]
    used = rows.select(*keys, F.explode("witnesses.assertion").alias("assertion")).where("assertion IS NOT NULL")
    lost = used.join(ids, "assertion", "left_anti").select(*keys).distinct().withColumnsRenamed({k: f"_{k}" for k in keys}).withColumn("_lost", F.lit(True))
    on: list[Column] = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_{k}`")) for k in keys]
    return rows.join(lost, on, "left").select(*rows.columns, F.col("_lost").isNull().alias("stands"))


def proof_diff(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per key: added, removed, changed or same, between two sets of frames."""
    others = [c for c in before.columns if c not in key]
    a = before.select(*key, F.struct(*others).alias("old"))
    b = after.select(*[F.col(k).alias(f"_{k}") for k in key], F.struct(*others).alias("new"))
    both = a.join(b, [F.col(k) == F.col(f"_{k}") for k in key], "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return both.select(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in key], state.alias("change"))


def explain_columns(rows: DataFrame) -> DataFrame:
    """Witnesses as one row per assertion used."""
    return rows.select(*[c for c in rows.columns if c != "witnesses"], F.explode("witnesses").alias("w")).select("*", "w.condition", "w.predicate", "w.assertion").drop("w")


__all__ = ["check_binding", "diagnose", "evidence_tree", "explain_columns", "frontier", "narrate", "proof_diff", "recheck", "why_not", "witnesses"]
