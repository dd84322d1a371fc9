"""Uncertainty and time: probabilities over lineage, interval fixpoints, temporal bins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta
from decimal import Decimal
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ceil_bin, floor_bin
from ..plans.compile import FactSpace, column_of, evaluate
from ..plans.ir import Agg, Arith, Body, Cmp, Not, Pred, Ref, RuleError, atoms_vars, parse
from ..sources.shared import materialize

#: Exact counting is exponential in the variables of one answer that share proofs.
MAX_VARIABLES = 24


def fact_probability(facts: DataFrame, annotations: DataFrame, bound_policy: str = "reject", fallback: float | None = None) -> DataFrame:
    """Add ``p`` to facts (asrt_id): the last probability of the engine's own namespace, else of ``shared``, else a point of the bound, else 1.

    Booleans are passed over.  A probability outside (0, 1] raises when the row is read.
    """
    own = annotations.where("category = 'semantic' AND key = 'probability' AND kind <> 'bool'")
    rank = F.when(F.col("namespace") == "problog", 2).when(F.col("namespace") == "shared", 1)
    said = own.withColumn("_r", rank).where("_r IS NOT NULL").groupBy("asrt_id").agg(F.max_by("value", F.struct("_r", "seq")).alias("_p"))
    bounds = annotations.where("category = 'semantic' AND key = 'bound'").groupBy("asrt_id").agg(F.max_by("value", "seq").alias("_bound"))
    out = facts.join(said, "asrt_id", "left").join(bounds, "asrt_id", "left")
    limits = F.from_json("_bound", "array<double>")
    point = point_of_bound(F.get(limits, F.lit(0)), F.get(limits, F.lit(1)), bound_policy, fallback)
    p = F.coalesce(F.col("_p").cast("double"), F.when(F.col("_bound").isNotNull(), point), F.lit(1.0))
    ok = (p > 0) & (p <= 1)
    bad = F.raise_error(F.concat(F.lit("probability out of range for "), F.col("asrt_id"))).cast("double")
    return out.withColumn("p", F.when(ok, p).otherwise(bad)).drop("_p", "_bound")


def point_of_bound(low: Column, high: Column, policy: str, fallback: float | None = None) -> Column:
    """A probability from an interval: lower, midpoint, upper, identity_probability (equal ends only) or reject."""
    refuse = F.lit(fallback) if fallback is not None else F.raise_error(F.lit("a bound is no probability")).cast("double")
    match policy:
        case "lower":
            return low
        case "upper":
            return high
        case "midpoint":
            return (low + high) / 2
        case "identity_probability":
            return F.when(low == high, low).otherwise(refuse)
        case "reject":
            return refuse
    raise RuleError(f"unknown bound policy: {policy}")


def disjunction(proofs: Sequence[frozenset], p: dict, exclusive: dict | None = None) -> float:
    """Probability that at least one proof (a set of facts) holds, exactly.

    Facts are independent, but of facts in one group of ``exclusive`` (fact -> group) at most
    one holds.  Expands on one fact at a time and splits what no longer shares facts.
    """
    group = exclusive or {}

    def solve(ps: frozenset[frozenset], budget: int) -> float:
        if frozenset() in ps:
            return 1.0
        if not ps:
            return 0.0
        ps = frozenset(x for x in ps if not any(y < x for y in ps))  # a proof with more facts adds nothing
        parts: list[set] = []
        for proof in ps:
            names = {group.get(f, f) for f in proof}
            hit = [c for c in parts if c & names]
            parts = [c for c in parts if c not in hit] + [names.union(*hit)]
        if len(parts) > 1:
            miss = 1.0
            for c in parts:
                miss *= 1 - solve(frozenset(x for x in ps if {group.get(f, f) for f in x} & c), budget)
            return 1 - miss
        if budget == 0:
            raise RuleError(f"an answer's proofs share more than {MAX_VARIABLES} facts")
        count: dict = {}
        for proof in ps:
            for f in proof:
                count[f] = count.get(f, 0) + 1
        pick = max(sorted(count, key=str), key=count.get)
        if pick in group:
            arms = [f for f in count if group.get(f) == group[pick]]
        else:
            arms = [pick]
        total, rest = 0.0, 1.0
        for arm in arms:  # this arm holds, the others of its group do not
            others = set(arms) - {arm}
            total += p[arm] * solve(frozenset(x - {arm} for x in ps if not x & others), budget - 1)
            rest -= p[arm]
        return total + rest * solve(frozenset(x for x in ps if not x & set(arms)), budget - 1)

    return solve(frozenset(map(frozenset, proofs)), MAX_VARIABLES)


def answer_probability(proofs: DataFrame, keys: Sequence[str], exclusive: bool = False) -> DataFrame:
    """(keys, p) from proofs (keys, proof id ``proof``, fact ``fact``, its probability ``p``[, ``choice``]).

    Where no fact is in two proofs of an answer, the proofs are independent and a product of
    built-in aggregations is exact.  Only answers whose proofs share facts are counted in
    Python, one answer at a time; one with more than MAX_VARIABLES shared facts raises, and
    nothing is estimated.  With ``exclusive`` facts with one ``choice`` exclude each other.
    """
    shared = proofs.groupBy(*keys, "fact").agg(F.count_distinct("proof").alias("n")).where("n > 1").select(*keys).distinct()
    if exclusive:
        shared = shared.union(proofs.where("choice IS NOT NULL").select(*keys)).distinct()
    hard = proofs.join(shared, list(keys), "left_semi")
    easy = proofs.join(shared, list(keys), "left_anti")
    per = easy.groupBy(*keys, "proof").agg(F.product(F.col("p")).alias("q"))
    simple = per.groupBy(*keys).agg((1 - F.product(1 - F.col("q"))).alias("p"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        p = dict(zip(pdf["fact"], pdf["p"], strict=True))
        group = {f: c for f, c in zip(pdf["fact"], pdf["choice"], strict=True) if c is not None and c == c} if exclusive else None
        sets = [frozenset(g) for _, g in pdf.groupby("proof")["fact"]]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "p": disjunction(sets, p, group)}])

    schema = ", ".join(f"`{k}` {proofs.schema[k].dataType.simpleString()}" for k in keys) + ", p double"
    return simple.unionByName(hard.groupBy(*keys).applyInPandas(solve, schema))


def rule_probability(facts: FactSpace, where: Any, select: list[str], resolve: Callable[[str, str], DataFrame] | None = None, case_probabilities: Sequence[float] | None = None) -> DataFrame:
    """Probability of each answer of a body over facts with ``_asrt`` and ``_p``; facts without are certain.

    Each solution is a proof, the set of assertions that it used.  With ``case_probabilities``, one
    in (0, 1] per branch, a proof also needs a chance of its own: one for each branch and
    binding of all its variables, independent of all others.  Negation and aggregates
    over uncertain facts are refused: a witness does not show what they depend on.
    """
    body = parse(where)
    for atom in (a for b in body.branches for a in b):
        terms = (atom.left, atom.right) if isinstance(atom, Cmp) else getattr(atom, "args", ())
        if isinstance(atom, Not) or any(isinstance(t, Agg) for t in terms):
            raise RuleError("negation and aggregates have no probability here")
    chances = [1.0] * len(body.branches) if case_probabilities is None else list(case_probabilities)
    if len(chances) != len(body.branches) or any(isinstance(c, bool) or not 0 < c <= 1 for c in chances):
        raise RuleError("case probabilities are one number in (0, 1] per branch")
    keys = [column_of(v) for v in select]
    used_facts = F.filter(F.transform("_w", lambda w: w["assertion"]), lambda a: a.isNotNull())
    parts, known = [], []
    for case, (atoms, chance) in enumerate(zip(body.branches, chances, strict=True)):
        every = sorted(set(select) | set(atoms_vars(atoms))) if chance < 1 else select
        rows = evaluate(facts, Body((atoms,)), every, resolve=resolve, witness=True)
        proof = used_facts
        if chance < 1:
            ground = F.concat(F.lit(f"case {case} "), F.to_json(F.struct(*[column_of(v) for v in every]), {"ignoreNullFields": "false"}))
            proof = F.concat(proof, F.array(ground))
            known.append(rows.select(ground.alias("fact"), F.lit(chance).alias("p")).distinct())
        parts.append(rows.select(*keys, F.array_sort(F.array_distinct(proof)).alias("facts")))
    rows = reduce(DataFrame.unionByName, parts).distinct()
    known += [facts[n].select(F.col("_asrt").cast("string").alias("fact"), F.col("_p").cast("double").alias("p")) for n in facts.names() if {"_asrt", "_p"} <= set(facts[n].columns)]
    certain = rows.select(*keys).distinct().withColumn("p", F.lit(1.0))
    if not known:
        return certain
    p = reduce(DataFrame.unionByName, known).where("p < 1").dropDuplicates(["fact"])
    used = rows.select(*keys, F.to_json("facts").alias("proof"), F.explode("facts").alias("fact")).join(p, "fact")
    # a proof that uses no uncertain fact makes its answer certain
    sure = rows.select(*keys, F.to_json("facts").alias("proof")).join(used.select(*keys, "proof").distinct(), [*keys, "proof"], "left_anti").select(*keys).distinct()
    open_ = answer_probability(used.join(sure, keys, "left_anti"), keys)
    return open_.unionByName(sure.withColumn("p", F.lit(1.0)))


#: So many uncertain facts at most are counted out world by world.
MAX_WORLD_FACTS = 12
_WORLD = "$world of facts"


def world_probability(facts: FactSpace, where: Any, select: list[str]) -> DataFrame:
    """Probability of each answer of any body, also with negation and aggregates, by all worlds of its uncertain facts.

    Facts with ``_p`` below 1 are independent.  Relations that have some get the number of a world as one
    more argument, shared by all atoms of the body, so one plan evaluates all worlds side by side; an
    answer's probability is the sum over the worlds that give it.  More than ``MAX_WORLD_FACTS``
    uncertain facts in the relations that the body names are refused: nothing is estimated.
    """
    body = parse(where)
    names = sorted(set(_names(body.branches)))
    chances: list[tuple[str, str, float]] = []
    for n in names:
        if {"_asrt", "_p"} <= set(facts[n].columns):
            rows = facts[n].where("_p < 1").select("_asrt", "_p").distinct().limit(MAX_WORLD_FACTS + 1).collect()
            chances += [(n, str(r["_asrt"]), float(r["_p"])) for r in rows]
    chances.sort()
    if len(chances) > MAX_WORLD_FACTS:
        raise RuleError(f"the body names more than {MAX_WORLD_FACTS} uncertain facts")
    count = 1 << len(chances)
    spark = facts.spark
    each = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_world")
    moved: dict[str, DataFrame] = {}
    for n in {n for n, _, _ in chances}:
        bits = F.create_map(*[F.lit(x) for k, (m, asrt, _) in enumerate(chances) if m == n for x in (asrt, k)])
        rows = facts[n].withColumn("_bit", F.when(F.col("_p") < 1, F.try_element_at(bits, F.col("_asrt").cast("string"))))
        args = facts.args(n)
        rows = rows.select(*[F.col(f"`{c}`") for c in args], "_bit", each)
        moved[n] = rows.where(F.col("_bit").isNull() | (F.getbit(F.col("_world").cast("long"), F.col("_bit")) == 1)).drop("_bit")
    worlds = spark.range(count).select(F.col("id").cast("int").alias("_world"))
    weight = reduce(lambda a, b: a * b, [F.when(F.getbit(F.col("_world").cast("long"), F.lit(k)) == 1, p).otherwise(1 - p) for k, (_, _, p) in enumerate(chances)], F.lit(1.0))
    space = facts.with_relations({**moved, _WORLD: worlds})
    branches = tuple((Pred(_WORLD, (_WORLD,)), *(_in_world(a, set(moved)) for a in b)) for b in body.branches)
    rows = evaluate(space, Body(branches), [*select, _WORLD])
    keys = [column_of(v) for v in select]
    weighed = rows.withColumnRenamed(column_of(_WORLD), "_world").withColumn("_weight", weight)
    return weighed.groupBy(*keys).agg(F.sum("_weight").alias("p"))


def _names(branches: Any):
    for atom in (a for b in branches for a in b):
        if isinstance(atom, Pred):
            yield atom.name
        elif isinstance(atom, Not):
            yield from _names(atom.branches)
        elif isinstance(atom, Ref):
            raise RuleError("worlds take no references to rules")
        for t in _operands(atom):
            if isinstance(t, Agg):
                yield from _names((t.where,))


def _operands(atom: Any) -> tuple:
    return (atom.left, atom.right) if isinstance(atom, Cmp) else atom.args if isinstance(atom, Arith) else ()


def _in_world(atom: Any, moved: set[str]) -> Any:
    """The atom with the world as one more argument of relations that differ between worlds."""

    def term(t: Any) -> Any:
        return Agg(t.kind, t.target, tuple(_in_world(a, moved) for a in t.where)) if isinstance(t, Agg) else t

    match atom:
        case Pred(name, terms) if name in moved:
            return Pred(name, (*terms, _WORLD))
        case Not(branches):
            return Not(tuple(tuple(_in_world(a, moved) for a in b) for b in branches))
        case Cmp(op, left, right):
            return Cmp(op, term(left), term(right))
        case Arith(op, out, args):
            return Arith(op, out, tuple(map(term, args)))
    return atom


def weighted_choice(arms: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Probability of each answer of a choice between arms (keys, ``arm``): the weights of its distinct arms.

    Weights are decimal texts that sum to exactly 1.
    """
    exact = [Decimal(w) for w in weights]
    if sum(exact) != 1 or any(w <= 0 for w in exact):
        raise RuleError("weights must be above 0 and sum to exactly 1")
    weight = F.element_at(F.array(*[F.lit(str(w)).cast("decimal(38,18)") for w in exact]), F.col("arm") + 1)
    return arms.select(*keys, "arm").distinct().groupBy(*keys).agg(F.sum(weight).cast("double").alias("p"))


# intervals


@dataclass(frozen=True)
class IntervalRule:
    """head(x) gets [low, high] ``delay`` steps after body nodes reach it over an edge kind."""

    body: str
    edge: str
    head: str
    low: float
    high: float
    threshold: float = 0.0
    delay: int = 1


def interval_fixpoint(nodes: DataFrame, edges: DataFrame, rules: Sequence[IntervalRule], steps: int) -> DataFrame:
    """(node, label, lo, hi, step): what the rules derive, first derivations only.

    ``nodes`` has node, label, lo, hi, from, to; ``edges`` source, target, kind.  A rule fires
    at a step for neighbours whose interval starts at its threshold or above.  Inputs, and
    [0, 0], are not results.  Each step is a written table, so lineage stays short.
    """
    edges = materialize(edges.select("source", "target", "kind"), "edges")
    given = nodes.select("node", "label").distinct()
    seen = materialize(nodes.select("node", "label", "lo", "hi", F.col("from").cast("int").alias("start"), F.col("to").cast("int").alias("stop"), F.lit(0).alias("step")), "intervals")
    for t in range(steps):
        now = seen.where((F.col("start") <= t) & (F.col("stop").isNull() | (F.col("stop") >= t)))
        found = []
        for r in rules:
            if t + r.delay > steps:
                continue
            hits = now.where((F.col("label") == r.body) & (F.col("lo") >= r.threshold)).join(edges.where(F.col("kind") == r.edge), F.col("node") == F.col("source"))
            found.append(hits.select(F.col("target").alias("node"), F.lit(r.head).alias("label"), F.lit(r.low).alias("lo"), F.lit(r.high).alias("hi"), F.lit(t + r.delay).alias("start"), F.lit(None).cast("int").alias("stop"), F.lit(t + r.delay).alias("step")).distinct())
        if not found:
            continue
        fresh = reduce(DataFrame.unionByName, found).groupBy("node", "label").agg(F.min_by(F.struct("lo", "hi", "start", "stop", "step"), "step").alias("x")).select("node", "label", "x.*")
        seen = materialize(seen.unionByName(fresh.join(seen.select("node", "label"), ["node", "label"], "left_anti")), "intervals")
    out = seen.where("step >= 1 AND NOT (lo = 0 AND hi = 0)").join(given, ["node", "label"], "left_anti")
    return out.select("node", "label", "lo", "hi", "step")


@dataclass(frozen=True)
class IntervalClause:
    """head(vars) gets an interval ``delay`` steps after all atoms of a branch hold within their bounds.

    ``where`` is a body of positive predicates.  An atom holds while its fact's interval lies within
    ``body_bounds`` of its predicate (else [1, 1]); the head's interval is that of the branch in
    ``branch_bounds``, else ``bound``.
    """

    head: str
    select: tuple[str, ...]
    where: Any
    bound: tuple[float, float] = (1.0, 1.0)
    branch_bounds: dict[int, tuple[float, float]] | None = None
    body_bounds: dict[str, tuple[float, float]] | None = None
    delay: int = 1


def interval_program(facts: dict[str, DataFrame], rules: Sequence[IntervalClause], steps: int) -> dict[str, DataFrame]:
    """What the rules derive, per head: its arguments ``a0 ..``, lo, hi, step.

    ``facts`` have arguments ``a0 ..``, lo, hi and the steps ``from`` and ``to`` (null: for ever) in which they
    hold.  Of an atom that several derivations reach at once the first stays, then the lowest interval.
    Given atoms, and [0, 0], are not results.  Each step is a written table.
    """
    for r in rules:
        for atom in (a for b in parse(r.where).branches for a in b):
            if not isinstance(atom, Pred):
                raise RuleError("interval rules take positive predicates only")
        if r.delay < 0:
            raise RuleError("a delay is no less than 0")
    spark = next(iter(facts.values())).sparkSession
    known = {n: materialize(df.select(*_args(df), "lo", "hi", F.col("from").cast("int").alias("start"), F.col("to").cast("int").alias("stop"), F.lit(0).alias("step")), "intervals") for n, df in facts.items()}
    for t in range(steps + 1):
        fresh: dict[str, list[DataFrame]] = {}
        for r in rules:
            if t + r.delay > steps or t + max(r.delay, 1) > steps:
                continue
            limits = r.body_bounds or {}
            for k, atoms in enumerate(parse(r.where).branches):
                names = {a.name for a in atoms}
                if not names <= set(known):
                    continue
                now = {}
                for n in names:
                    low, high = limits.get(n, (1.0, 1.0))
                    rows = known[n].where((F.col("start") <= t) & (F.col("stop").isNull() | (F.col("stop") >= t)) & (F.col("lo") >= low) & (F.col("hi") <= high))
                    now[n] = rows.select(*_args(rows)).distinct()
                hits = evaluate(FactSpace(spark, now), Body((atoms,)), list(dict.fromkeys(r.select)))
                lo, hi = (r.branch_bounds or {}).get(k, r.bound)
                at = F.lit(t + max(r.delay, 1))
                cols = [F.col(column_of(v)).alias(f"a{i}") for i, v in enumerate(r.select)]
                fresh.setdefault(r.head, []).append(hits.select(*cols, F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), at.alias("start"), F.lit(None).cast("int").alias("stop"), at.alias("step")))
        for head, found in fresh.items():
            args = _args(found[0])
            new = reduce(DataFrame.unionByName, found).groupBy(*args).agg(F.min(F.struct("step", "lo", "hi", "start", "stop")).alias("x")).select(*args, "x.lo", "x.hi", "x.start", "x.stop", "x.step")
            if head in known:
                new = known[head].unionByName(new.join(known[head].select(*args), args, "left_anti"))
            known[head] = materialize(new, "intervals")
    return {n: df.where("step >= 1 AND NOT (lo = 0 AND hi = 0)").select(*_args(df), "lo", "hi", "step") for n, df in known.items() if any(r.head == n for r in rules)}


def _args(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("a") and c[1:].isdigit()]


# time


def boundary_steps(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Add ``active_from`` and ``active_to``: the places of valid_from and valid_to among all boundaries, as texts.

    No valid_from means the universe's start, no valid_to no end.
    """
    spark = rows.sparkSession
    ends = spark.createDataFrame([(start,), (end,)], "b string")
    begin = F.coalesce("valid_from", F.lit(start))
    all_b = ends.union(rows.select(begin.alias("b"))).union(rows.where("valid_to IS NOT NULL").select("valid_to")).distinct()
    all_b = materialize(all_b, "boundary-texts")
    # places by a two-level count: within ranges by a window, across them by few sums; any ranges give the same places
    n = all_b.count()
    parts = min(1024, 1 + n // 100_000)
    some = sorted(r["b"] for r in all_b.sample(min(1.0, 64 * parts / n), 1).collect())[:: 64] if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(e) for e in some]), lambda e: e < F.col("b"))) if some else F.lit(0)
    all_b = all_b.withColumn("part", part)
    sums = all_b.groupBy("part").agg(F.count("*").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = all_b.join(F.broadcast(base), "part").select("b", (F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("b")) - 1).cast("long").alias("at"))
    placed = materialize(placed, "boundaries")
    out = rows.withColumn("_begin", begin).join(placed.select(F.col("b").alias("_begin"), F.col("at").alias("active_from")), "_begin")
    return out.join(placed.select(F.col("b").alias("valid_to"), F.col("at").alias("active_to")), "valid_to", "left").drop("_begin")


def time_binned(rows: DataFrame, start: Column, end: Column, step: timedelta, begin: str = "valid_from", stop: str = "valid_to") -> DataFrame:
    """Add ``bin_from`` and ``bin_to``: the bin in which a row begins, and the first after its end.

    The universe is a whole number of bins.  A row that begins outside it, ends after it, or
    does not end after it begins, raises when it is read.
    """
    if step <= timedelta(0):
        raise RuleError("a bin has a size")
    b = F.coalesce(F.col(begin), start)
    whole = F.pmod(F.unix_micros(end) - F.unix_micros(start), F.lit(step // timedelta(microseconds=1))) == 0
    wrong = F.when(~whole, "the universe is no whole number of bins").when((b < start) | (b >= end), "begins outside the universe").when(F.col(stop) > end, "ends outside the universe").when(F.col(stop) <= b, "ends before it begins")
    ok = F.when(wrong.isNull(), floor_bin(b, start, step)).otherwise(F.raise_error(wrong).cast("long"))
    return rows.withColumns({"bin_from": ok, "bin_to": F.when(F.col(stop).isNotNull(), ceil_bin(F.col(stop), start, step))})
