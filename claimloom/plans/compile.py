"""Rule bodies to DataFrames: one column per variable, one row per solution.

Atoms are folded in written order over one lazy DataFrame, so the whole body becomes one
Catalyst plan: predicates are joins on shared variables, comparisons are filters that the
optimizer pushes to the scans, negation is a left anti join and a correlated aggregate is
a grouping joined back.  A predicate that shares no variable but has a number between two
others is joined by cells.  A grouping or negation whose variables its own atoms bind is
compiled by itself, without first collecting the outer keys, so it costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranges
from .ir import DECIMAL, ORDERINGS, Agg, Arith, Atom, Body, Cmp, In, Not, Pred, Ref, RuleError, atoms_vars, check, integer, is_var, parse

WITNESS = "_w"
#: Columns of a relation that are no arguments: the assertion's id and its probability.
HIDDEN = ("_asrt", "_p")
WITNESS_TYPE = "array<struct<case:int,condition:int,predicate:string,assertion:string>>"


def column_of(var: str) -> str:
    """The column that holds a variable."""
    return var[1:]


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def family(kind: T.DataType) -> str:
    """Values of different families are never equal."""
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return kind.typeName()


def literal_family(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (bytes, bytearray)):
        return "binary"
    return "time"


class FactSpace:
    """Relations by predicate name.

    A relation is a DataFrame whose columns are the predicate's arguments in order; a
    column ``_asrt`` with the assertion's id may follow and is kept for witnesses.  Rows with a
    null argument are no facts and never match a variable or literal.

    ``keys`` names arguments that are unique together, for relations that have such.  A body
    whose selected variables include the keys of all that it joins is a set already, and its
    result is not shuffled again to make it one.
    """

    def __init__(self, spark: SparkSession, relations: Mapping[str, DataFrame] | None = None, keys: Mapping[str, tuple[str, ...]] | None = None) -> None:
        self.spark = spark
        self._relations = dict(relations or {})
        self._keys = {n: tuple(k) for n, k in (keys or {}).items()}

    def __contains__(self, name: str) -> bool:
        return name in self._relations

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._relations:
            raise RuleError(f"unknown predicate: {name}")
        return self._relations[name]

    def names(self) -> list[str]:
        return sorted(self._relations)

    def args(self, name: str) -> list[str]:
        return [c for c in self[name].columns if c not in HIDDEN]

    def key(self, name: str) -> tuple[str, ...] | None:
        """Arguments of a relation that are unique together, if they are known."""
        return self._keys.get(name)

    def with_relations(self, relations: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, ...]] | None = None) -> FactSpace:
        """A space in which these relations are added, or stand in for those of the same name."""
        kept = {n: k for n, k in self._keys.items() if n not in relations}
        return FactSpace(self.spark, self._relations | dict(relations), kept | dict(keys or {}))

    def only(self, names: list[str]) -> FactSpace:
        """The named relations alone; an unknown name is an error."""
        return FactSpace(self.spark, {n: self[n] for n in names}, {n: k for n, k in self._keys.items() if n in names})

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: Mapping[str, DataFrame], key: Mapping[str, str] | None = None) -> FactSpace:
        """Ordinary tables as predicates: a table of n columns is an n-ary predicate of its name.

        For tables named in ``key``, which is a unique column, each other column is also a
        binary predicate ``table:column(key, value)``.
        """
        found, keys = dict(tables), {}
        for name, k in (key or {}).items():
            keys[name] = (k,)
            for c in tables[name].columns:
                if c != k:
                    found[f"{name}:{c}"] = tables[name].select(k, c)
                    keys[f"{name}:{c}"] = (k,)
        return cls(spark, found, keys)


@dataclass
class Env:
    """Solutions so far.  ``df`` is None before the first atom: one solution without variables.

    ``key``: variables that tell solutions apart, or None if some may be equal.
    """

    df: DataFrame | None
    vars: dict[str, T.DataType]
    key: frozenset[str] | None = frozenset()

    def with_df(self, df: DataFrame, more: Mapping[str, T.DataType] | None = None) -> Env:
        return Env(df, self.vars | dict(more or {}), self.key)


@dataclass
class Compiler:
    facts: FactSpace
    resolve: Callable[[str, str], DataFrame] | None = None
    witness: bool = False
    _names: count = field(default_factory=count)
    #: Atoms of the branch after the one at hand, and aggregates that were computed with an earlier one.
    _ahead: tuple[Atom, ...] = ()
    _ready: list[tuple[Agg, tuple[Any, ...]]] = field(default_factory=list)

    def fresh(self, what: str) -> str:
        return f"_{what}{next(self._names)}"

    def frame(self, env: Env) -> DataFrame:
        if env.df is not None:
            return env.df
        one = self.facts.spark.range(1).select()
        return one.select(F.array().cast(WITNESS_TYPE).alias(WITNESS)) if self.witness else one

    def run(self, atoms: tuple[Atom, ...], env: Env | None = None, case: int = 0) -> Env:
        env = env or Env(None, {})
        for place, atom in enumerate(atoms):
            self._ahead = atoms[place + 1 :]
            env = self.step(atom, env, case, place)
        self._ahead = ()
        self._ready.clear()
        return env

    def step(self, atom: Atom, env: Env, case: int, place: int) -> Env:
        match atom:
            case Pred(name, terms):
                return self.join(env, self.facts[name], terms, name, case, place, self.facts.key(name))
            case Ref(rule, version, terms):
                if not self.resolve:
                    raise RuleError(f"no rules are at hand for {rule}@{version}")
                derived = self.resolve(rule, version)  # a set, so all its columns are a key
                return self.join(env, derived, terms, f"{rule}@{version}", case, place, tuple(derived.columns))
            case Cmp():
                return self.compare(atom, env)
            case In(var, values):
                same = [v for v in values if literal_family(v) == family(env.vars[var])]
                return env.with_df(self.frame(env).where(_c(column_of(var)).isin(*same) if same else F.lit(False)))
            case Arith():
                return self.arithmetic(atom, env)
            case Not():
                return self.negate(atom, env)
        raise RuleError(f"not an atom: {atom!r}")

    # predicates

    def join(self, env: Env, relation: DataFrame, terms: tuple[Any, ...], name: str, case: int, place: int, unique: tuple[str, ...] | None = None) -> Env:
        args = [c for c in relation.columns if c not in HIDDEN]
        if len(args) != len(terms):
            raise RuleError(f"{name} has {len(args)} arguments, not {len(terms)}")
        kinds = dict(zip(args, (relation.schema[c].dataType for c in args), strict=True))
        tests: list[Column] = []
        first: dict[str, str] = {}
        for arg, term in zip(args, terms, strict=True):
            if not is_var(term):
                tests.append(_c(arg) == F.lit(term) if literal_family(term) == family(kinds[arg]) else F.lit(False))
            elif term in first:
                tests.append(_c(first[term]) == _c(arg) if family(kinds[first[term]]) == family(kinds[arg]) else F.lit(False))
            else:
                first[term] = arg
                tests.append(_c(arg).isNotNull())
        tag = self.fresh("r")
        found = relation.where(reduce(Column.__and__, tests)) if tests else relation
        cols = [_c(arg).alias(column_of(v) if v not in env.vars else f"{tag}_{column_of(v)}") for v, arg in first.items()]
        if self.witness:
            who = F.col("_asrt").cast("string") if "_asrt" in relation.columns else F.lit(None).cast("string")
            one = F.struct(F.lit(case).alias("case"), F.lit(place).alias("condition"), F.lit(name).alias("predicate"), who.alias("assertion"))
            cols.append(F.array(one).cast(WITNESS_TYPE).alias(f"{tag}{WITNESS}"))
        found = found.select(*cols)
        shared = [v for v in first if v in env.vars]
        new = {v: kinds[arg] for v, arg in first.items() if v not in env.vars}
        # one match at most where the relation's key is given; else its variables join the key
        open_ = {t for arg, t in zip(args, terms, strict=True) if unique and arg in unique and is_var(t) and t not in env.vars}
        env = Env(env.df, env.vars, None if env.key is None or unique is None else env.key | open_)
        if env.df is None:
            df = found.withColumnRenamed(f"{tag}{WITNESS}", WITNESS) if self.witness else found
            return env.with_df(df, new)
        if any(family(env.vars[v]) != family(kinds[first[v]]) for v in shared):
            df = env.df.join(found, F.lit(False))
        elif shared:
            df = env.df.join(found, reduce(Column.__and__, [_c(column_of(v)) == _c(f"{tag}_{column_of(v)}") for v in shared]))
        else:
            near = self._within(env, found, new)
            df = env.df.crossJoin(found) if near is None else near  # the rule itself asks for all combinations
        df = df.drop(*[f"{tag}_{column_of(v)}" for v in shared])
        if self.witness:
            df = df.withColumn(WITNESS, F.concat(WITNESS, f"{tag}{WITNESS}")).drop(f"{tag}{WITNESS}")
        return env.with_df(df, new)

    def _within(self, env: Env, found: DataFrame, new: Mapping[str, T.DataType]) -> DataFrame | None:
        """Solutions with the rows found that later comparisons keep, and some more, where those have a
        number of one side between two of the other; None where they don't.  The comparisons still follow."""

        def number(term: Any) -> bool:
            return is_var(term) and isinstance(env.vars.get(term) or new.get(term), T.NumericType)

        order = [(a.left, a.right) if a.op in ("lt", "le") else (a.right, a.left) for a in self._ahead if isinstance(a, Cmp) and a.op in ORDERINGS and number(a.left) and number(a.right)]
        for small, at in order:
            high = next((big for x, big in order if x == at and (big in new) == (small in new)), None)
            if high is None or (small in new) == (at in new):
                continue
            low, at, high = (column_of(v) for v in (small, at, high))
            points, spans = (env.df, found) if small in new else (found, env.df)
            return ranges.by_length(points, spans, at, low, high)
        return None

    # terms

    def term(self, env: Env, term: Any) -> tuple[Env, Column, T.DataType | None, Any]:
        """The environment (an aggregate is joined to it), the term's column, type and literal."""
        if isinstance(term, Agg):
            return self.aggregate(term, env)
        if is_var(term):
            return env, _c(column_of(term)), env.vars[term], None
        col = F.lit(term)
        return env, col.cast("long") if isinstance(term, int) and not isinstance(term, bool) else col, None, term

    def number(self, col: Column, kind: T.DataType | None, literal: Any, op: str) -> Column:
        """A term as something that orders; decimal texts count as numbers, others raise at run time."""
        if kind is None:
            return F.lit(literal) if literal_family(literal) == "time" else F.lit(integer(literal, op))
        what = family(kind)
        if what in ("number", "time"):
            return col
        if what == "string":
            return F.when(col.rlike(f"^(?:{DECIMAL.pattern})$"), col.cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"{op} takes numbers, not "), col)).cast("long"))
        raise RuleError(f"{op} takes numbers, not {kind.simpleString()}")

    def equal(self, a: tuple[Column, T.DataType | None, Any], b: tuple[Column, T.DataType | None, Any]) -> Column:
        kinds = [family(k) if k is not None else literal_family(v) for _, k, v in (a, b)]
        return a[0] == b[0] if kinds[0] == kinds[1] else F.lit(False)

    def compare(self, atom: Cmp, env: Env) -> Env:
        for term, other in ((atom.left, atom.right), (atom.right, atom.left)):
            if atom.op == "eq" and is_var(term) and term not in env.vars:
                env, col, kind, value = self.term(env, other)
                df = self.frame(env).withColumn(column_of(term), col)
                return env.with_df(df, {term: kind or df.schema[column_of(term)].dataType})
        env, *left = self.term(env, atom.left)
        env, *right = self.term(env, atom.right)
        return env.with_df(self.frame(env).where(self.condition(atom.op, tuple(left), tuple(right))))

    def condition(self, op: str, left: tuple, right: tuple) -> Column:
        if op in ORDERINGS:
            a, b = self.number(*left, op), self.number(*right, op)
            return {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op]
        same = self.equal(left, right)
        return same if op == "eq" else ~same

    def arithmetic(self, atom: Arith, env: Env) -> Env:
        cols = []
        for a in atom.args:
            env, *t = self.term(env, a)
            cols.append(self.number(*t, atom.op))
        match atom.op:
            case "add" | "addc":
                result = cols[0] + cols[1]
            case "sub":
                result = cols[0] - cols[1]
            case "mulc":
                result = cols[0] * cols[1]
            case _:
                result = -cols[0]
        name = column_of(atom.out)
        if atom.out in env.vars:
            return env.with_df(self.frame(env).where(self.number(_c(name), env.vars[atom.out], None, atom.op) == result))
        df = self.frame(env).withColumn(name, result)
        if isinstance(df.schema[name].dataType, T.IntegralType):
            df = df.withColumn(name, _c(name).cast("long"))
        return env.with_df(df, {atom.out: df.schema[name].dataType})

    # correlated parts

    def _alone(self, atoms: tuple[Atom, ...], outer: set[str]) -> bool:
        """Whether the atoms bind all that they share with the outside themselves."""
        try:
            bound = check(atoms)
        except RuleError:
            return False
        first_use: set[str] = set()
        for a in atoms:
            if isinstance(a, Pred):
                first_use |= {t for t in a.terms if is_var(t)}
        return outer <= bound and outer <= first_use

    def _inner(self) -> Compiler:
        return Compiler(self.facts, self.resolve, False, self._names)

    def _keys(self, env: Env, outer: list[str]) -> Env:
        if not outer:
            return Env(None, {})
        return Env(self.frame(env).select(*[_c(column_of(v)) for v in outer]).distinct(), {v: env.vars[v] for v in outer}, frozenset(outer))

    def aggregate(self, agg: Agg, env: Env) -> tuple[Env, Column, T.DataType, None]:
        """The value of an aggregate per solution; aggregates over the same atoms share one grouping and one join."""
        outer = self._outer(agg, env)
        known = next((got for a, got in self._ready if a == agg), None)
        if known is None:
            env, made = self._group([agg, *self._alike(agg, outer, env)], outer, env)
            known, *later = made
            self._ready += [(a, got) for a, got in zip(self._alike(agg, outer, env), later, strict=True)]
        name, n, kind, valid = known
        df = self.frame(env)
        if agg.kind not in ("count", "sum"):
            return env.with_df(df.where(F.col(name).isNotNull())), F.col(name), kind, None
        if not valid:  # a sum of what is no number has a value over nothing only
            df = df.where(F.coalesce(F.col(n), F.lit(0)) == 0)
        return env.with_df(df.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast(kind)))), F.col(name), kind, None

    @staticmethod
    def _outer(agg: Agg, env: Env) -> list[str]:
        mentioned = atoms_vars(agg.where) | ({agg.target} if is_var(agg.target) else set())
        return sorted(mentioned & set(env.vars))

    def _alike(self, agg: Agg, outer: list[str], env: Env) -> list[Agg]:
        """Later aggregates of the branch over the same atoms, which no atom in between gives more variables."""
        found = []
        bound = set(env.vars)
        for atom in self._ahead:
            terms = (atom.left, atom.right) if isinstance(atom, Cmp) else atom.args if isinstance(atom, Arith) else ()
            for t in terms:
                if isinstance(t, Agg) and t.where == agg.where and t != agg and t not in found and sorted((atoms_vars(t.where) | ({t.target} if is_var(t.target) else set())) & bound) == outer:
                    found.append(t)
            outside = (*terms, atom.out) if isinstance(atom, Arith) else terms or getattr(atom, "terms", ())
            bound |= {t for t in outside if is_var(t)}
        return found

    def _group(self, aggs: list[Agg], outer: list[str], env: Env) -> tuple[Env, list[tuple[Any, ...]]]:
        """One grouping with all these, joined: (column, column of the number of rows, type, whether values are valid) of each."""
        inner = self._inner()
        alone = self._alone(aggs[0].where, set(outer))
        got = inner.run(aggs[0].where, Env(None, {}) if alone else self._keys(env, outer))
        df = inner.frame(got)
        n = self.fresh("n")
        values, made = [], []
        for agg in aggs:
            kind: T.DataType = T.LongType()
            valid = True
            if agg.kind == "count":
                value = F.count("*")
            else:
                _, col, t, literal = inner.term(got, agg.target)
                what = family(t) if t is not None else literal_family(literal)
                if agg.kind in ("sum", "mean"):
                    valid = what == "number"
                    total = (F.sum(col) if agg.kind == "sum" else F.avg(col)) if valid else F.lit(None).cast("long")
                    floating = t is not None and isinstance(t, (T.FractionalType,)) or isinstance(literal, float)
                    kind = T.DoubleType() if agg.kind == "mean" or floating else T.LongType()
                    value = F.max(total) if not valid else total.cast(kind)
                else:
                    value = F.min(col) if agg.kind == "min" else F.max(col)
                    kind = t if t is not None else df.select(col.alias("x")).schema["x"].dataType
            name = self.fresh("a")
            values.append(value.alias(name))
            made.append((name, n, kind, valid))
        tag = {v: self.fresh("k") for v in outer}
        grouped = df.groupBy(*[_c(column_of(v)).alias(tag[v]) for v in outer]).agg(*values, F.count("*").alias(n))
        base = self.frame(env)
        if outer:
            # all that need a row have one where any has
            how = "left" if any(a.kind in ("count", "sum") for a in aggs) else "inner"
            out = base.join(grouped, reduce(Column.__and__, [_c(column_of(v)) == F.col(tag[v]) for v in outer]), how)
        else:
            out = base.crossJoin(F.broadcast(grouped))  # one row
        return env.with_df(out.drop(*tag.values())), made

    def negate(self, atom: Not, env: Env) -> Env:
        for branch in atom.branches:
            outer = sorted(atoms_vars(branch) & set(env.vars))
            env = env.with_df(self._anti(env, branch, outer))
        return env

    def _anti(self, env: Env, branch: tuple[Atom, ...], outer: list[str]) -> DataFrame:
        inner = self._inner()
        preds = tuple(a for a in branch if isinstance(a, (Pred, Ref)))
        own = atoms_vars(preds)
        tests = tuple(a for a in branch if not isinstance(a, (Pred, Ref)))
        plain = preds and all(isinstance(a, Cmp) and not any(isinstance(t, Agg) for t in (a.left, a.right)) and atoms_vars((a,)) <= own | set(outer) for a in tests)
        if plain:
            # comparisons with outer values become part of the anti join's condition
            got = inner.run(preds)
            tag = {v: self.fresh("n") for v in got.vars}
            right = inner.frame(got).select(*[_c(column_of(v)).alias(t) for v, t in tag.items()])

            def side(term: Any) -> tuple[Column, T.DataType | None, Any]:
                if is_var(term):
                    return (F.col(tag[term]), got.vars[term], None) if term in tag else (_c(column_of(term)), env.vars[term], None)
                return inner.term(env, term)[1:]

            on = [self.equal((_c(column_of(v)), env.vars[v], None), side(v)) for v in outer if v in tag]
            on += [self.condition(a.op, side(a.left), side(a.right)) for a in tests]
            return self.frame(env).join(right, reduce(Column.__and__, on, F.lit(True)) if not on else reduce(Column.__and__, on), "left_anti")
        alone = self._alone(branch, set(outer))
        got = inner.run(branch, Env(None, {}) if alone else self._keys(env, outer))
        tag = {v: self.fresh("n") for v in outer}
        right = inner.frame(got).select(*[_c(column_of(v)).alias(t) for v, t in tag.items()])
        return self.frame(env).join(right, reduce(Column.__and__, [_c(column_of(v)) == F.col(t) for v, t in tag.items()]), "left_anti")


def evaluate(
    facts: FactSpace,
    where: Any,
    select: list[str] | None = None,
    *,
    resolve: Callable[[str, str], DataFrame] | None = None,
    witness: bool = False,
    distinct: bool = True,
) -> DataFrame:
    """All solutions of a body as a set: one column per variable (without its ``$``).

    Branches may bind different variables; those that a branch leaves unbound are null.
    ``select`` keeps some variables, all of which every branch must bind.  With ``witness``
    rows also have ``_case``, the branch, and ``_w``, the assertions used, and are not
    made distinct.
    """
    body: Body = parse(where)
    parts = []
    is_set = len(body.branches) == 1
    for case, atoms in enumerate(body.branches):
        compiler = Compiler(facts, resolve, witness)
        env = compiler.run(atoms, case=case)
        names = select if select is not None else sorted(env.vars)
        missing = [v for v in names if v not in env.vars]
        if missing:
            raise RuleError(f"branch {case} does not bind {missing}")
        is_set &= env.key is not None and env.key <= set(names)
        cols = [_c(column_of(v)) for v in names]
        if witness:
            cols += [F.lit(case).alias("_case"), F.col(WITNESS)]
        parts.append(compiler.frame(env).select(*cols))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.distinct() if distinct and not witness and not is_set else out
