"""Named rules, their composition, policies, programs and queries.

Everything here rewrites rules on the driver; what comes out is one body for
:func:`claimloom.plans.compile.evaluate`, so a composed rule is still one plan.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import entity_ref_column
from .compile import FactSpace, column_of, evaluate
from .ir import MAX_BRANCHES, Agg, Atom, Body, Cmp, Not, Pred, Ref, RuleError, atoms_vars, is_var, parse, predicates, rename


@dataclass(frozen=True)
class RuleSpec:
    """A derived relation: a name and version, its columns, and its body."""

    rule_id: str
    version: str
    select: tuple[str, ...]
    where: Body
    expose: bool = False

    def __init__(self, rule_id: str, version: str, select: Sequence[str], where: Any, expose: bool = False) -> None:
        if not rule_id or not version:
            raise RuleError("a rule needs an id and a version")
        if not select or not all(is_var(v) for v in select):
            raise RuleError("a rule selects variables")
        for name, value in (("rule_id", rule_id), ("version", version), ("select", tuple(select)), ("where", parse(where)), ("expose", expose)):
            object.__setattr__(self, name, value)


class RuleRegistry:
    """Rules by id and version.  A rule that reaches itself is an error."""

    def __init__(self, rules: Sequence[RuleSpec] = ()) -> None:
        self._rules: dict[tuple[str, str], RuleSpec] = {}
        for r in rules:
            self.register(r)

    def register(self, rule: RuleSpec) -> None:
        if (rule.rule_id, rule.version) in self._rules:
            raise RuleError(f"{rule.rule_id}@{rule.version} is registered already")
        self._rules[rule.rule_id, rule.version] = rule

    def exposed(self) -> list[RuleSpec]:
        return [r for r in self._rules.values() if r.expose]

    def resolver(self, facts: FactSpace) -> Callable[[str, str], DataFrame]:
        """Rules as relations, each compiled once; Spark reuses the exchanges of equal plans."""
        done: dict[tuple[str, str], DataFrame] = {}
        open_: list[tuple[str, str]] = []

        def resolve(rule_id: str, version: str) -> DataFrame:
            key = rule_id, version
            if key in open_:
                raise RuleError("rules in a circle: " + " > ".join(r for r, _ in [*open_, key]))
            if key not in done:
                if key not in self._rules:
                    raise RuleError(f"unknown rule: {rule_id}@{version}")
                open_.append(key)
                try:
                    rule = self._rules[key]
                    done[key] = evaluate(facts, rule.where, list(rule.select), resolve=resolve)
                finally:
                    open_.pop()
            return done[key]

        return resolve


def run_rule(facts: FactSpace, rule: RuleSpec, registry: RuleRegistry | None = None) -> DataFrame:
    return evaluate(facts, rule.where, list(rule.select), resolve=(registry or RuleRegistry()).resolver(facts))


def trace_rule(facts: FactSpace, rule: RuleSpec, registry: RuleRegistry) -> DataFrame:
    """(rule, version, rows) of a rule and of all that it refers to, directly or not."""
    resolve = registry.resolver(facts)
    seen: dict[tuple[str, str], DataFrame] = {(rule.rule_id, rule.version): evaluate(facts, rule.where, list(rule.select), resolve=resolve)}
    todo = [rule.where]
    while todo:
        for branch in todo.pop().branches:
            for a in branch:
                if isinstance(a, Ref) and (a.rule, a.version) not in seen:
                    seen[a.rule, a.version] = resolve(a.rule, a.version)
                    todo.append(registry._rules[a.rule, a.version].where)
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(r).alias("rule"), F.lit(v).alias("version"), "rows") for (r, v), df in seen.items()]
    return reduce(DataFrame.union, parts)


# composition


@dataclass(frozen=True)
class Port:
    """A variable of a rule that others may join; equal kinds join."""

    var: str
    kind: str = "any"


@dataclass(frozen=True)
class Rule:
    """A body with named ports.  ``&`` and ``|`` compose rules and their occurrences."""

    rule_id: str
    when: Body
    ports: tuple[tuple[str, Port], ...]
    version: str = "1"

    def __init__(self, rule_id: str, when: Any, ports: Mapping[str, str | Port], version: str = "1") -> None:
        body = parse(when)
        found = {n: p if isinstance(p, Port) else Port(p) for n, p in ports.items()}
        for n, p in found.items():
            if any(p.var not in atoms_vars(b) for b in body.branches):
                raise RuleError(f"port {n} is not bound in every branch")
        for name, value in (("rule_id", rule_id), ("when", body), ("ports", tuple(sorted(found.items()))), ("version", version)):
            object.__setattr__(self, name, value)

    def as_(self, alias: str) -> Occurrence:
        return Occurrence(self, alias)

    def projection(self, *names: str, alias: str | None = None) -> dict[str, Endpoint]:
        """Some ports (all if none is named) as a head for :func:`evaluate_expr`, each under its own name."""
        own = self.as_(alias or self.rule_id)
        return {n: own.port(n) for n in names or [n for n, _ in self.ports]}

    def digest(self) -> str:
        """Equal for rules with the same id, version, body and ports."""
        said = json.dumps([self.rule_id, self.version, repr(self.when.branches), [[n, p.var, p.kind] for n, p in self.ports]], ensure_ascii=False)
        return "sha256:" + hashlib.sha256(said.encode()).hexdigest()

    def __repr__(self) -> str:
        return f"Rule({self.rule_id}@{self.version}: {', '.join(f'{n} {p.kind}' for n, p in self.ports)})"

    def __and__(self, other: Any) -> Group:
        return all_of(self, other)

    def __or__(self, other: Any) -> Group:
        return any_of(self, other)

    def __bool__(self) -> bool:
        raise TypeError("use & and | to compose rules")


@dataclass(frozen=True)
class Endpoint:
    alias: str
    port: str
    kind: str

    def eq(self, other: Endpoint) -> Join:
        if "any" not in (self.kind, other.kind) and self.kind != other.kind:
            raise RuleError(f"{self.alias}.{self.port} is {self.kind}, {other.alias}.{other.port} is {other.kind}")
        return Join(self, other)


@dataclass(frozen=True)
class Join:
    left: Endpoint
    right: Endpoint


@dataclass(frozen=True)
class Occurrence:
    """One use of a rule, under a name of its own."""

    rule: Rule
    alias: str

    def port(self, name: str) -> Endpoint:
        ports = dict(self.rule.ports)
        if name not in ports:
            raise RuleError(f"{self.alias} has no port {name}")
        return Endpoint(self.alias, name, ports[name].kind)

    def __getattr__(self, name: str) -> Endpoint:
        if name.startswith("_") or name in ("rule", "alias"):
            raise AttributeError(name)
        return self.port(name)

    __and__, __or__, __bool__ = Rule.__and__, Rule.__or__, Rule.__bool__


@dataclass(frozen=True)
class Group:
    """AND or OR of parts; joins belong to ANDs."""

    kind: str
    parts: tuple[Any, ...]
    joins: tuple[Join, ...] = ()

    __and__, __or__, __bool__ = Rule.__and__, Rule.__or__, Rule.__bool__

    def join(self, *joins: Join) -> Group:
        if self.kind != "and":
            raise RuleError("joins belong to ANDs; put them into the branches of an OR")
        if not joins:
            raise RuleError("which join?")
        known = {o.alias for o in occurrences(self)}
        for j in joins:
            for e in (j.left, j.right):
                if e.alias not in known:
                    raise RuleError(f"{e.alias} does not occur here")
        return replace(self, joins=(*self.joins, *joins))

    def join_by_ports(self, *names: str) -> Group:
        """Join the ports of these names (all shared ones, if none is named) across occurrences."""
        found = occurrences(self)
        shared = names or sorted({n for o in found for n, _ in o.rule.ports if sum(n in dict(p.rule.ports) for p in found) > 1})
        joins = []
        for n in shared:
            having = [o for o in found if n in dict(o.rule.ports)]
            if len(having) < 2:
                raise RuleError(f"fewer than two occurrences have a port {n}")
            joins += [having[0].port(n).eq(o.port(n)) for o in having[1:]]
        return self.join(*joins)


def _part(x: Any) -> Any:
    return x.as_(x.rule_id) if isinstance(x, Rule) else x


def _compose(kind: str, parts: Sequence[Any]) -> Group:
    flat: list[Any] = []
    joins: list[Join] = []
    for p in map(_part, parts):
        if isinstance(p, Join) and kind == "and":
            joins.append(p)
        elif isinstance(p, Group) and p.kind == kind:
            flat += p.parts
            joins += p.joins
        elif isinstance(p, (Occurrence, Group)):
            flat.append(p)
        else:
            raise RuleError(f"not a rule: {p!r}")
    if not flat:
        raise RuleError("nothing to compose")
    out = Group(kind, tuple(flat))
    return out.join(*joins) if joins else out


def all_of(*parts: Any) -> Group:
    return _compose("and", parts)


def any_of(*parts: Any) -> Group:
    return _compose("or", parts)


def occurrences(expr: Any) -> list[Occurrence]:
    expr = _part(expr)
    return [expr] if isinstance(expr, Occurrence) else [o for p in expr.parts for o in occurrences(p)]


def _dnf(expr: Any) -> list[tuple[list[Occurrence], list[Join]]]:
    expr = _part(expr)
    if isinstance(expr, Occurrence):
        return [([expr], [])]
    inner = [_dnf(p) for p in expr.parts]
    if expr.kind == "or":
        found = [b for part in inner for b in part]
    else:
        found = [([o for os, _ in combo for o in os], [*(j for _, js in combo for j in js), *expr.joins]) for combo in product(*inner)]
    if len(found) > MAX_BRANCHES:
        raise RuleError(f"more than {MAX_BRANCHES} branches")
    return found


def lower(expr: Any, head: Mapping[str, Endpoint | Mapping[str, Endpoint]] | None = None, more: Callable[[Mapping[str, str]], list[Atom]] | None = None) -> tuple[Body, list[str]]:
    """One body for a composition, and the head's variables.

    The variables of an occurrence are prefixed with its alias.  ``head`` names what to
    return: an endpoint, or one per alias where branches of an OR hold different occurrences.
    Without it all ports are returned as ``alias_port``.  Joined ports become one variable, so
    they are equi-joins and not filters over a product.
    """
    branches: list[tuple[Atom, ...]] = []
    names: list[str] = []
    for occs, joins in _dnf(expr):
        aliases = [o.alias for o in occs]
        if len(set(aliases)) != len(aliases):
            raise RuleError(f"an alias is used twice: {sorted(aliases)}; name occurrences with as_()")
        by_alias = {o.alias: o for o in occs}
        same: dict[tuple[str, str], tuple[str, str]] = {}

        def root(k: tuple[str, str]) -> tuple[str, str]:
            while k in same:
                k = same[k]
            return k

        for j in joins:
            a, b = root((j.left.alias, dict(by_alias[j.left.alias].rule.ports)[j.left.port].var)), root((j.right.alias, dict(by_alias[j.right.alias].rule.ports)[j.right.port].var))
            if a != b:
                same[b] = a

        def var(alias: str, v: str) -> str:
            a, w = root((alias, v))
            return f"${a}__{column_of(w)}"

        # every occurrence may itself be an OR of bodies
        for combo in product(*(o.rule.when.branches for o in occs)):
            atoms: list[Atom] = []
            for o, branch in zip(occs, combo, strict=True):
                atoms += [rename(a, {v: var(o.alias, v) for v in atoms_vars(branch)}) for a in branch]
            ports = {f"{o.alias}_{n}": var(o.alias, p.var) for o in occs for n, p in o.rule.ports}
            if more:
                atoms += more(ports)
            wanted = head or {k: None for k in ports}
            for name, end in wanted.items():
                if isinstance(end, Mapping):
                    ends = [e for e in end.values() if e.alias in by_alias]
                    if not ends:
                        raise RuleError(f"a branch has nothing for {name}")
                    source = ports[f"{ends[0].alias}_{ends[0].port}"]
                else:
                    source = ports[name] if end is None else ports.get(f"{end.alias}_{end.port}")
                    if source is None:
                        raise RuleError(f"a branch has nothing for {name}")
                atoms.append(Cmp("eq", f"${name}", source))
            names = [f"${n}" for n in wanted]
            branches.append(tuple(atoms))
    if len(branches) > MAX_BRANCHES:
        raise RuleError(f"more than {MAX_BRANCHES} branches")
    return parse(Body(tuple(branches))), names


def evaluate_expr(facts: FactSpace, expr: Any, head: Mapping[str, Any] | None = None, registry: RuleRegistry | None = None) -> DataFrame:
    body, names = lower(expr, head)
    return evaluate(facts, body, names, resolve=registry.resolver(facts) if registry else None)


# policies


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Nav:
    """One hop from an entity endpoint to a field: the predicate ``field(entity, value)``."""

    start: Endpoint
    field: str


@dataclass(frozen=True)
class Unify:
    left: Endpoint
    right: Endpoint


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Policy:
    """All or Any of occurrences, policies, unifications and comparisons."""

    kind: str
    parts: tuple[Any, ...]


def policy_all(*parts: Any) -> Policy:
    return Policy("and", tuple(map(_part, parts)))


def policy_any(*parts: Any) -> Policy:
    return Policy("or", tuple(map(_part, parts)))


def compile_policy(policy: Any) -> list[tuple[list[Occurrence], list[Join], list[Compare]]]:
    """The policy's branches: occurrences, joins from unifications, comparisons."""
    policy = _part(policy)
    if isinstance(policy, Occurrence):
        return [([policy], [], [])]
    if isinstance(policy, Unify):
        return [([], [policy.left.eq(policy.right)], [])]
    if isinstance(policy, Compare):
        return [([], [], [policy])]
    inner = [compile_policy(p) for p in policy.parts]
    if policy.kind == "or":
        found = [b for part in inner for b in part]
    else:
        found = [tuple([x for c in combo for x in c[k]] for k in range(3)) for combo in product(*inner)]
    if len(found) > MAX_BRANCHES:
        raise RuleError(f"more than {MAX_BRANCHES} branches")
    return found


#: Kinds of ports that have an order, and those of other values; any other kind names an entity.
ORDERED = ("int", "float64", "time")
UNORDERED = ("string", "bool", "bytes", "uuid")


def _check_operands(c: Compare) -> None:
    """An entity's port is compared with its like or with the text of a reference."""

    def says(side: Any) -> str | None:
        if isinstance(side, Endpoint):
            return None if side.kind == "any" else side.kind
        if isinstance(side, Literal):
            return "bool" if isinstance(side.value, bool) else "a number" if isinstance(side.value, (int, float)) else "a text"
        return None

    left, right = says(c.left), says(c.right)
    for kind in (left, right):
        if c.op not in ("eq", "ne") and kind is not None and kind not in (*ORDERED, "a number"):
            raise RuleError(f"{kind} has no order")
    if left is None or right is None or left == right:
        return
    pair = {left, right}
    numbers = "a number" in pair and any(k in ORDERED for k in pair)
    texts = "a text" in pair and not any(k in (*ORDERED, "bool", "a number") for k in pair)
    if not numbers and not texts:
        raise RuleError(f"{left} and {right} are never equal")


def evaluate_policy(facts: FactSpace, policy: Any, select: Mapping[str, Endpoint | Nav], bind: Mapping[Endpoint, Any] | None = None, registry: RuleRegistry | None = None) -> DataFrame:
    """Rows of ``select`` that the policy allows; ``bind`` fixes endpoints to values.

    Where ports say their kinds, both sides of a comparison have one kind, and only numbers and times are ordered.
    """
    parts = []
    for occs, joins, comparisons in compile_policy(policy):
        if not occs:
            raise RuleError("a branch of the policy has no rule")
        for c in comparisons:
            _check_operands(c)
        wanted = [*select.values(), *(s for c in comparisons for s in (c.left, c.right))]
        fresh: dict[Nav, str] = {n: f"$nav{k}" for k, n in enumerate(dict.fromkeys(n for n in wanted if isinstance(n, Nav)))}

        def more(ports: Mapping[str, str], comparisons=comparisons, fresh=fresh) -> list[Atom]:
            def term(s: Any) -> Any:
                if isinstance(s, Literal):
                    return s.value
                return fresh[s] if isinstance(s, Nav) else ports[f"{s.alias}_{s.port}"]

            atoms: list[Atom] = [Pred(n.field, (ports[f"{n.start.alias}_{n.start.port}"], v)) for n, v in fresh.items()]
            atoms += [Cmp("eq", ports[f"{e.alias}_{e.port}"], v) for e, v in (bind or {}).items() if f"{e.alias}_{e.port}" in ports]
            atoms += [Cmp(c.op, term(c.left), term(c.right)) for c in comparisons]
            return atoms + [Cmp("eq", f"$out_{name}", term(s)) for name, s in select.items()]

        group = all_of(*occs)
        body, _ = lower(group.join(*joins) if joins else group, None, more)
        parts.append(evaluate(facts, body, [f"$out_{n}" for n in select], resolve=registry.resolver(facts) if registry else None).withColumnsRenamed({f"out_{n}": n for n in select}))
    return reduce(DataFrame.unionByName, parts).distinct()


# programs


@dataclass(frozen=True)
class Clause:
    """``head(terms) :- body``; several clauses may have one head."""

    head: str
    terms: tuple[Any, ...]
    body: Body

    def __init__(self, head: str, terms: Sequence[Any], body: Any) -> None:
        for n, v in (("head", head), ("terms", tuple(terms)), ("body", parse(body))):
            object.__setattr__(self, n, v)


def run_program(facts: FactSpace, clauses: Sequence[Clause], program_facts: Mapping[str, Sequence[tuple]] | None = None, goal: tuple[str, Sequence[Any]] | None = None) -> FactSpace | DataFrame:
    """Derive the heads in order of their dependencies and add them to the facts.

    Derived predicates may not stand in not or in an aggregate, and may not depend on
    themselves.  With a ``goal`` (predicate, terms) its solutions are returned instead.
    """
    heads = {c.head for c in clauses}
    stated = dict(program_facts or {})
    for name in heads | set(stated):
        if name in facts:
            raise RuleError(f"{name} is a stored predicate")
    needs: dict[str, set[str]] = {h: set() for h in heads}
    for c in clauses:
        for branch in c.body.branches:
            for a in branch:
                inner = [x for x in _hidden(a) if x in heads]
                if inner:
                    raise RuleError(f"{inner[0]} is derived and stands in not or an aggregate")
                if isinstance(a, Pred) and a.name in heads:
                    needs[c.head].add(a.name)
    space = facts
    if stated:
        space = space.with_relations({n: facts.spark.createDataFrame([tuple(r) for r in rows], [f"a{k}" for k in range(len(rows[0]))]) for n, rows in stated.items() if n not in heads})
    todo = set(heads)
    while todo:
        ready = sorted(h for h in todo if not needs[h] & todo)
        if not ready:
            raise RuleError(f"predicates in a circle: {sorted(todo)}")
        for h in ready:
            parts = []
            for c in clauses:
                if c.head == h:
                    names = [f"$a{k}_" for k in range(len(c.terms))]
                    body = Body(tuple((*b, *(Cmp("eq", n, t) for n, t in zip(names, c.terms, strict=True))) for b in c.body.branches))
                    parts.append(evaluate(space, body, names))
            if h in stated:
                parts.append(facts.spark.createDataFrame([tuple(r) for r in stated[h]], parts[0].schema))
            space = space.with_relations({h: reduce(DataFrame.union, parts).distinct()})
            todo.discard(h)
    if goal is None:
        return space
    name, terms = goal
    if any(is_var(t) for t in terms):
        return evaluate(space, [("pred", name, list(terms))])
    # a closed goal: one row says whether it holds
    closed = [Pred(name, tuple(f"$g{k}" for k in range(len(terms)))), *(Cmp("eq", f"$g{k}", t) for k, t in enumerate(terms))]
    return evaluate(space, Body((tuple(closed),))).limit(1).agg((F.count("*") > 0).alias("holds"))


def _hidden(atom: Atom) -> list[str]:
    if isinstance(atom, Not):
        return [n for b in atom.branches for n in predicates(b)]
    terms = [atom.left, atom.right] if isinstance(atom, Cmp) else list(getattr(atom, "args", ()))
    return [n for t in terms if isinstance(t, Agg) for n in predicates(t.where)]


# queries


@dataclass(frozen=True)
class Slot:
    """A returned column: a variable, or a field reached from one, with what to do if it is missing."""

    var: str
    field: str | None = None
    missing: str = "error"
    kind: str | None = None
    mismatch: str = "error"


def query(facts: FactSpace, where: Any, slots: Mapping[str, Slot], registry: RuleRegistry | None = None) -> DataFrame:
    """Distinct rows of the slots.

    ``missing``: skip drops the row, null keeps it, error raises when the row is read.
    ``mismatch``: the same, for values that do not cast to ``kind``.
    """
    base = evaluate(facts, where, sorted({s.var for s in slots.values()}), resolve=registry.resolver(facts) if registry else None)
    out = base
    cols = []
    for name, s in slots.items():
        col = F.col(f"`{column_of(s.var)}`")
        if s.field:
            rel = facts[s.field]
            key, value = facts.args(s.field)[:2]
            right = rel.select(F.col(f"`{key}`").alias(f"_k_{name}"), F.col(f"`{value}`").alias(f"_v_{name}"))
            out = out.join(right, col == F.col(f"_k_{name}"), "inner" if s.missing == "skip" else "left").drop(f"_k_{name}")
            col = F.col(f"_v_{name}")
            if s.missing == "error":
                col = F.coalesce(col, F.raise_error(F.lit(f"{name} is missing")))
        if s.kind:
            cast = col.try_cast(s.kind)
            wrong = cast.isNull() & col.isNotNull()
            if s.mismatch == "error":
                cast = F.when(wrong, F.raise_error(F.lit(f"{name} is no {s.kind}")).cast(s.kind)).otherwise(cast)
            elif s.mismatch == "skip":
                out = out.where(~wrong)
            col = cast
        cols.append(col.alias(name))
    return out.select(*cols).distinct()


def match(facts: FactSpace, entity: str, where: Any, ports: Mapping[str, Any], limit: int | None = None) -> DataFrame:
    """Distinct entities (a variable) for which the body holds with these variables fixed; all atoms must connect to it."""
    body = parse(where)
    for branch in body.branches:
        groups = [atoms_vars((a,)) for a in branch if atoms_vars((a,))]
        reached, grown = {entity}, True
        while grown:
            grown = False
            for g in groups:
                if g & reached and not g <= reached:
                    reached |= g
                    grown = True
        if not all(g <= reached for g in groups):
            raise RuleError(f"an atom does not connect to {entity}")
    fixed = Body(tuple((*b, *(Cmp("eq", v, x) for v, x in ports.items())) for b in body.branches))
    out = evaluate(facts, fixed, [entity])
    return out.orderBy(column_of(entity)).limit(limit) if limit is not None else out


@dataclass(frozen=True)
class EntityHead:
    """A head that derives an entity: its identity fields as (name, tag, term)."""

    entity: str
    identity: tuple[tuple[str, str, Any], ...]


def inference(facts: FactSpace, where: Any, heads: Mapping[str, Sequence[Any] | EntityHead], rule_id: str, version: str = "1", registry: RuleRegistry | None = None) -> DataFrame:
    """Candidates for several heads: (target, args, candidate_key), one row per new fact, in order of their keys.

    The key hashes the rule, the target and the arguments, so equal candidates of a rule are one.  A fact
    head has terms, of which one may be an :class:`EntityHead`: the reference of that entity.  A head that is
    an entity head itself derives the entity: its reference and its identity.  Rows with a
    null or otherwise impossible identity give no candidate.
    """
    parts = []
    base = evaluate(facts, where, resolve=registry.resolver(facts) if registry else None)
    for target, terms in heads.items():
        if isinstance(terms, EntityHead):
            terms = [terms, *[t for _, _, t in terms.identity]]
        rows = base.select(F.lit(target).alias("target"), F.array(*[F.to_json(F.struct(_head_term(t).alias("v"))) for t in terms]).alias("args"))
        for k, t in enumerate(terms):
            if isinstance(t, EntityHead):
                rows = rows.where(F.get("args", F.lit(k)) != "{}")
        key = F.sha2(F.encode(F.concat_ws("\x00", F.lit("candidate"), F.lit(rule_id), F.lit(version), F.lit(target), "args"), "UTF-8"), 256)
        parts.append(rows.withColumn("candidate_key", key))
    return reduce(DataFrame.union, parts).dropDuplicates(["candidate_key"]).orderBy("candidate_key")


def _head_term(term: Any) -> Column:
    if isinstance(term, EntityHead):
        return entity_ref_column(term.entity, [(n, t) for n, t, _ in term.identity], *[_head_term(v) for _, _, v in term.identity])
    return F.col(f"`{column_of(term)}`") if is_var(term) else F.lit(term)

