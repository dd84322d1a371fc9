"""Paths: fixed multi-hop queries over edges, and widest paths by iteration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import FactSpace
from ..plans.ir import RuleError
from ..plans.ranges import pairs_by_cell
from ..sources.shared import materialize

MAX_STEPS, MAX_ROWS = 32, 100_000


@dataclass(frozen=True)
class Step:
    """One hop over an edge predicate ``edge(from, to, ...)``, forward or against it."""

    edge: str
    forward: bool = True


def relation_path(facts: FactSpace, start: str, steps: Sequence[Step], domains: Sequence[str | None] | None = None, where: Sequence[tuple[int, str, object]] = ()) -> DataFrame:
    """Distinct (n0, n1, ..., value of each edge as v1, ...) along the steps from a node domain.

    ``domains`` names the existence predicate of each node after the first; nodes that are
    not in it are phantoms and end no path.  ``where`` holds (node, op, value) filters,
    which Spark pushes to the scans.
    """
    if not 1 <= len(steps) <= MAX_STEPS:
        raise RuleError(f"a path has 1 to {MAX_STEPS} steps")
    domains = list(domains or [None] * len(steps))
    if len(domains) != len(steps):
        raise RuleError("one domain per step")
    ops = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__"}
    out = facts[start].select(F.col(f"`{facts.args(start)[0]}`").alias("n0"))
    for k, (step, domain) in enumerate(zip(steps, domains, strict=True), start=1):
        a, b, *rest = facts.args(step.edge)
        if not step.forward:
            a, b = b, a
        cols = [F.col(f"`{a}`").alias("_from"), F.col(f"`{b}`").alias(f"n{k}")]
        cols += [F.col(f"`{c}`").alias(f"v{k}" if j == 0 else f"v{k}_{j}") for j, c in enumerate(rest)]
        hop = facts[step.edge].select(*cols)
        if domain:
            hop = hop.join(facts[domain].select(F.col(f"`{facts.args(domain)[0]}`").alias(f"n{k}")), f"n{k}", "left_semi")
        out = out.join(hop, F.col(f"n{k - 1}") == F.col("_from")).drop("_from")
        for node, op, value in where:
            if node == k:
                out = out.where(getattr(F.col(f"n{k}"), ops[op])(value))
    for node, op, value in where:
        if node == 0:
            out = out.where(getattr(F.col("n0"), ops[op])(value))
    return out.distinct()


def limited(rows: DataFrame, row_limit: int) -> DataFrame:
    """The rows, or an error if there are more than ``row_limit``; nothing is ever cut off.

    The plan runs once: at most one row more than the limit is written, counted and read again.
    """
    if not 1 <= row_limit <= MAX_ROWS:
        raise RuleError(f"a row limit is from 1 to {MAX_ROWS}")
    found = materialize(rows.limit(row_limit + 1), "limited")
    if found.count() > row_limit:
        raise RuleError(f"more than {row_limit} rows")
    return found


def widest_paths(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """For each ordered pair that edges (source, target, confidence) connect: the best path.

    (source, target, confidence, depth, path, min_support_depth).  A path is as confident
    as its least confident edge; ties go to the shorter path, then to the one whose nodes
    come first.  ``min_support_depth`` is the fewest edges of any path.  Confidence is
    rounded to 6 digits.  Round n improves on paths of up to n edges, so it ends after as
    many rounds as the longest best path has edges; each round is a written table.
    """
    e = edges.select("source", "target", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))
    e = materialize(e.groupBy("source", "target").agg(F.max("confidence").alias("confidence")), "edges")
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("depth"), F.col("path"))

    def best(rows: DataFrame) -> DataFrame:
        got = rows.groupBy("source", "target").agg(F.min(rank).alias("b"), F.min("support").alias("support"))
        return got.select("source", "target", (-F.col("b.c")).alias("confidence"), "b.depth", "b.path", "support")

    first = e.select("source", "target", "confidence", F.lit(1).alias("depth"), F.array("source", "target").alias("path"), F.lit(1).alias("support"))
    known = materialize(best(first), "paths")
    fresh = known
    for _ in range(max_rounds):
        hop = e.select(F.col("source").alias("target"), F.col("target").alias("_next"), F.col("confidence").alias("_c"))
        longer = fresh.join(hop, "target").select(
            "source",
            F.col("_next").alias("target"),
            F.least("confidence", "_c").alias("confidence"),
            (F.col("depth") + 1).alias("depth"),
            F.concat("path", F.array("_next")).alias("path"),
            (F.col("support") + 1).alias("support"),
        )
        old = known.select("source", "target", F.struct((-F.col("confidence")).alias("c"), "depth", "path").alias("_old"), F.col("support").alias("_olds"))
        merged = best(known.unionByName(longer)).join(old, ["source", "target"], "left")
        moved = F.col("_old").isNull() | (rank != F.col("_old")) | (F.col("support") != F.col("_olds"))
        merged = materialize(merged.withColumn("_new", F.coalesce(moved, F.lit(True))).drop("_old", "_olds"), "paths")
        known, fresh = merged.drop("_new"), merged.where("_new").drop("_new")
        if fresh.isEmpty():
            break
    else:
        raise RuleError(f"paths still improve after {max_rounds} rounds")
    return known.withColumnRenamed("support", "min_support_depth")


def invalid_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths (source, target, path) that are broken: empty, ending elsewhere, or using an edge that is not there."""
    ends = (F.size("path") < 2) | (F.element_at("path", 1) != F.col("source")) | (F.element_at("path", -1) != F.col("target"))
    wrong = paths.where(ends).select("source", "target")
    n = F.size("path")
    hops = paths.where(n >= 2).select("source", "target", F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(F.element_at("path", k.cast("int")).alias("a"), F.element_at("path", (k + 1).cast("int")).alias("b")))).alias("h"))
    lost = hops.join(edges, (F.col("h.a") == edges["source"]) & (F.col("h.b") == edges["target"]), "left_anti").select("source", "target")
    return wrong.union(lost).distinct()


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and a range with ``low <= at <= high``, by an equi-join on cells of ``width``.

    A range is repeated for each cell that it touches, so ``width`` should be about as long as a
    usual range.  Points and ranges with a null, NaN or infinite end, and empty ranges, pair with nothing.
    However many a cell holds, its pairs are made in blocks (:func:`ranges.pairs_by_cell`).
    Columns of both tables stay and must differ.
    """
    if not width > 0:
        raise RuleError("a cell has a width")
    if both := set(points.columns) & set(ranges.columns):
        raise RuleError(f"both tables have {sorted(both)}")
    whole = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    cell = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(width)))
    points = points.where(whole(at)).withColumn("_cell", cell(at))
    ranges = ranges.where(whole(low) & whole(high) & (F.col(low) <= F.col(high))).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return pairs_by_cell(points, ranges, ["_cell"], at, low).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
