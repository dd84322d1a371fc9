"""Evidence and certainty: which claim stands, and how sure a conclusion is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ir import RuleError
from .views import latest_rank


def max_evidence(rows: DataFrame) -> DataFrame:
    """Of the claims on one (subject, relation, object), the most confident.

    Confidence is rounded to 6 digits; ties go to the first source type, then claim id.
    """
    rows = rows.withColumn("confidence", F.round("confidence", 6))
    return latest_rank(rows, ["subject", "relation", "object"], [F.desc("confidence"), F.asc("source_type"), F.coalesce("claim_id", F.lit(""))])


def two_hop(edges: DataFrame) -> DataFrame:
    """(subject, relation, object, via): depends_on twice, or monitors into is_component_of; ends differ."""
    a, b = edges.alias("a"), edges.alias("b")
    pairs = F.col("a.object") == F.col("b.subject")
    kinds = {("depends_on", "depends_on"): "depends_on", ("monitors", "is_component_of"): "monitors"}
    relation = F.coalesce(*[F.when((F.col("a.relation") == x) & (F.col("b.relation") == y), F.lit(r)) for (x, y), r in kinds.items()])
    both = a.join(b, pairs).withColumn("_r", relation).where(F.col("_r").isNotNull() & (F.col("a.subject") != F.col("b.object")))
    return both.select(F.col("a.subject").alias("subject"), F.col("_r").alias("relation"), F.col("b.object").alias("object"), F.col("a.object").alias("via")).distinct()


def max_probability(rows: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(p).alias(p))


def condition_impacts(rows: DataFrame, keys: Sequence[str], how: str = "bottleneck") -> DataFrame:
    """Add ``impact`` to conditions (condition_key, weight, confidence); null without a weight.

    bottleneck: weight times confidence.  additive: the weight's share times confidence.
    A missing confidence is 1; shares of weights that sum to 0 are 0.
    """
    sure = F.coalesce("confidence", F.lit(1.0))
    if how == "bottleneck":
        impact = F.round(F.col("weight") * sure, 6)
    elif how == "additive":
        rows = _with_whole(rows, keys)
        impact = F.when(F.col("weight").isNotNull(), F.when(F.col("_whole") > 0, F.round(F.col("weight") / F.col("_whole") * sure, 6)).otherwise(0.0))
    else:
        raise RuleError(f"unknown aggregation: {how}")
    return rows.withColumn("impact", impact).drop("_whole")


def _with_whole(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_whole``, the sum of a key's weights: an aggregation with partial results, then a join."""
    whole = rows.groupBy(*keys).agg(F.sum("weight").alias("_whole")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return rows.join(whole, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*[f"_k_{k}" for k in keys])


def certainty(rows: DataFrame, keys: Sequence[str], how: str = "bottleneck") -> DataFrame:
    """One certainty per key: the smallest impact, or the sum of the shares; null if nothing has a weight."""
    if how == "bottleneck":  # needs no window: one aggregation with partial results
        return condition_impacts(rows, keys, how).groupBy(*keys).agg(F.min("impact").alias("certainty"))
    return condition_impacts(rows, keys, how).groupBy(*keys).agg(F.round(F.sum("impact"), 6).alias("certainty"))


def ranked_conditions(rows: DataFrame, keys: Sequence[str], how: str = "bottleneck") -> DataFrame:
    """Conditions with ``place`` (smallest impact first, those without last) and ``is_bottleneck``."""
    w = Window.partitionBy(*keys)
    rows = condition_impacts(rows, keys, how)
    least = F.min("impact").over(w)
    mark = F.coalesce(F.col("impact") == least, F.lit(False)) if how == "bottleneck" else F.lit(False)
    return rows.withColumns({"place": F.row_number().over(w.orderBy(F.asc_nulls_last("impact"), "condition_key")), "is_bottleneck": mark})


TIE_BREAKS = ("error", "latest_by_ingested_at_then_min_assertion_id", "prefer_source")


def resolve_mapping(rows: DataFrame, keys: Sequence[str], values: Sequence[str], tie_break: str = "error", source_rank: Sequence[str] = ()) -> DataFrame:
    """One row per key of a mapping (with asrt_id, ingested_at, source): its value and why it was chosen.

    A key with one distinct value has that value (of the smallest assertion id, reason
    ``single_value``).  Others are settled by ``tie_break``; with ``error`` reading the row raises.
    """
    if tie_break not in TIE_BREAKS:
        raise RuleError(f"unknown tie break: {tie_break}")
    if tie_break == "prefer_source":
        rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for k, s in enumerate(source_rank)], F.lit(len(source_rank)))
        order = F.struct(-rank, F.col("ingested_at"))
    else:
        order = F.struct(F.lit(0), F.col("ingested_at"))
    # the best row of each key comes by a limit within tasks, the spread of its values by partial aggregation
    best = latest_rank(rows.withColumn("_order", order), keys, [F.desc("_order"), F.asc("asrt_id")]).drop("_order")
    value = F.struct(*values)
    spread = rows.groupBy(*keys).agg((F.min(value) == F.max(value)).alias("_same")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    out = best.join(spread, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    reason = F.when(F.col("_same"), F.lit("single_value"))
    if tie_break == "error":
        said = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        reason = reason.otherwise(F.raise_error(F.concat(F.lit("mapping conflict for "), said)).cast("string"))
    else:
        reason = reason.otherwise(F.lit(tie_break))
    return out.select(*keys, *values, "asrt_id", reason.alias("reason"))


def mapping_conflicts(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys with more than one distinct value, and how many."""
    return rows.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("n_values"), F.min("asrt_id").alias("first_asrt")).where("n_values > 1")
