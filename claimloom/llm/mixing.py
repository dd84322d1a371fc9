"""Mixing sources to target weights over a time-varying curriculum.

Each source has a weight schedule over training time 0..1.  Its cumulative token
demand is its target times the integral of the schedule up to a time; a document's
copy covers an interval of its source's token stream, and inverting the demand at the
interval's middle gives the copy its training position.  Sorting by position deals
the corpus out in training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, words_of

Schedule = Sequence[tuple[float, float]]
#: (until this time, at this rate), by the source's place in code-point order: early, even, late.
SCHEDULES: tuple[Schedule, ...] = (((0.5, 2.0), (1.0, 1.0)), ((1.0, 1.0),), ((0.5, 1.0), (1.0, 2.0)))
WEIGHTS = (3, 1, 2)
#: A source's stream is prefix-summed in buckets of about so many rows, but this many buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 4096, 256


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, place, target`` from one row per source.

    ``share`` times all sizes is dealt by weight; no source gets more than ``cap`` times
    its size, and what it would have got more goes to the others by weight.  With the
    sources in order of cap / weight this is one prefix sum: the first k are at their
    caps, and the others get one common rate.  The table has a row per source only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    t = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1))
    t = t.withColumn("limit", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns(
        {
            "below": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "rest": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.lit(share) * F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    t = t.withColumn("rate", (F.col("total") - F.col("below")) / F.col("rest"))
    # the common rate is that of the first source whose cap it does not reach
    rate = F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "rate"))).over(by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["rate"]
    return t.withColumn("common", rate).select("source", "source_size", "place", F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("common") * F.col("weight"))).alias("target"))


def _cumulative(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(time from, time to, share from, share to) of each piece with a rate above 0."""
    pieces, at, whole = [], 0.0, sum((b - a) * r for (b, r), a in zip(schedule, [0.0, *(t for t, _ in schedule)], strict=False))
    done = 0.0
    for until, rate in schedule:
        gain = (until - at) * rate / whole
        if gain > 0:
            pieces.append((at, until, done, done + gain))
        done, at = done + gain, until
    return pieces


def position_of(share: Column, schedule: Schedule) -> Column:
    """The time by which ``share`` (0..1) of the schedule's tokens are due."""
    pieces = _cumulative(schedule)
    out: Column = F.lit(1.0)
    for a, b, c, d in reversed(pieces):
        out = F.when(share <= d, F.lit(a) + (share - F.lit(c)) * ((b - a) / (d - c))).otherwise(out)
    return out


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES, share: float = 1.5, cap: float = 2.0, size: Column | None = None) -> DataFrame:
    """Add ``size, source_size, target, taken, copies`` to every row of ``docs``.

    A source's stream is its documents in order of the MD5 of their ids, once and again up to
    ``cap`` times; the mix takes the stream's first ``target`` words (rounded down), so
    only one document of a source is cut.  ``copies`` holds (position, words) of each copy
    taken.  Columns of these names in ``docs`` are replaced; others stay.

    ``size`` is a document's number of words; give a column where it is known already.
    A null source is a source of its own, after all others.  A null or empty text has size
    0 and is never taken.  Repeated rows are documents of their own; rows with a null id
    come first in their source.  An empty table gives an empty result.
    """
    out = docs.withColumn("size", words_of(F.col("text")) if size is None else size).drop("source_size", "target", "taken", "copies")
    order = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("0" * 32))
    sums = out.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    sums = materialize(sums, "mix-sources")
    n = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, n // BUCKET_ROWS)
    out = out.withColumn("_order", order).withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int"))
    # a key without nulls lets the window and the join share one shuffle of the documents
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source")))
    out = out.withColumn("_key", key)
    per = out.groupBy("_key", "_bucket").agg(F.sum("size").alias("_size"))
    base = F.coalesce(F.sum("_size").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goals = targets(sums.drop("_n"), weights, share, cap).withColumn("_key", key).drop("source")
    bases = per.select("_key", "_bucket", base.alias("_base")).join(goals, "_key")
    within = Window.partitionBy("_key", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = out.join(bases, ["_key", "_bucket"]).withColumn("_start", F.col("_base") + F.col("_within"))
    goal = F.floor("target")
    passes = F.sequence(F.lit(0), F.lit(-int(-cap // 1) - 1))

    def copy(p: Column) -> Column:
        start = F.col("_start") + p * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - start))
        middle = (start + words / 2) / F.col("target")
        at: Column = position_of(middle, schedules[0])
        for k, schedule in enumerate(schedules[1:], start=1):
            at = F.when(F.col("place") % len(schedules) == k, position_of(middle, schedule)).otherwise(at)
        return F.when(words > 0, F.struct(at.alias("position"), words.alias("words")))

    out = out.withColumn("copies", F.filter(F.transform(passes, copy), lambda c: c.isNotNull()))
    out = out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]))
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    return out.select(*kept, "size", "source_size", "target", "taken", "copies")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy that holds at least half of its document, range-sorted by ``position``."""
    copies = mixed.withColumn("_copy", F.explode("copies")).where(F.col("_copy.words") * 2 >= F.col("size"))
    return copies.withColumn("position", F.col("_copy.position")).drop("_copy", "copies").orderBy("position", "doc_id")


def by_first_position(mixed: DataFrame, most: int = 2, digits: int = 9) -> DataFrame:
    """One row per document with ``position``, ``position_2`` ... of its at most ``most`` copies (null: not taken).

    Rows are range-sorted by the first; documents that are not taken come last, in order of their ids.
    """
    cols = {"position" if k == 0 else f"position_{k + 1}": F.round(F.get(F.col("copies"), F.lit(k))["position"], digits) for k in range(most)}
    return mixed.withColumns(cols).drop("copies").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    # only sizes are needed from here on, so the texts are read once
    sized = materialize(docs.select("doc_id", "source", words_of(F.col("text")).alias("words")), "mix-sizes")
    mixed = by_first_position(mix(sized, size=F.col("words")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "position_2")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(doc_id::VARCHAR) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
k AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM r),
c AS (SELECT arg_min((total - below) / rest, ratio) AS common FROM k WHERE (total - below) / rest <= ratio),
t AS (SELECT source, source_size, place, CASE WHEN common IS NULL THEN lim ELSE least(lim, common * weight) END AS target FROM k, c),
p AS (SELECT d.*, t.source_size, t.target, t.place,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS first,
    greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS second FROM p),
m AS (SELECT *, CASE WHEN first > 0 THEN (start + first / 2) / target END AS x, CASE WHEN second > 0 THEN (start + source_size + second / 2) / target END AS y FROM q)
SELECT doc_id, size, source_size, target, (first + second)::BIGINT AS taken,
  round(CASE place % 3 WHEN 0 THEN CASE WHEN x <= 2.0 / 3 THEN x * 0.75 ELSE 0.5 + (x - 2.0 / 3) * 1.5 END
    WHEN 1 THEN x ELSE CASE WHEN x <= 1.0 / 3 THEN x * 1.5 ELSE 0.5 + (x - 1.0 / 3) * 0.75 END END, 9) AS position,
  round(CASE place % 3 WHEN 0 THEN CASE WHEN y <= 2.0 / 3 THEN y * 0.75 ELSE 0.5 + (y - 2.0 / 3) * 1.5 END
    WHEN 1 THEN y ELSE CASE WHEN y <= 1.0 / 3 THEN y * 1.5 ELSE 0.5 + (y - 1.0 / 3) * 0.75 END END, 9) AS position_2
FROM m
"""
