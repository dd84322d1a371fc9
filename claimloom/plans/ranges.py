"""Points in ranges: an equi-join on cells whose pairs are made block by block, whatever a cell holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of each side in a block, and of each in what is paired at a time.
BLOCK, SLICE = 4096, 128
#: Cells of :func:`by_length` are 2^LEAST to 2^MOST wide; longer and unbounded ranges share one cell.
LEAST, MOST = -32, 63


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _plain(df: DataFrame, names: list[str]) -> list[str]:
    """Columns that can be hashed and ordered."""
    return [c for c in names if not any(k in df.schema[c].dataType.simpleString() for k in ("map<", "variant", "interval"))]


def _slices(name: str) -> Column:
    """A row for each slice of an array, one at a time: a generator over ``transform`` is outside generated code,
    which would hold all rows that come from one row of its input."""
    last = ((F.size(name) - 1) / SLICE).cast("int")
    return F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(name, k * SLICE + 1, SLICE)))


def pairs_by_cell(points: DataFrame, ranges: DataFrame, cell: list[str], at: str, low: str) -> DataFrame:
    """All pairs of a point and a range of the same cell; the caller tests them.

    What a cell gives grows with the product of its sides, so both are dealt over blocks of about
    ``BLOCK`` rows and each pair of blocks goes to a task by itself: memory is bounded by a
    block, and no cell keeps a task to itself.  A block is one row that is shuffled once per block of
    the other side.  Rows that are equal in every column stay in one block.  Both sides are read
    twice, as their cells are counted first.  Blocks are sorted and paired by slices,
    so neighbouring pairs repeat the same ranges for one point after the other, which a columnar
    file keeps in a few bits a row.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p_cols, r_cols = ([c for c in df.columns if c not in cell] for df in (points, ranges))
    counts = points.groupBy(*cell).agg(F.count("*").alias("_np")).join(ranges.groupBy(*cell).agg(F.count("*").alias("_nr")), cell)
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    large = counts.where((F.col("_np") > BLOCK) | (F.col("_nr") > BLOCK)).select(*cell, parts("_np").alias("_a"), parts("_nr").alias("_b"))

    def blocks(df: DataFrame, cols: list[str], own: str, other: str, mine: str, theirs: str, first: str, name: str) -> DataFrame:
        plain = _plain(df, cols)
        one = F.lit(1)
        df = df.join(large, cell, "left").withColumns({"_a": F.coalesce("_a", one), "_b": F.coalesce("_b", one)})
        df = df.withColumn(own, F.pmod(F.xxhash64(*[_c(c) for c in plain]), F.col(mine)).cast("int"))
        rows = F.collect_list(F.struct(*[_c(c) for c in sorted(cols, key=lambda c: c != first)]))
        df = df.groupBy(*cell, own, theirs).agg((F.sort_array(rows) if len(plain) == len(cols) else rows).alias(name))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).drop(theirs).repartition(n, *cell, "_i", "_j")

    p = blocks(points, p_cols, "_i", "_j", "_a", "_b", at, "_points")
    r = blocks(ranges, r_cols, "_j", "_i", "_b", "_a", low, "_ranges")
    both = p.join(r, [*cell, "_i", "_j"]).select("_points", "_ranges")
    both = both.select("_points", _slices("_ranges").alias("_ranges"))
    both = both.select(_slices("_points").alias("_points"), "_ranges")
    return both.select(F.inline("_points"), "_ranges").select(*[_c(c) for c in p_cols], F.inline("_ranges"))


def by_length(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """All columns of points and ranges, for a superset of the pairs with ``low <= at <= high``, each once.

    A range goes to the two or three cells that it touches among those about as wide as it is long,
    and a point to its cell of each width that ranges have (the widths, 97 at most, are broadcast).
    """
    d = lambda c: _c(c).cast("double")
    finite = lambda c: F.abs(d(c)) < float("inf")
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for df, c in ((points, at), (ranges, low), (ranges, high)))
    least, top = 0 if whole else LEAST, MOST + 1
    length = d(high) - d(low)
    # the logarithm of 0 is null
    level = F.when(finite(low) & finite(high) & (length <= 2.0**MOST), F.greatest(F.lit(least), F.coalesce(F.ceil(F.log2(length)).cast("int"), F.lit(least)))).otherwise(F.lit(top))
    cell = lambda c: F.when(F.col("_level") == top, F.lit(0).cast("long")).otherwise(F.floor(d(c) / F.pow(F.lit(2.0), F.col("_level"))))
    ranges = ranges.where(_c(low) <= _c(high)).withColumn("_level", level)
    points = points.where(_c(at).isNotNull()).crossJoin(F.broadcast(ranges.select("_level").distinct()))
    points = points.where((F.col("_level") == top) | finite(at)).withColumn("_cell", cell(at))
    ranges = ranges.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return pairs_by_cell(points, ranges, ["_level", "_cell"], at, low)
