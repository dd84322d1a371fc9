"""What the operators share: the shared work folder, materialised tables, hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Files, Scratch, drop_path, fresh_path, materialize, work_dir

__all__ = ["Files", "Scratch", "ascii_lower", "drop_path", "fresh_path", "hot_keys", "hot_of", "map_arrow", "materialize", "salted_join", "small_batches", "words_of", "work_dir"]

#: Inside brackets of a regular expression: the white space that separates words.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Number of ``[^ \\t-\\r]+`` words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as the data contracts ask for; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def hot_keys(counts: DataFrame, key: str, n: str, total: int, most: int = 2000, least: int = 500) -> DataFrame:
    """Keys with so many rows that one task would feel them, and in how many parts to deal each.

    At most ``most`` keys can have more than ``total / most`` rows, so the result
    has a proven bound and may be broadcast.
    """
    limit = max(least, -(-total // most))
    return counts.where(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).cast("int").alias("_parts"))


def hot_of(rows: DataFrame, key: str) -> DataFrame:
    """The hot keys of a written table."""
    return hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), key, "n", rows.count())


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """Join where ``left`` may have very many rows for a key and ``right`` has one.

    ``hot`` comes from :func:`hot_keys`: rows of those keys in ``left`` are dealt
    over ``_parts`` salts by ``spread``; ``right``'s row is repeated for each salt.
    """
    one = F.lit(1)
    hot = F.broadcast(hot)
    left = left.join(hot, key, "left").withColumn("_salt", F.pmod(spread, F.coalesce("_parts", one)).cast("int")).drop("_parts")
    right = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", one) - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark send rows to Python in batches fit for long texts, where the session has Spark's own default.

    For applications, which own the session: operators leave its settings alone.  A plan takes the
    setting when it is run, so it has to stay; workers keep what their largest batch took.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 1000) -> DataFrame:
    """``mapInArrow`` over batches of at most ``rows`` rows, whatever the session's batches are.

    The function gets slices, so a step over long texts builds its results for few of them at a time.
    """

    def sliced(batches):
        def parts():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows)

        return function(parts())

    return df.mapInArrow(sliced, schema)
