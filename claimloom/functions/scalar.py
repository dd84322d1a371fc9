"""Scalar functions that rules and views use."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Named sizes of time bins in minutes (fixed values).
BIN_MINUTES = {"1d": 1440, "1h": 60, "15m": 15, "1m": 1}


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """NFC, stripped and case-folded; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFC", t).strip().casefold(), na_action="ignore")


def candidates(values: DataFrame, column: str, wanted: str, limit: int | None, mode: str = "normalized") -> tuple[DataFrame, bool]:
    """Distinct values that match a text exactly, normalised or by prefix, and whether more than ``limit`` do (None: all are given)."""
    want = unicodedata.normalize("NFC", wanted).strip().casefold()
    col = F.col(column)
    test = {"exact": lambda: col == wanted, "normalized": lambda: casefold(col) == want, "prefix": lambda: F.startswith(casefold(col), F.lit(want))}[mode]()
    found = values.select(column).distinct().where(test).orderBy(column)
    if limit is None:
        return found, False
    found = found.limit(limit + 1)
    return found.limit(limit), found.count() > limit


def bin_size(text: str) -> timedelta:
    """``P<n>D``, ``PT<n>H``, ``PT<n>M``, or one of the named sizes."""
    if text in BIN_MINUTES:
        return timedelta(minutes=BIN_MINUTES[text])
    for pattern, unit in ((r"P(\d+)D", "days"), (r"PT(\d+)H", "hours"), (r"PT(\d+)M", "minutes")):
        if (m := re.fullmatch(pattern, text)) and int(m[1]) > 0:
            return timedelta(**{unit: int(m[1])})
    raise ValueError(f"not a bin size: {text}")


def floor_bin(ts: Column, start: Column, step: timedelta) -> Column:
    """The bin (from 0) in which a timestamp falls."""
    return F.floor((F.unix_micros(ts) - F.unix_micros(start)) / F.lit(step // timedelta(microseconds=1))).cast("long")


def ceil_bin(ts: Column, start: Column, step: timedelta) -> Column:
    """The first bin that begins at or after a timestamp."""
    return F.ceil((F.unix_micros(ts) - F.unix_micros(start)) / F.lit(step // timedelta(microseconds=1))).cast("long")


def is_iso8601(text: Column) -> Column:
    """An ISO date, or a date and time with a time zone, that exists."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2}))?$")
    full = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")  # casts want seconds before a zone
    return F.coalesce(shape & full.try_cast("timestamp").isNotNull(), F.lit(False))


def template(text: str, fields: Sequence[str]) -> Column:
    """``%name`` in a text replaced by the columns of these names; null shows as nothing."""
    parts = re.split("(" + "|".join("%" + re.escape(f) + r"\b" for f in sorted(fields, key=len, reverse=True)) + ")", text) if fields else [text]
    return F.concat(*[F.coalesce(F.col(f"`{p[1:]}`").cast("string"), F.lit("")) if p[:1] == "%" and p[1:] in fields else F.lit(p) for p in parts])


def apply_function(df: DataFrame, fn: Callable, inputs: Sequence[str], out: str, kind: str, check: bool = False) -> DataFrame:
    """Add ``out = fn(*inputs)``, called once for each distinct input.

    ``fn`` is pure and total.  ``check`` calls it twice and raises where the results differ.
    """

    def run(*cols: pd.Series) -> pd.Series:
        rows = list(zip(*(c.tolist() for c in cols), strict=True))
        got = [fn(*r) for r in rows]
        if check and got != [fn(*r) for r in rows]:
            raise ValueError("the function is not deterministic")
        return pd.Series(got)

    distinct = df.select(*inputs).distinct()
    results = distinct.withColumn(out, F.pandas_udf(run, kind)(*[F.col(c) for c in inputs]))
    tag = {c: f"_in_{c}" for c in inputs}
    on = [F.col(c).eqNullSafe(F.col(t)) for c, t in tag.items()]
    return df.join(results.withColumnsRenamed(tag), on).drop(*tag.values())
