"""The operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, counts, langid, linededup, media, mixing, neardup, packing, urlfilter
from .common import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def tuned(query: Query) -> Query:
    """A query in a session whose batches to Python are small."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


OPERATORS: dict[str, Query] = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_token_counts": counts.op2_token_counts,
    "op3_packing": packing.op3_packing,
    "op4_near_dedup": neardup.op4_near_dedup,
    "op5_media": media.op5_media,
    "op6_nearest": ann.op6_nearest,
    "op7_language_id": langid.op7_language_id,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_url_filter": urlfilter.op10_url_filter,
}

QUERIES: dict[str, Query] = {name: tuned(query) for name, query in OPERATORS.items()}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat.OP1_SQL,
    "op4_near_dedup": neardup.OP4_SQL,
    "op8_line_dedup": linededup.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_url_filter": urlfilter.OP10_SQL,
}
