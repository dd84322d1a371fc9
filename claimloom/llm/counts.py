"""Token counts as delta-maintained rollups.

A batch is a set of signed changes: an insert adds a document's tokens, a delete takes
them away, a revised count does both.  Totals are sums, so a batch is first summed per
source, language and tokenizer version, and only those few rows are stored.  A batch is
committed by creating one small file of its name, once, that says which folder holds its sums: a job
that is retried, or a batch that comes again, finds the name taken and changes nothing.  Reading sums the
compacted base and the batches that it does not hold yet.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Files, fresh_path, map_arrow, words_of
from .tokens import default_path, tokenizer

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def bpe_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``n_tokens``, the number of ids of each whole text; null and empty texts have 0.

    Other columns stay; a column ``n_tokens`` is replaced.
    """
    path = path or default_path()
    kept = [c for c in docs.columns if c != "n_tokens"]
    rows = docs.select(*kept)
    at = kept.index("text")

    def count(batches):
        n = tokenizer(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n(t) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())], [*kept, "n_tokens"])

    return map_arrow(rows, count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", n_tokens long")


def changes(inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Signed changes from rows with source, lang, tokenizer and n_tokens; a revised count is one of each."""
    signed = [d.select(*KEYS, F.lit(s).cast("long").alias("docs"), (F.lit(s) * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("tokens")) for d, s in ((inserts, 1), (deletes, -1)) if d is not None]
    return signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])


@dataclass(frozen=True)
class State:
    """What one listing of a rollup's folder shows: the newest base, the batches it holds, and the others with their folders."""

    number: int
    base: str | None
    held: frozenset[str]
    retired: tuple[str, ...]  # folders that the base has taken the place of
    open: dict[str, str]


class TokenRollup:
    """Totals by source, language and tokenizer version in a folder of shared storage.

    Null sources and languages are keys of their own.  Totals that come to 0 documents and
    0 tokens are left out.  An empty batch is a batch.

    ``commits/<batch>`` names a batch's folder and ``bases/<number>`` a compacted base's; both are
    created whole and never changed.  All that an operation reads comes from one listing, so
    a commit that enters meanwhile is simply not part of it.  What a base takes the place of is
    deleted by the compaction after it, so totals that were asked for before can still be read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._files = Files(spark, self.path)
        for folder in ("commits", "bases"):
            self._files.make(f"{self.path}/{folder}")

    @staticmethod
    def _name(batch: str) -> str:
        return hashlib.sha256(batch.encode()).hexdigest()

    def state(self) -> State:
        """The newest base is read first: a batch may then be both in it and in the listing, never in neither."""
        bases = [n for n in self._files.names(f"{self.path}/bases") if n.isdigit()]
        said = json.loads(self._files.read(f"{self.path}/bases/{bases[-1]}")) if bases else {"folder": None, "batches": [], "retired": []}
        held = frozenset(said["batches"])
        found = [n for n in self._files.names(f"{self.path}/commits") if len(n) == 64 and n not in held]
        return State(int(bases[-1]) if bases else -1, said["folder"], held, tuple(said["retired"]), {n: self._files.read(f"{self.path}/commits/{n}") for n in found})

    def batches(self) -> set[str]:
        """Names (hashed) of all batches committed, compacted or not."""
        now = self.state()
        return set(now.held) | set(now.open)

    def _staged(self) -> str:
        return f"{self.path}/sums/{uuid.uuid4().hex}"

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Add a batch of signed changes; False, and no work, if it is there already."""
        name = self._name(batch)
        if name in self.batches():
            return False
        staged = self._staged()
        sums = delta.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(staged)
        if self._files.create(f"{self.path}/commits/{name}", staged):
            return True
        self._files.delete(staged)
        return False

    def totals(self, state: State | None = None) -> DataFrame:
        now = state or self.state()
        paths = sorted(now.open.values()) + ([now.base] if now.base else [])
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")

    def compact(self) -> bool:
        """Fold the batches that are there now into a new base; False if another compaction came first.

        The commit files stay, as names that are taken.  What the base before had taken the place of
        is deleted now.
        """
        now = self.state()
        staged = self._staged()
        self.totals(now).write.parquet(staged)
        said = {"folder": staged, "batches": sorted(now.held | set(now.open)), "retired": sorted(now.open.values()) + ([now.base] if now.base else [])}
        if not self._files.create(f"{self.path}/bases/{now.number + 1:012d}", json.dumps(said)):
            self._files.delete(staged)
            return False
        for folder in now.retired:
            self._files.delete(folder)
        return True


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in counted in words; then every count is revised to BPE ids.

    The words stay as a version of their own, the revision is a delete and an insert of a
    provisional version, and both batches are committed twice to no effect.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text")
    rollup = TokenRollup(spark, fresh_path(spark, "token-rollup"))
    words = docs.select("source", "lang", words_of(F.col("text")).alias("n_tokens"))
    first = changes(words.withColumn("tokenizer", F.explode(F.array(F.lit("words-1"), F.lit("provisional")))))
    ids = bpe_counts(docs).withColumn("tokenizer", F.lit("byte_bpe_50k"))
    second = changes(ids, words.withColumn("tokenizer", F.lit("provisional")))
    for _ in range(2):
        rollup.commit("insert documents", first)
        rollup.commit("revise to byte_bpe_50k", second)
    rollup.compact()
    rollup.commit("insert documents", first)
    return rollup.totals().select(*KEYS, "docs", "tokens")
