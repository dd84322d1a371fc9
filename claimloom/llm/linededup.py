"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table of line keys, laid out in a fixed number of hash buckets and sorted by key
within each: the lines that some batches brought, each with the document that keeps it.  A new
batch is shuffled by key into the same buckets and merged with each run bucket by bucket, so what is known
already is read in place and never shuffled again.  Its lines found there are repeats, the others become
a new run of the lowest level.  When a level has ``FANOUT`` runs they are compacted into one of the next, so a
line is rewritten once a level and a batch meets few runs.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, drop_path, fresh_path, hot_keys, map_arrow, materialize, salted_join

FANOUT = 3
#: Batches of one call; more than ``FANOUT``, so later ones meet a compacted run.
BATCHES = 6
MIN_CHARS = 10
WHITE = b" \t\n\x0b\x0c\r"
#: owner keeps the line; known: an earlier run has it; first, last, n: of the batch's documents that hold it.
RUN_COLUMNS = "key BINARY, owner BIGINT, known BOOLEAN, first BIGINT, last BIGINT, n BIGINT"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the stripped line with A-Z lower-cased; None if it is too short."""
    line = line.strip(WHITE)
    if len(line) < min_chars or (not line.isascii() and len(line.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())  # lower() of bytes touches A-Z only


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key): each document's distinct keys.  Null ids and texts give none."""

    def keys(batches):
        for batch in batches:
            ids, out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if doc is not None and text:
                    found = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                    ids += [doc] * len(found)
                    out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "key"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), keys, "doc_id long, key binary")


class LineRuns:
    """The runs by level, and the batches that went into them.

    ``buckets`` (else the session's number of shuffle partitions) is fixed for all runs; where a
    session asks for more partitions than that, Spark shuffles the runs for parallelism.  Runs
    that a compaction took the place of are only listed as ``retired``: save :meth:`manifest`,
    then call :meth:`clean`.  A job that ends in between finds all that its last manifest names.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches: list[str] = []
        self.retired: list[str] = []

    def manifest(self) -> str:
        """What :meth:`restore` needs to go on from the stored runs."""
        return json.dumps({k: getattr(self, k) for k in ("fanout", "buckets", "levels", "batches", "retired")})

    @classmethod
    def restore(cls, spark: SparkSession, manifest: str) -> LineRuns:
        said = json.loads(manifest)
        runs = cls(spark, said["fanout"], said["buckets"])
        runs.levels, runs.batches, runs.retired = said["levels"], said["batches"], said["retired"]
        return runs

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def clean(self) -> None:
        """Delete retired runs."""
        for path in self.retired:
            self._forget(path)
        self.retired = []

    def delete(self) -> None:
        """Delete all runs."""
        self.retired += self.paths()
        self.levels = []
        self.clean()

    @staticmethod
    def _name(path: str) -> str:
        return "claimloom_run_" + hashlib.sha256(path.encode()).hexdigest()[:32]

    def _forget(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")
        drop_path(self.spark, path)

    def run(self, path: str) -> DataFrame:
        """A run as a table of the session's catalog, which is where Spark knows its buckets from."""
        name = self._name(path)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({RUN_COLUMNS}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, level: int) -> str:
        path = fresh_path(self.spark, f"line-run-{level}")
        rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).option("compression", "zstd").saveAsTable(self._name(path))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        return path

    def _compact(self, level: int = 0) -> None:
        """Full levels become one run of the next; a key is in one run only, so this is a sorted rewrite."""
        if level >= len(self.levels) or len(self.levels[level]) < self.fanout:
            return
        old, self.levels[level] = self.levels[level], []
        rows = reduce(DataFrame.unionByName, [self.run(p).where("NOT known").select("key", "owner") for p in old]).repartition(self.buckets, "key")
        owner = F.col("owner")
        self._write(rows.select("key", "owner", F.lit(False).alias("known"), owner.alias("first"), owner.alias("last"), F.lit(0).cast("long").alias("n")), level + 1)
        self.retired += old
        self._compact(level + 1)

    def add(self, batch: str, lines: DataFrame) -> DataFrame:
        """Merge a batch's (doc_id, key) rows; returns the batch's run (see ``RUN_COLUMNS``).

        A batch that went in before is refused with ValueError, so that a retried job
        cannot take its own lines for repeats.
        """
        if batch in self.batches:
            raise ValueError(f"batch {batch} is in the runs already")
        rows = lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        known = self.paths()
        for k, path in enumerate(known):
            rows = rows.join(self.run(path).where("NOT known").select("key", F.col("owner").alias(f"_{k}")), "key", "left")
        if not known:
            rows = rows.repartition(self.buckets, "key")
        found = F.coalesce(*[F.col(f"_{k}") for k in range(len(known))]) if known else F.lit(None).cast("long")
        path = self._write(rows.select("key", F.coalesce(found, "first").alias("owner"), found.isNotNull().alias("known"), "first", "last", "n"), 0)
        self.batches.append(batch)
        out = self.run(path)
        self._compact()
        return out


def line_drops(lines: DataFrame, run: DataFrame) -> DataFrame:
    """(doc_id, keys): the keys whose lines a batch's documents lose.  Very common lines are dealt out."""
    total = run.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    repeats = run.where("known OR first <> last").select("key", "owner", "n")
    found = salted_join(lines, repeats.select("key", "owner"), "key", hot_keys(repeats, "key", "n", total), F.xxhash64("doc_id"))
    return found.where("doc_id <> owner").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def drop_lines(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``kept`` (the other lines joined again), ``n_lines`` and ``n_dropped``."""
    joined = docs.join(drops.withColumnsRenamed({"doc_id": "_doc", "keys": "_keys"}), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    others = [c for c in joined.columns if c not in ("_keys", "kept", "n_lines", "n_dropped")]
    fields = joined.select(*others).schema
    spark_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", kept string, n_lines long, n_dropped long"
    at = others.index("text")

    def apply(batches):
        for batch in batches:
            kept, n, lost = [], [], []
            for text, keys in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(others)).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                gone = set(keys or ())
                left = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                kept.append(b"\n".join(left))
                n.append(len(lines))
                lost.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())], [*others, "kept", "n_lines", "n_dropped"])

    return map_arrow(joined.select(*others, "_keys"), apply, spark_schema)


def dedup_lines(docs: DataFrame, n_batches: int = BATCHES, min_chars: int = MIN_CHARS, runs: LineRuns | None = None) -> DataFrame:
    """Add ``kept``, ``n_lines``, ``n_dropped`` to every row of ``docs`` (doc_id, text, ...).

    The documents go in as ``n_batches`` batches by ranges of doc_id, lowest first, so a
    line's owner is the smallest doc_id that holds it.  With ``runs`` of earlier batches
    their documents own their lines; save its manifest and clean it afterwards.  Lines whose key
    is shorter than ``min_chars`` code points stay.

    A null or empty text is one empty line.  Rows of one doc_id count as one document and
    lose no line to each other; rows with a null doc_id are kept whole and own nothing.
    Other columns stay; those named like the added ones are replaced.
    """
    spark = docs.sparkSession
    lines_of, own_runs = Scratch(spark), runs is None
    runs = runs or LineRuns(spark)
    lines = line_table(docs.select("doc_id", "text"), min_chars)
    edges = sorted(set(docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [k / n_batches for k in range(1, n_batches)], 0.01))) if n_batches > 1 else []
    batch = reduce(lambda c, e: c + (F.col("doc_id") > F.lit(int(e))).cast("int"), edges, F.lit(0))
    path = fresh_path(spark, "lines")
    lines_of.paths.append(path)
    lines.withColumn("batch", batch).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema("doc_id long, key binary, batch int").parquet(path)
    drops = []
    for k in range(len(edges) + 1):
        own = lines.where(F.col("batch") == k).select("doc_id", "key")
        drops.append(materialize(line_drops(own, runs.add(f"{path}/{k}", own)), "line-drops"))
    # what follows reads the drops alone
    lines_of.drop()
    if own_runs:
        runs.delete()
    return drop_lines(docs, reduce(DataFrame.unionByName, drops), min_chars)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
x AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM x WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT x.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE o.owner IS NOT NULL AND x.doc_id <> o.owner)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE o.owner IS NULL OR x.doc_id = o.owner), '')) AS kept_sha256
FROM x LEFT JOIN o ON x.key = o.key GROUP BY x.doc_id
"""
