"""Approximate nearest neighbours: a small-world graph per shard, results merged by rank.

Rows with equal vectors form a class that is indexed once; of a class only the ``k + 1``
smallest ids can ever be among a query's ``k`` nearest, so it carries no more.

Classes are dealt into cells by nearest centre, and cells of more than ``SHARD_ROWS`` into
shards by a hash.  Vectors get one more component for this, so that cells part long vectors
from short ones as well as directions.  A shard's graph is one row of flat arrays in a
written table.

A query goes to the cells that promise most.  How many, and how wide the beam is within a shard, is
measured: a bounded number of the queries is answered by brute force over all rows, and both grow
until these find what they should.  Data without any structure end with every cell, as they
must; the widest beam takes a shard whole, which is exact.  A graph stays in its task and
its queries come past it in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, map_arrow, materialize, salted_join
from .hnsw import BEAM, Graph

#: A shard has about so many classes at most; small inputs have the least number of cells.  A row per cell may be
#: sent to every task, one per shard may not.
SHARD_ROWS = 8192
LEAST_CELLS, MOST_CELLS = 16, 16_384
#: Centres are fitted on the driver on a sample of so many bytes at most, and at least 16 rows a centre.
FIT_BYTES = 64 << 20
FIT_ROUNDS = 8
#: So many queries are answered by brute force as well, to set the number of cells and the beam.
PROBES = 256
#: Share of the probes' true neighbours in the cells they go to, and share found there.
IN_CELLS, FOUND = 0.99, 0.95
#: Queries that meet a shard's graph at a time.
QUERY_ROWS = 4096
INDEX = "cell int, shard int, ids binary, vectors binary, kind string, sizes array<int>, members binary, neighbours binary"
NEAREST = "query_id long, rank int, vec_id long, score double"


def vector_keys(rows: DataFrame, id_col: str, vec_col: str, dim: int | None) -> DataFrame:
    """(id, key, vector) of the vectors that take part; vector is little-endian bytes."""
    double = dict(rows.dtypes)[vec_col] == "array<double>"

    def keys(batches):
        for batch in batches:
            ids, out, vecs = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or len(v) != dim or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8" if double else "<f4")
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vecs.append(x.tobytes())
                    out.append(xxhash.xxh3_128_digest(vecs[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(vecs, pa.binary())], ["id", "key", "vector"])

    return map_arrow(rows.select(F.col(id_col).cast("long"), F.col(vec_col)), keys, "id long, key binary, vector binary")


def matrix(vectors, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(-1, dim)


@dataclass
class Cells:
    """Centres of the cells, and what a cell's members look like; at most about ``FIT_BYTES / 16``."""

    length: float  # vectors are lifted to this length; longer ones are scaled down to it
    centres: np.ndarray  # (cells, dim + 1), of length 1
    means: np.ndarray  # (cells, dim)
    spread: np.ndarray  # (cells,): root mean square of a member's distance from the mean along any one direction

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, seed: int = 1) -> Cells:
        """Spherical k-means of a sample."""
        x = sample.astype(np.float32)
        length = float(np.quantile(np.linalg.norm(x, axis=1), 0.999)) if len(x) else 1.0
        out = cls(length or 1.0, np.zeros((0, x.shape[1] + 1), np.float32), x[:0], np.zeros(0))
        up = out.lift(x)
        out.centres = up[np.random.default_rng(seed).permutation(len(up))[:cells]].copy()
        for turn in range(FIT_ROUNDS + 1):
            own = out.of(up)
            if turn == FIT_ROUNDS:
                break
            for c in np.unique(own):
                mean = up[own == c].sum(axis=0)
                if size := np.linalg.norm(mean):
                    out.centres[c] = mean / size
        n = np.bincount(own, minlength=len(out.centres))[:, None]
        total = np.zeros((len(out.centres), x.shape[1]), np.float32)
        np.add.at(total, own, x)
        out.means = total / np.maximum(n, 1)
        off = np.zeros(len(out.centres))
        np.add.at(off, own, ((x - out.means[own]) ** 2).mean(axis=1))
        out.spread = np.sqrt(off / np.maximum(n[:, 0], 1))
        return out

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors of length 1 with one more component; it is 0 for those of ``length`` or more."""
        x = x.astype(np.float32)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        up = np.concatenate([x, np.sqrt(np.maximum(self.length**2 - size**2, 0))], axis=1)
        return up / np.maximum(np.linalg.norm(up, axis=1, keepdims=True), 1e-30)

    def of(self, lifted: np.ndarray, block: int = 4096) -> np.ndarray:
        return np.concatenate([(lifted[at : at + block] @ self.centres.T).argmax(axis=1) for at in range(0, len(lifted), block)] or [np.zeros(0, np.int64)])

    def best(self, queries: np.ndarray, most: int) -> np.ndarray:
        """Each query's ``most`` cells by the inner product that their best members may have, best first."""
        q = queries.astype(np.float32)
        hope = q @ self.means.T + 3 * np.linalg.norm(q, axis=1, keepdims=True) * self.spread[None, :]
        if most < hope.shape[1]:
            top = np.argpartition(-hope, most - 1, axis=1)[:, :most]
            return np.take_along_axis(top, np.argsort(-np.take_along_axis(hope, top, 1), axis=1, kind="stable"), 1)
        return np.argsort(-hope, axis=1, kind="stable")


def build_index(placed: DataFrame, kind: str, dim: int) -> DataFrame:
    """One row of flat arrays per shard from (rep, vector, cell, shard)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        return pd.DataFrame([{"cell": pdf["cell"].iloc[0], "shard": pdf["shard"].iloc[0], **Graph.build(pdf["rep"].to_numpy(), matrix(pdf["vector"], kind, dim)).to_row()}])

    return placed.select("rep", "vector", "cell", "shard").groupBy("shard").applyInPandas(build, INDEX)


class Index:
    """The graphs by shard, and how queries get to them."""

    def __init__(self, classes: DataFrame, n: int, kind: str, dim: int, work: Scratch) -> None:
        self.spark, self.kind, self.dim, self.work = classes.sparkSession, kind, dim, work
        cells = max(1, min(max(LEAST_CELLS, -(-n // SHARD_ROWS)), MOST_CELLS, FIT_BYTES // (64 * dim), n))
        rows = min(FIT_BYTES // (4 * dim), max(4096, 64 * cells))
        share = min(1 << 30, rows * (1 << 30) // n)
        sample = classes.where(F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1 << 30)) < share).select("rep", "vector").collect()
        sample = sample or classes.select("rep", "vector").orderBy("rep").limit(1).collect()
        self.cells = Cells.fit(matrix([r["vector"] for r in sorted(sample)], kind, dim), cells)
        placed = work.keep(self._placed(classes), "ann-placed")
        # a row per cell, so bounded as the centres are
        counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
        at, table = 0, []
        for c in sorted(counts):
            parts = -(-counts[c] // SHARD_ROWS)
            table.append((c, at, parts))
            at += parts
        self.parts = self.spark.createDataFrame(table, "cell int, shard0 int, parts int")
        dealt = placed.join(F.broadcast(self.parts), "cell")
        dealt = dealt.withColumn("shard", (F.col("shard0") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int"))
        self.placed = placed
        self.graphs = work.keep(build_index(dealt, kind, dim), "ann-index")
        self.n_cells, self.beam, self.recall = cells, BEAM, None

    def _placed(self, classes: DataFrame) -> DataFrame:
        sent, kind, dim = self.spark.sparkContext.broadcast(self.cells), self.kind, self.dim

        def place(batches):
            for batch in batches:
                own = sent.value.of(sent.value.lift(matrix(batch.column(1).to_pylist(), kind, dim)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], ["rep", "vector", "cell"])

        return map_arrow(classes.select("rep", "vector"), place, "rep long, vector binary, cell int")

    def calibrate(self, queries: DataFrame, k: int) -> None:
        """Set the number of cells and the beam on at most ``PROBES`` of the queries (query, vector)."""
        probes = queries.orderBy(F.xxhash64("query", F.lit("probe")), "query").limit(PROBES).collect()
        if not probes:
            return
        q = matrix([r["vector"] for r in probes], self.kind, self.dim)
        true = self._true(q, k)
        ranked = self.cells.best(q, len(self.cells.centres))
        place = np.argsort(ranked, axis=1)
        at = np.sort(np.asarray([place[i, c] for i, near in enumerate(true) for _, c in near]))
        self.n_cells = int(at[min(len(at) - 1, int(np.ceil(IN_CELLS * len(at))) - 1)]) + 1
        asked = self.spark.createDataFrame([(i, bytes(r["vector"])) for i, r in enumerate(probes)], "query long, vector binary")
        wanted = {(i, rep) for i, near in enumerate(true) for rep, _ in near}
        while True:
            found = {(r["query"], r["rep"]) for r in self.search(asked, k).select("query", "rep").collect()}
            self.recall = len(found & wanted) / len(wanted)
            if self.recall >= FOUND or self.beam >= 2 * SHARD_ROWS:
                return
            self.beam *= 2

    def _true(self, q: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """(rep, cell) of each probe's ``k`` nearest classes by brute force: each task sends its best."""
        kind, dim = self.kind, self.dim

        def best(batches):
            rep, cell, score = (np.zeros((len(q), 0), t) for t in (np.int64, np.int32, np.float64))
            for batch in batches:
                sim = q.astype(np.float64) @ matrix(batch.column(1).to_pylist(), kind, dim).astype(np.float64).T
                wide = [np.tile(batch.column(c).to_numpy(), (len(q), 1)) for c in (0, 2)]
                rep, cell, score = (np.concatenate(p, axis=1) for p in ((rep, wide[0]), (cell, wide[1]), (score, sim)))
                top = np.lexsort((rep, -score), axis=1)[:, :k]
                rep, cell, score = (np.take_along_axis(v, top, 1) for v in (rep, cell, score))
            who = np.repeat(np.arange(len(q)), rep.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), *(pa.array(v.ravel()) for v in (rep, cell, score))], ["query", "rep", "cell", "score"])

        rows = map_arrow(self.placed.select("rep", "vector", "cell"), best, "query long, rep long, cell int, score double")
        out: list[list[tuple[int, int]]] = [[] for _ in q]
        for r in _top(rows, k).collect():
            out[r["query"]].append((r["rep"], r["cell"]))
        return out

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, rep, score): each query's nearest ``k`` classes found; queries: (query, vector)."""
        sent, kind, dim, n_cells, beam = self.spark.sparkContext.broadcast(self.cells), self.kind, self.dim, self.n_cells, self.beam

        def route(batches):
            for batch in batches:
                if batch.num_rows:
                    own = sent.value.best(matrix(batch.column(1).to_pylist(), kind, dim), n_cells).astype(np.int32)
                    cells = pa.ListArray.from_arrays(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32), pa.array(own.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, cells], ["query", "vector", "cells"])

        routed = self.work.keep(map_arrow(queries.select("query", "vector"), route, "query long, vector binary, cells array<int>"), "ann-routed")
        # a row per cell; a graph is repeated only where more than QUERY_ROWS queries ask for it
        asked = routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        cells = F.broadcast(self.work.keep(self.parts.join(asked, "cell"), "ann-asked-cells"))
        dealt = routed.select("query", "vector", F.explode("cells").alias("cell")).join(cells, "cell")
        dealt = dealt.select("query", "vector", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.col("shard0"), F.col("shard0") + F.col("parts") - 1)).alias("shard"))
        graphs = self.graphs.join(cells.select("cell", "blocks"), "cell")
        graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "cell")

        def look(graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            if not len(graph) or not len(block):
                return pd.DataFrame({"query": [], "rep": [], "score": []}).astype({"query": "int64", "rep": "int64", "score": "float64"})
            who, rep, score = Graph.from_row(graph.iloc[0]).search(matrix(block["vector"], kind, dim), k, beam)
            return pd.DataFrame({"query": block["query"].to_numpy()[who], "rep": rep, "score": score})

        hits = graphs.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(look, "query long, rep long, score double")
        return _top(hits, k)


def _top(hits: DataFrame, k: int, tie: str = "rep") -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), tie)
    return hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def nearest(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest other rows found: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a column over the ids.  The score is the inner product in double
    precision; ties go to the smaller id.  With fewer candidates than ``k`` all are given.

    Rows with a null id, and vectors that are null, all zero or hold null, NaN or infinite
    components take no part, as query or candidate; nor do vectors of another length than
    the most frequent one (ties: the longer).  Repeated rows are candidates of their own,
    but a query never finds its own id.  Tables without vectors give an empty result.
    """
    spark = rows.sparkSession
    lengths = rows.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if not most or not most["d"]:
        return spark.createDataFrame([], NEAREST)
    kind, dim = "<f8" if dict(rows.dtypes)[vec_col] == "array<double>" else "<f4", most["d"]
    work = Scratch(spark)
    keyed = work.keep(vector_keys(rows, id_col, vec_col, dim), "ann-vectors")
    classes = work.keep(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")), "ann-classes")
    n_classes = classes.count()
    if not n_classes:
        return spark.createDataFrame([], NEAREST)
    few = keyed.select("key", "id").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # the queries by class: one search for all that share a vector
    asked = materialize(keyed.where(is_query(F.col("id"))).select("key", "id"), "ann-asked")
    per_key = materialize(asked.groupBy("key").agg(F.count("*").alias("n_asked")), "ann-asked-keys")
    total = asked.count()
    index = Index(classes, n_classes, kind, dim, work)
    queries = work.keep(classes.join(per_key, "key").select(F.col("rep").alias("query"), "key", "vector"), "ann-queries")
    index.calibrate(queries, k + 1)
    hits = index.search(queries, k + 1)
    # a class stands for its smallest ids, all with its score
    hits = hits.join(classes.select("rep", "key"), "rep").join(few, "key").select("query", "score", F.explode("ids").alias("vec_id"))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    lists = materialize(lists.join(queries.select("query", "key"), "query").select("key", "near"), "ann-lists")
    work.drop()
    out = salted_join(asked, lists, "key", hot_keys(per_key, "key", "n_asked", total), F.xxhash64("id"))
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(own).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, lambda i: F.pmod(i, F.lit(20)) == 0)
