"""Best-fit packing by large-item matching, planned on lengths and applied by rank.

Lengths are whole numbers up to the capacity, so a corpus is described for packing by
how many pieces of each length it has: a table of a bounded size, whatever the corpus.
The plan is made on that table: pieces above a third of the capacity are matched greedily
in pairs (a sequence never takes a third), then smaller ones go into the tightest gap
that takes them.  Equal sequences are planned together as a pattern with a count.  A
piece finds its place in the plan from its length and its rank among pieces of that
length, so neither the driver nor any one task gathers pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .tokens import default_path, tokenizer

CAPACITY = 1024
END_ID = 2
#: Ranks of a length are counted in parts of so many pieces at least, or else of the root of their number: then
#: neither a part nor the list of a length's parts grows in proportion.
LEAST_PART = 512


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, after a first of what is left over."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) for so many pieces of each length.

    Every step takes as many equal sequences at once as there are, so the number of
    patterns depends on the capacity alone.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    done: list[tuple[int, tuple[int, ...]]] = []
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    sizes: list[int] = []

    def put(n: int, pattern: tuple[int, ...]) -> None:
        gap = capacity - sum(pattern)
        if not gap:
            done.append((n, pattern))
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(sizes, gap)
        gaps[gap].append((n, pattern))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while n := left.get(a, 0):
            b = next((b for b in large if b <= capacity - a and left.get(b, 0) > (b == a)), None)
            if b is None:
                pairs, pattern = n, (a,)
            elif b == a:
                pairs, pattern = n // 2, (a, a)
            else:
                pairs, pattern = min(n, left[b]), (a, b)
            for k in pattern:
                left[k] -= pairs
            put(pairs, pattern)
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[a]
        while n:
            at = bisect_left(sizes, a)
            if at == len(sizes):  # no gap takes it: open sequences with as many of it as fit
                each = min(n, capacity // a)
                put(n // each, (a,) * each)
                n %= each
                continue
            gap = sizes[at]
            have, pattern = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            each = min(n, gap // a)  # the tightest gap stays the tightest while it takes more
            full = min(have, n // each)
            n -= full * each
            put(full, pattern + (a,) * each)
            if have > full:
                put(have - full, pattern)
    return done + [p for g in gaps.values() for p in g]


class Layout:
    """The plan as arrays: from length and rank to sequence and offset by binary search."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]) -> None:
        used: dict[int, int] = {}
        rows = []
        base = 0
        for n, lengths in patterns:
            at = 0
            for k in lengths:
                r = used.get(k, 0)
                rows.append((k << 44 | r, base - r, at))
                used[k] = r + n
                at += k
            base += n
        rows.sort()
        self.sequences = base
        self.keys, self.shift, self.offset = (np.asarray([r[i] for r in rows], np.int64) for i in range(3))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length << 44 | rank, "right") - 1
        return self.shift[at] + rank, self.offset[at]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and cut them: doc_id, piece, start, length, ids_crc32 (and ids)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def pieces(batches):
        encode = tokenizer(path).encode
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    own = ids[s : s + n]
                    for col, v in zip(cols, (doc, k, s, n, zlib.crc32(own.tobytes()), own.astype(np.int32)), strict=False):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), pieces, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``; other columns stay.

    ``pieces`` is read three times: pass a written table.  Ranks follow doc_id, piece and a hash of all
    columns, so reruns agree; only rows equal in every column are interchangeable.  Pieces are dealt over
    parts by that hash, so those with a null id spread too.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    # at most capacity rows come to the driver, and as many go to the tasks
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    layout = Layout(plan(counts, capacity))
    sent = spark.sparkContext.broadcast(layout)  # its size depends on the capacity only
    parts = spark.createDataFrame([(k, -(-n // max(LEAST_PART, isqrt(n)))) for k, n in counts.items()], "length long, _parts long")
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in pieces.schema if "map<" not in f.dataType.simpleString()])
    dealt = pieces.withColumn("_tie", whole).join(F.broadcast(parts), "length").withColumn("_part", F.pmod("_tie", "_parts")).drop("_parts")
    per = dealt.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = per.select("length", "_part", before.alias("_base"))
    own = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "_tie")) - 1
    ranked = dealt.withColumn("_own", own).join(bases, ["length", "_part"]).withColumn("_rank", (F.col("_base") + F.col("_own")).cast("long"))
    kept = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    at = kept.index("length")

    def place(batches):
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (at, len(kept)))
            seq, off = sent.value.place(n, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*kept, "sequence_id", "offset"])

    return map_arrow(ranked.select(*kept, "_rank"), place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    A null or empty text is the end id alone.  Only documents longer than the capacity are
    cut.  Rows with the same doc_id are packed each on its own; a null doc_id stays null.
    With ``keep_ids`` the tokens come along; a sequence is then its pieces by offset.
    ``path`` names a vocabulary that every executor can open.
    """
    path = path or default_path()
    return pack(materialize(pieces_of(docs, path, capacity, end_id, keep_ids), "pieces"), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
