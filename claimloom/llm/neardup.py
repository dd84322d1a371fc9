"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes a set of shingles and a MinHash signature.  Equal sets form a
   class with one representative; only representatives are compared.
2. Signatures are cut into bands; representatives that agree on a band share a bucket.
3. First round: a bucket's leader is the member that shares most buckets with others, which
   in a group of edited copies is the text they were made from.  Each representative is checked
   against the one leader that it shares most buckets with.  That joins most of a large group
   by a number of pairs that grows with the group, not with its square.
4. Second round: in buckets that still hold several components, pairs across components are
   compared; pairs within a component are never looked at.  Small buckets give their few pairs,
   large ones are compared in blocks that give only the pairs that are similar.
5. A pair's signatures are compared batch by batch, and the pair is dropped once the
   posterior chance that it is similar enough falls below ``miss``.  What survives is
   verified exactly on the full sets.  Components are joined by repeated minimum.

All steps are joins and aggregations of tables; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, hot_of, map_arrow, materialize, salted_join
from .shingles import collisions, least_matches, near, overlap, set_key, shingle_set, signature, survivors

#: A bucket of at most so many members gives its pairs as rows; a larger one is compared in blocks.
SMALL = 16
BLOCK = 256
#: So many ids (8 bytes each) may be sent to every task to pick texts; more are joined by a shuffle.
MAX_SENT_IDS = 1_000_000


@dataclass(frozen=True)
class NearDup:
    """Parameters.  A pair at exactly ``percent`` shares no band with chance (1 - s^rows)^bands, here 1e-6."""

    words: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6
    batch: int = 36
    miss: float = 1e-6

    @property
    def places(self) -> int:
        return self.bands * self.rows

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = overlap(a, b)
        return 100 * common >= self.percent * (len(a) + len(b) - common) > 0


def signatures(docs: DataFrame, p: NearDup) -> DataFrame:
    """(doc_id, n_shingles, key, sig); key and sig are null for texts without words."""

    def sign(batches):
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingle_set(text or b"", p.words)
                sizes.append(len(found))
                keys.append(set_key(found) if len(found) else None)
                sigs.append(signature(found, p.places).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "key", "sig"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), sign, "doc_id long, n_shingles long, key binary, sig binary")


def buckets(reps: DataFrame, p: NearDup, work: Scratch) -> DataFrame:
    """(bucket, band, doc_id, n, first) of buckets with two representatives or more; first: their leader."""
    width = 2 * p.rows
    bands = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda b: F.xxhash64(F.substring(F.col("sig"), b * width + 1, F.lit(width)), b))
    dealt = reps.select("doc_id", F.posexplode(bands).alias("band", "bucket"))
    sizes = work.keep(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "dup-buckets")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hot_keys(sizes, "bucket", "n", total)
    members = work.keep(salted_join(dealt, sizes, "bucket", hot, F.xxhash64("doc_id")), "dup-members")
    central = members.groupBy("doc_id").agg(F.sum("n").alias("central"))
    leaders = members.join(central, "doc_id").groupBy("bucket").agg(F.max_by("doc_id", F.struct(F.col("central"), -F.col("doc_id"))).alias("first"))
    return salted_join(members, leaders, "bucket", hot, F.xxhash64("doc_id"))


def likely(pairs: DataFrame, sigs: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (a, b), a written table, that sequential comparison of their signatures leaves.

    A leader ``a`` may have very many pairs, so its signature goes to several tasks.
    """
    rules = least_matches(p.places, p.batch, p.percent / 100, p.miss)

    def compare(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, p.places) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 1)], ["a", "b"]).take(pa.array(survivors(left, right, rules), pa.int64()))

    both = pairs.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    both = salted_join(both, sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a", hot_of(pairs, "a"), F.xxhash64("b"))
    return map_arrow(both.select("a", "b", "sig_a", "sig_b"), compare, "a long, b long", 5000)


def verified(pairs: DataFrame, docs: DataFrame, p: NearDup, work: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, from the texts themselves."""
    pairs = work.keep(pairs.dropDuplicates(["a", "b"]), "dup-pairs")
    ids = work.keep(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "dup-ids")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    wanted = texts.join(F.broadcast(ids) if ids.count() <= MAX_SENT_IDS else ids, "doc_id", "left_semi")
    wanted = work.keep(wanted.dropDuplicates(["doc_id"]), "dup-texts")

    def check(batches):
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(doc: int, text) -> np.ndarray:
            if doc not in known:
                if len(known) > 64:
                    known.popitem(last=False)
                known[doc] = shingle_set(text.as_buffer().to_pybytes(), p.words)
            return known[doc]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [p.linked(shingles(x, batch.column(2)[k]), shingles(y, batch.column(3)[k])) for k, (x, y) in enumerate(zip(a, b, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    # a leader's text goes once to each task that has some of its pairs
    both = salted_join(both, wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a", hot_of(pairs, "a"), F.xxhash64("b"))
    return map_arrow(both.select("a", "b", "text_a", "text_b"), check, "a long, b long", 500)


def components(nodes: DataFrame, links: DataFrame, work: Scratch) -> DataFrame:
    """(doc_id, component): the smallest id that the links (a, b) reach; nodes without a link keep their own.

    Each step takes the smallest component among a node's neighbours and then that
    component's own, so distances shrink by doubling; each step is a written table, which the next
    replaces.  Nodes with very many links, and components with very many nodes, are dealt out.
    """
    links = work.keep(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "dup-links")
    hubs = work.keep(hot_of(links, "a"), "dup-hubs")
    loop = Scratch(work.spark)
    now = loop.keep(links.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.col("doc_id")).alias("component")), "dup-components")
    while True:
        said = salted_join(links, now.select(F.col("doc_id").alias("a"), "component"), "a", hubs, F.xxhash64("b"))
        near = said.groupBy(F.col("b").alias("doc_id")).agg(F.min("component").alias("near"))
        step = loop.keep(now.join(near, "doc_id").select("doc_id", F.col("component").alias("old"), F.least("component", "near").alias("mid")), "dup-step")
        jump = now.select(F.col("doc_id").alias("mid"), F.col("component").alias("far"))
        jumped = salted_join(step, jump, "mid", hot_of(step, "mid"), F.xxhash64("doc_id"))
        new = loop.keep(jumped.select("doc_id", F.least("mid", "far").alias("component"), (F.least("mid", "far") < F.col("old")).alias("moved")), "dup-components")
        now = new.select("doc_id", "component")
        done = new.where("moved").isEmpty()
        loop.drop(last=1)
        if done:
            break
    work.paths += loop.paths
    return nodes.join(now, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


def across(shared: DataFrame, found: DataFrame, sigs: DataFrame, docs: DataFrame, p: NearDup, work: Scratch) -> DataFrame:
    """Likely pairs (a, b) of different components that share a bucket.

    In a bucket's largest component members only meet members of the others, so a bucket
    that is nearly one component costs its size, not its square.
    """
    none = shared.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).where(F.lit(False))
    placed = shared.select("bucket", "band", "doc_id").join(found, "doc_id")
    per = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    most = per.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    most = work.keep(most, "dup-mixed")
    if most.isEmpty():
        return none
    few = placed.join(most.where(F.col("n") <= SMALL).select("bucket"), "bucket").select("bucket", "doc_id", "component")
    few = work.keep(few, "dup-few")
    other = few.select("bucket", F.col("doc_id").alias("b"), F.col("component").alias("of_b"))
    pairs = few.join(other, (few["bucket"] == other["bucket"]) & (few["doc_id"] < other["b"]) & (few["component"] != other["of_b"]))
    small = likely(work.keep(pairs.select(F.col("doc_id").alias("a"), "b").dropDuplicates(["a", "b"]), "dup-few-pairs"), sigs, p)
    large = most.where(F.col("n") > SMALL)
    if large.isEmpty():
        return small
    return small.unionByName(_blocks(placed, large, sigs, docs, p, work))


def _blocks(placed: DataFrame, large: DataFrame, sigs: DataFrame, docs: DataFrame, p: NearDup, work: Scratch) -> DataFrame:
    """The similar pairs across components of large buckets, each from the first band that it shares.

    A cell (i, j) compares block i of the smaller components with block j, for i <= j: by
    signature, then by the sets' 32-bit hashes.  These can only seem more similar than the
    sets are, so no link is lost, and few pairs are left for the exact check.
    """
    rules = least_matches(p.places, p.batch, p.percent / 100, p.miss)
    total = large.agg(F.sum("n")).first()[0]
    members = salted_join(placed, large, "bucket", hot_keys(large, "bucket", "n", total), F.xxhash64("doc_id"))
    blocks = F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int")  # of the smaller components
    mains = F.ceil(F.col("n_main") / BLOCK).cast("int")
    minor = F.col("component") != F.col("main")
    own = F.when(minor, F.pmod(F.xxhash64("doc_id"), blocks)).otherwise(blocks + F.pmod(F.xxhash64("doc_id"), mains)).cast("int")
    members = work.keep(members.select("bucket", "band", "doc_id", "component", minor.alias("minor"), own.alias("own"), blocks.alias("blocks"), (blocks + mains).alias("all_blocks")), "dup-large")
    ids = work.keep(members.select("doc_id").distinct(), "dup-large-ids")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    wanted = texts.join(F.broadcast(ids) if ids.count() <= MAX_SENT_IDS else ids, "doc_id", "left_semi")

    def shorten(batches):
        for batch in batches:
            sets = [np.unique((shingle_set(t, p.words) >> np.uint64(32)).astype("<u4")).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "hashes"])

    short = map_arrow(wanted, shorten, "doc_id long, hashes binary").dropDuplicates(["doc_id"])
    known = work.keep(short.join(sigs.select("doc_id", "sig"), "doc_id"), "dup-short")
    cells = F.when(
        F.col("minor"),
        F.array_union(
            F.transform(F.sequence(F.lit(0), F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))),
            F.transform(F.sequence(F.col("own"), F.col("all_blocks") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))
    rows = members.join(known, "doc_id").select("bucket", "band", "doc_id", "component", "sig", "hashes", "own", F.explode(cells).alias("cell"))
    rows = rows.select("bucket", "cell.i", "cell.j", "band", "own", "doc_id", "component", "sig", "hashes")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, band = (pdf[c].iloc[0] for c in ("i", "j", "band"))
        x, y = np.flatnonzero(pdf["own"] == i), np.flatnonzero(pdf["own"] == j)
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(-1, p.places)
        ids, comp = pdf["doc_id"].to_numpy(), pdf["component"].to_numpy()
        sets = [np.frombuffer(h, "<u4") for h in pdf["hashes"]]
        size = np.asarray([len(h) for h in sets])
        a, b = np.repeat(x, len(y)), np.tile(y, len(x))
        keep = (comp[a] != comp[b]) & ((ids[a] < ids[b]) | (i != j))
        # sizes as hashes count them may be too small by what collides
        spare = np.asarray([collisions(int(n)) for n in size], np.int64)
        keep &= 100 * (np.minimum(size[a], size[b]) + np.maximum(spare[a], spare[b])) >= p.percent * np.maximum(size[a], size[b])
        a, b = a[keep], b[keep]
        alive = survivors(sig[a], sig[b], rules)
        a, b = a[alive], b[alive]
        if len(a):
            same = (sig[a] == sig[b]).reshape(len(a), p.bands, p.rows).all(axis=2)
            first = same.argmax(axis=1) == band
            a, b = a[first], b[first]
        good = np.asarray([near(sets[m], sets[n], p.percent) for m, n in zip(a, b, strict=True)], bool)
        a, b = ids[a[good]], ids[b[good]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, params: NearDup | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Documents are linked when their shingle sets' similarity is ``percent`` or more;
    ``component_id`` is the smallest doc_id that links reach, and ``kept`` marks that document.

    Null texts, and texts without words, have no shingles and are linked with nothing.  A
    text with fewer words than a shingle is one shingle.  Rows of one doc_id are one
    document and expected to hold one text.  A row with a null doc_id has a null component
    and is kept.  An empty table gives an empty result; other columns are ignored.
    """
    p = params or NearDup()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    work = Scratch(docs.sparkSession)
    signed = materialize(signatures(docs, p), "dup-signatures")
    classes = signed.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = work.keep(classes, "dup-classes")
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "sig")
    reps = work.keep(reps, "dup-reps")
    shared = work.keep(buckets(reps, p, work), "dup-shared")
    # first round: one leader each
    votes = shared.where("doc_id <> first").groupBy("doc_id", "first").agg(F.count("*").alias("votes"))
    stars = votes.groupBy("doc_id").agg(F.max_by("first", F.struct(F.col("votes"), -F.col("first"))).alias("a")).select("a", F.col("doc_id").alias("b"))
    stars = work.keep(stars, "dup-stars")
    links = work.keep(verified(likely(stars, reps, p), docs, p, work), "dup-verified")
    members = work.keep(shared.select("doc_id").distinct(), "dup-members")
    found = work.keep(components(members, links, work), "dup-found")
    # second round: all other pairs across components
    more = work.keep(verified(across(shared, found, reps, docs, p, work), docs, p, work), "dup-verified")
    if not more.isEmpty():
        found = components(members, links.union(more), work)
    placed = classes.join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select("key", "n", F.coalesce("component", "rep").alias("component_id"))
    placed = materialize(placed, "dup-placed")
    work.drop()  # the result reads the signatures' keys and the classes' components alone
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = signed.select("doc_id", "n_shingles", F.coalesce("key", F.encode(F.concat(F.lit("none "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8")).alias("key"))
    out = salted_join(rows, placed.select("key", "component_id"), "key", hot_keys(placed, "key", "n", total), F.xxhash64("doc_id"), "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The contract of op 4: 3-word shingles, similarity 0.85 or more.
OP4 = NearDup(words=3, percent=85, bands=36, rows=7, batch=28)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), OP4)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(m.root, w.doc_id), w.doc_id)::BIGINT AS component_id,
  coalesce(least(m.root, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""
