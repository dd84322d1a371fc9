"""Language ID: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, languages by hash buckets, sent to the
executors once; its size is bounded by :data:`MAX_MODEL_BYTES`.  Texts are scored in
numpy by gathering the matrix at their n-grams' buckets and summing per document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The classifier is fitted on so many labelled documents at most, chosen by a hash of their id.
MAX_TRAIN_DOCS = 20_000
MAX_MODEL_BYTES = 64 << 20
UNDETERMINED = "und"
#: N-grams scored at once, by where they start; a longer text is scored in several windows that share their edges.
WINDOW = 1 << 18
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@cache
def _letters() -> np.ndarray:
    """For each code point the lower-case letter, or a blank where it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def fold(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def gram_buckets(chars: np.ndarray, order: int, buckets: int = BUCKETS) -> np.ndarray:
    """A bucket for the n-gram from each place; ``buckets`` itself for blanks only and at the end."""
    n = len(chars) - order + 1
    out = np.full(len(chars), buckets, np.int64)
    if n > 0:
        h = np.zeros(n, np.uint32)
        blank = np.ones(n, bool)
        for k in range(order):
            part = chars[k : k + n]
            h = (h ^ part) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
            blank &= part == 32
        h = (h + np.uint32(order)) * np.uint32(0x27D4EB2F)
        out[:n] = np.where(blank, buckets, (h >> np.uint32(16)).astype(np.int64) & (buckets - 1))
    return out


def text_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in a whole text."""
    total = np.zeros(buckets + 1, np.int64)
    for chars, n in _windows(text):
        for order in ORDERS:
            total += np.bincount(gram_buckets(chars, order, buckets)[:n], minlength=buckets + 1)
    return total[:buckets]


def _windows(text: str):
    """(code points, how many n-grams start here) of a text between one blank and two, window by window.

    A window looks on into the next by what its last n-grams take, so that windows have the n-grams of
    the text as one piece, and no others.
    """
    more = max(ORDERS) - 1
    length = len(text) + 3
    for at in range(0, length, WINDOW):
        end = min(at + WINDOW + more, length)
        chars = np.concatenate([np.full(max(0, 1 - at), 32, np.uint32), fold(text[max(0, at - 1) : end - 1]), np.full(max(0, end - max(at, length - 2)), 32, np.uint32)])
        yield chars, min(WINDOW, length - at)


@dataclass
class NaiveBayes:
    labels: list[str]
    weights: np.ndarray  # (labels, buckets + 1): log probabilities; the last column is 0
    prior: np.ndarray

    def __post_init__(self) -> None:
        if self.weights.nbytes > MAX_MODEL_BYTES:
            raise ValueError(f"a model of {self.weights.nbytes} bytes is above {MAX_MODEL_BYTES}; fit it with fewer buckets")

    @classmethod
    def from_counts(cls, labels: list[str], counts: np.ndarray, docs: np.ndarray, smoothing: float = 0.1) -> NaiveBayes:
        p = counts + smoothing
        weights = np.zeros((len(labels), counts.shape[1] + 1))
        weights[:, :-1] = np.log(p / p.sum(axis=1, keepdims=True))
        return cls(labels, weights, np.log((docs + 1) / (docs.sum() + len(labels))))

    def log_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Joint log probabilities (texts, labels), and which texts have a letter at all."""
        scores = np.tile(self.prior, (len(texts), 1))
        letters = np.zeros(len(texts), bool)
        buckets = self.weights.shape[1] - 1
        block: list[tuple[np.ndarray, int]] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            chars = np.concatenate([c for c, _ in block])
            sizes = np.asarray([len(c) for c, _ in block])
            starts = np.cumsum(sizes) - sizes
            place = np.arange(len(chars)) - np.repeat(starts, sizes)
            # an n-gram counts if it starts in its window and ends in its piece
            own = place < np.repeat([n for _, n in block], sizes)
            who = np.asarray(owner)
            np.logical_or.at(letters, who, np.add.reduceat((own & (chars != 32)).astype(np.int64), starts) > 0)
            for order in ORDERS:
                at = np.where(own & (place <= np.repeat(sizes, sizes) - order), gram_buckets(chars, order, buckets), buckets)
                for k, row in enumerate(self.weights):
                    np.add.at(scores[:, k], who, np.add.reduceat(row[at], starts))

        for i, text in enumerate(texts):
            for window in _windows(text):
                block.append(window)
                owner.append(i)
                size += len(window[0])
                if size >= WINDOW:
                    flush()
                    block, owner, size = [], [], 0
        if block:
            flush()
        return scores, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and posterior of each text; ``und`` and 0 for null and for texts without a letter."""
        scores, letters = self.log_scores([t or "" for t in texts])
        best = scores.argmax(axis=1) if self.labels else np.zeros(len(texts), int)
        letters &= bool(self.labels)
        sure = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1) if self.labels else np.zeros(len(texts))
        return [self.labels[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)], np.where(letters, sure, 0.0)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS, buckets: int = BUCKETS) -> NaiveBayes:
    """Fit on rows with a label and a text, at most about ``max_docs`` of them.

    With more, those whose hashed key falls under the share are taken, so the choice does
    not depend on the order of rows.  No usable row gives a model that knows no label.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(text).alias("t"))
    n = rows.count()
    if n > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(max_docs / n * (1 << 30)))
    parts = 16

    def counts(batches):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lab, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(lab, np.zeros(buckets, np.int64))
                total[lab] += text_counts(t, buckets)
                docs[lab] = docs.get(lab, 0) + 1
        labs = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(labs, pa.string()), pa.array([docs[x] for x in labs], pa.int64()), pa.array([total[x].tobytes() for x in labs], pa.binary())], ["l", "docs", "counts"])

    # the sample is bounded, so are the few count vectors that come to the driver
    found = map_arrow(rows.select("l", "t").repartition(parts), counts, "l string, docs long, counts binary").collect()
    labels = sorted({r["l"] for r in found})
    total, docs = np.zeros((len(labels), buckets)), np.zeros(len(labels))
    for r in found:
        k = labels.index(r["l"])
        total[k] += np.frombuffer(r["counts"], np.int64)
        docs[k] += r["docs"]
    return NaiveBayes.from_counts(labels, total, docs)


def identify(docs: DataFrame, model: NaiveBayes, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the posterior, 0..1) to every row; one pass, no shuffle.

    Null texts and texts without a letter get ``und`` and 0.  Whole texts are scored,
    however long.  Repeated rows stay; other columns stay, and those named like the
    added ones are replaced.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double"
    at = others.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            labels, sure = sent.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(sure, pa.float64())], [*others, "lang_pred", "score"])

    return map_arrow(rows, score, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that a model never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
