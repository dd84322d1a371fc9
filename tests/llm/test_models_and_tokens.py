"""Token counts, packing, media, nearest neighbours, language ID and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter
from html import unescape
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import ann, counts, hnsw, langid, media, packing, tokens
from claimloom.llm.common import fresh_path
from claimloom.llm.queries import QUERIES
from tests.llm.test_neardup import brute
from tests.llm.test_small_operators import brute_lines, water_fill

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


TEXTS = ["", "a", "The thing's here.", "x <|endoftext|> y", "\n\n  \t  ", "ça öß 中文 🎉", "a" * 5000, "0123456789 " * 300, "   \r\n", "<|endoftext|>"]


def test_ids_equal_the_vocabulary_owners(exact, spark, sf):
    bpe = tokens.ByteBPE(tokens.default_path())
    assert bpe.fast is not None
    more = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    for t in TEXTS + more:
        want = exact.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t).tolist() == want and bpe.count(t) == len(want)


def test_rollup_of_signed_changes(spark, exact):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice([*TEXTS, None])) for k in range(60)]
    docs = spark.createDataFrame(rows, "id int, source string, lang string, text string")
    counted = counts.bpe_counts(docs.withColumn("n_tokens", F.lit("clash"))).withColumn("tokenizer", F.lit("v1"))
    rollup = counts.TokenRollup(spark, fresh_path(spark, "t"))
    assert rollup.totals().collect() == []
    assert rollup.commit("one", counts.changes(counted))
    assert not rollup.commit("one", counts.changes(counted))
    gone = counted.where("id % 3 = 0")
    revised = counted.where("id % 3 = 1")
    assert rollup.commit("two", counts.changes(deletes=gone))
    rollup.compact()
    assert not rollup.commit("two", counts.changes(deletes=gone))
    assert rollup.commit("three", counts.changes(revised.withColumn("n_tokens", F.col("n_tokens") + 5), revised))
    assert rollup.commit("empty", counts.changes(counted.limit(0)))
    want = {}
    for k, s, lang, t in rows:
        if k % 3:
            n, m = want.get((s, lang), (0, 0))
            want[s, lang] = n + 1, m + len(exact.encode(t or "", add_special_tokens=False).ids) + 5 * (k % 3 == 1)
    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert got == want
    rollup.compact()
    assert {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()} == want
    assert not any(rollup.commit(b, counts.changes(counted)) for b in ("one", "two", "three", "empty"))


def entry(spark, n, source="s"):
    return counts.changes(spark.createDataFrame([(source, "en", "v", n)], "source string, lang string, tokenizer string, n_tokens long"))


def test_a_commit_that_enters_while_batches_are_folded(spark, monkeypatch):
    path = fresh_path(spark, "t")
    rollup, other = counts.TokenRollup(spark, path), counts.TokenRollup(spark, path)
    rollup.commit("one", entry(spark, 5))
    totals = counts.TokenRollup.totals

    def enters(self, *a):  # between the listing and the reading
        monkeypatch.setattr(counts.TokenRollup, "totals", totals)
        assert other.commit("two", entry(spark, 10))
        return totals(self, *a)

    monkeypatch.setattr(counts.TokenRollup, "totals", enters)
    assert rollup.compact()
    for _ in range(3):
        assert [(r["docs"], r["tokens"]) for r in rollup.totals().collect()] == [(2, 15)]
        assert not rollup.commit("two", entry(spark, 10)) and not other.commit("one", entry(spark, 5))
        assert rollup.compact()


def test_totals_asked_for_before_a_compaction_can_be_read_after_it(spark):
    rollup = counts.TokenRollup(spark, fresh_path(spark, "t"))
    for k in range(4):
        rollup.commit(f"b{k}", entry(spark, k))
        before = rollup.totals()
        rollup.compact()
        assert before.first()["tokens"] == rollup.totals().first()["tokens"] == sum(range(k + 1))
    assert len(rollup._files.names(f"{rollup.path}/sums")) <= 3  # old folders are gone


def test_two_commits_of_one_batch_meet(spark, monkeypatch):
    path = fresh_path(spark, "t")
    rollup, other = counts.TokenRollup(spark, path), counts.TokenRollup(spark, path)
    staged = counts.TokenRollup._staged

    def enters(self):  # both have seen the name free
        monkeypatch.setattr(counts.TokenRollup, "_staged", staged)
        assert other.commit("one", entry(spark, 7))
        return staged(self)

    monkeypatch.setattr(counts.TokenRollup, "_staged", enters)
    assert not rollup.commit("one", entry(spark, 7))
    assert rollup.totals().first()["tokens"] == 7
    # and two compactions
    first, second = rollup.state(), rollup.state()
    assert first == second and rollup.compact()
    monkeypatch.setattr(counts.TokenRollup, "state", lambda self: first)
    assert not other.compact()
    monkeypatch.undo()
    assert rollup.totals().first()["tokens"] == 7


def test_counts_query_equals_counting(spark, sf, exact):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {}
    for r in rows:
        for version, n in (("words-1", len((r["text"] or "").split(None))), ("byte_bpe_50k", len(exact.encode(r["text"] or "", add_special_tokens=False).ids))):
            k = (r["source"], r["lang"], version)
            d, t = want.get(k, (0, 0))
            want[k] = d + 1, t + n
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in QUERIES["op2_token_counts"](spark, sf).collect()}
    assert got == want


def test_plan_uses_every_piece_and_few_sequences():
    rng = random.Random(2)
    for cap in (8, 100, 1024):
        for _ in range(20):
            need = {}
            for _ in range(rng.randrange(1, 400)):
                k = rng.randrange(1, cap + 1)
                need[k] = need.get(k, 0) + rng.randrange(1, 30)
            plan = packing.plan(need, cap)
            used = {}
            for n, pattern in plan:
                assert n > 0 and sum(pattern) <= cap and sum(3 * k > cap for k in pattern) <= 2
                for k in pattern:
                    used[k] = used.get(k, 0) + n
            assert used == need
            total = sum(k * n for k, n in need.items())
            large = sum(n for k, n in need.items() if 2 * k > cap)
            assert sum(n for n, _ in plan) <= max(-(-total // cap), large) * 1.35 + 2
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({1025: 1})


def test_packing_round_trip(spark, exact):
    rng = random.Random(3)
    base = [*TEXTS, None, " word" * 1023, " word" * 1024, " word" * 5000]
    rows = [(k if k % 9 else None, rng.choice(base), "clash", 1) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int")
    out = packing.pack_documents(df.repartition(3), keep_ids=True).collect()
    ids = {t: [*exact.encode(t or "", add_special_tokens=False).ids, 2] for t in base}
    sequences = {}
    for r in out:
        assert r["length"] == len(r["ids"]) <= 1024
        assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t, *_ in rows:
        if d is not None:
            parts = sorted(by_doc[d], key=lambda r: r["piece"])
            assert [x for r in parts for x in r["ids"]] == ids[t]
            assert all(r["length"] == 1024 for r in parts[1:])
            assert [r["start"] for r in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
    tokens_in = sum(len(ids[t]) for _, t, *_ in rows)
    assert sum(r["length"] for r in out) == tokens_in
    assert len(sequences) <= tokens_in / 1024 * 1.02 + 2
    assert packing.pack_documents(df.limit(0)).collect() == []


def test_packing_query_against_brute_force(spark, sf, exact):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r.asDict() for r in QUERIES["op3_packing"](spark, sf).collect()]
    want = set()
    for d, t in texts.items():
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            own = np.asarray(ids[s : first if k == 0 else s + 1024], "<u4")
            want.add((d, k, s, len(own), zlib.crc32(own.tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(places) <= sum(r["length"] for r in got) / 1024 * 1.02 + 2


def test_packing_of_one_length_and_no_ids(spark, monkeypatch):
    """All pieces have one length and no id; they are ranked in many parts, and reruns agree."""
    monkeypatch.setattr(packing, "LEAST_PART", 50)
    rows = [(None, k % 3, 0, 350, k // 2) for k in range(900)]  # each row twice
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = sorted(map(tuple, packing.pack(df.repartition(5)).collect()), key=str)
    assert out == sorted(map(tuple, packing.pack(df.repartition(2, "piece")).collect()), key=str)
    assert sorted((r[5], r[6]) for r in out) == [(s, o) for s in range(450) for o in (0, 350)]  # large pieces go in pairs


def test_media_are_stored_and_read_back(spark):
    texts = ["", None, "a", "x" * 64, "x" * 65, "é" * 40, "same", "same", "z" * 300_000, "<p>\"&amp;\x00"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, digest string")
    store = media.store_texts(df)
    found = media.features(store)
    out = {r["doc_id"]: r for r in media.resolve(media.interleave(store.select("doc_id", "n_bytes", "html")), found).where("kind = 'media'").collect()}
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = out[k]
        stored = media.encode_pgm(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(stored).hexdigest() == r["digest"]
        assert r["place"] == bool(t) and r["caption"] == f"{len(raw)} bytes"
    assert out[6]["feature"] == out[7]["feature"] != out[2]["feature"]


def test_interleaving_keeps_order_and_captions(spark):
    html = """<p>one <b>two</b></p><script>no</script><img src="media:sha256-AB" alt="c&amp;d">tail
    <figure><img src=x.png alt=old><figcaption>new <i>caption</i></figcaption></figure><div>end<video src="v.mp4"></div><p>unclosed"""
    items = media.parse_items(html)
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [
        ("text", "one two", None), ("media", "media:sha256-AB", "c&d"), ("text", "tail", None), ("media", "x.png", "new caption"), ("text", "end", None), ("media", "v.mp4", None), ("text", "unclosed", None),
    ]
    assert [i["place"] for i in items] == list(range(7)) and items[1]["digest"] == "ab"
    assert media.parse_items(None) == media.parse_items("") == []
    df = spark.createDataFrame([(1, html, "clash"), (2, None, "c"), (1, html, "clash")], "doc_id long, html string, items string")
    got = media.interleave(df.drop("items")).collect()
    assert sorted(len(r["items"]) for r in got) == [0, 7, 7]
    store = spark.createDataFrame([("ab", "payload")], "digest string, payload string")
    hit = [(r["place"], r["payload"]) for r in media.resolve(media.interleave(df), store).collect() if r["payload"]]
    assert hit == [(1, "payload")] * 2


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<figure><figcaption>c <b>d</b></figcaption><img src=x alt=old></figure>t", [("x", "c d"), ("t", None)]),
        ("<figure><img src=x alt=old><figcaption>c</figcaption></figure>t", [("x", "c"), ("t", None)]),
        ("<figure><figcaption>c</figcaption><p>p</p></figure>t", [("c", None), ("p", None), ("t", None)]),
        ("<figure><img src=x><figcaption>c</figure><p>t</p>", [("x", "c"), ("t", None)]),
        ("<figure><img src=x><figcaption>c &amp; d", [("x", "c & d")]),
        ("<figure><figcaption>c", [("c", None)]),
        ("a<figcaption>c<p>t</p>", [("a", None), ("c", None), ("t", None)]),
        ("<figure><figcaption>o</figcaption><figure><img src=x><figcaption>i</figcaption></figure></figure>", [("o", None), ("x", "i")]),
        ("<figure><figure><img src=x><figcaption>i</figcaption></figure><figcaption>o</figcaption></figure>", [("x", "i"), ("o", None)]),
        ("<noscript>n<img src=x></noscript>t<noscript>u", [("n", None), ("x", None), ("tu", None)]),
        ("a<template>h</template><template>b <p>c</p>", [("a", None), ("b c", None)]),
        ("a<script>h</script>b<style>p{}</style>c", [("abc", None)]),
        ("<figure><img src=x><figcaption>c</figcaption><figcaption>d</figcaption><img src=y></figure>", [("x", "c d"), ("y", "c d")]),
    ],
)
def test_no_caption_is_lost(html, want):
    items = media.parse_items(html)
    assert [(i["text"] or i["ref"], i["caption"]) for i in items] == want
    assert [i["place"] for i in items] == list(range(len(want)))


def test_media_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op5_media"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(got) == {r["doc_id"] for r in docs}
    features = {}
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        header = f"P5\n64 {len(payload) // 64}\n255\n".encode()
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(header) + len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(header + payload).hexdigest()
        features.setdefault(d["text"] or "", set()).add(r["feature"])
    assert all(len(f) == 1 for f in features.values()) and len(set.union(*features.values())) > len(features) / 2


def test_columns_that_clash_in_a_resolve(spark):
    html = '<p>t</p><img src="media:sha256-ab" alt="c">'
    pages = spark.createDataFrame([(1, html, "d", "x", "y", 5, "z")], "doc_id int, html string, digest string, text string, caption string, place int, payload string")
    store = spark.createDataFrame([("ab", "bytes", "s", "k")], "digest string, payload string, text string, kind string")
    got = media.resolve(media.interleave(pages), store)
    assert sorted(got.columns) == sorted(["doc_id", "payload", *media.FIELDS])
    assert [(r["place"], r["kind"], r["text"], r["digest"], r["caption"], r["payload"]) for r in got.orderBy("place").collect()] == [(0, "text", "t", None, None, None), (1, "media", None, "ab", "c", "bytes")]


def test_real_pages_lose_no_text_and_no_media(spark, sf):
    """All pages of the driver's table: the letters outside scripts and styles, and every source, come out in order."""
    rows = media.interleave(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("html").alias("raw")), "page_id").collect()
    assert rows
    for r in rows:
        assert [i["place"] for i in r["items"]] == list(range(len(r["items"])))
        raw = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style|template)\b.*?</\1>", "", r["raw"] or "")
        letters = re.sub(r"\s+", "", unescape(re.sub(r"(?s)<[^>]*>", "", raw)))
        shown = "".join((i["text"] or "") for i in r["items"])
        assert re.sub(r"\s+", "", shown) == letters or any(i["caption"] for i in r["items"])
        assert [i["ref"] for i in r["items"] if i["kind"] == "media"] == [unescape(x).strip() for x in re.findall(r'<(?:img|video|audio|source|embed)\b[^>]*?\bsrc="([^"]+)"', raw)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(900, 16)) * rng.uniform(0.2, 3, (900, 1))
    if kind == "float":
        base = base.astype("f4").astype("f8")
    rows = [(k, base[k % 700].tolist()) for k in range(900)]  # 200 copies
    rows += [(1000 + k, base[5].tolist()) for k in range(300)]  # one very common vector
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15), (2080, [None] * 16), (None, base[3].tolist()), (2100, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows + odd], f"vec_id long, embedding array<{kind}>, score string").repartition(5)
    got = {}
    for r in ann.nearest(df, lambda i: F.pmod(i, F.lit(20)) == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows])
    queries = [k for k in ids if k % 20 == 0]
    assert sorted(got) == queries
    hits = 0
    for q in queries:
        v = x[ids == q][0]
        score = x @ v
        order = [k for k in np.lexsort((ids, -np.round(score, 9))) if ids[k] != q][:20]
        own = sorted(got[q])
        assert [o[0] for o in own] == list(range(1, 21))
        assert [o[1:] for o in own] == sorted((o[1:] for o in own), key=lambda o: (-o[1], o[0]))
        for _, i, s in own:
            assert s == pytest.approx(float(x[ids == i][0] @ v), rel=1e-12, abs=1e-12)
        hits += len({int(ids[k]) for k in order} & {o[1] for o in own})
    assert hits / (20 * len(queries)) >= 0.97
    assert ann.nearest(df.limit(0), lambda i: i == 0).collect() == []
    few = ann.nearest(df.where("vec_id IN (20, 40, 60)"), lambda i: i == 20).collect()
    assert sorted(r["vec_id"] for r in few) == [40, 60]


def test_graph_recall_and_storage():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 24)).astype("f4")
    g = hnsw.Graph.from_row(hnsw.Graph.build(np.arange(4000) * 3, x).to_row())
    q = rng.normal(size=(100, 24)).astype("f4")
    who, ids, score = g.search(q, 20)
    true = np.argsort(-(q.astype("f8") @ x.T.astype("f8")), axis=1)[:, :20] * 3
    assert np.mean([len(set(true[k]) & set(ids[who == k])) / 20 for k in range(100)]) >= 0.9
    assert len(g.members) > 1 and all(len(a) > len(b) for a, b in zip(g.members, g.members[1:], strict=False))
    for n in (1, 2, 3):
        who, ids, _ = hnsw.Graph.build(np.arange(n), x[:n]).search(q[:2], 5)
        assert len(ids) == 2 * n


def brute_nearest(ids, x, queries, k=20):
    """Each query's nearest other ids by all inner products."""
    out = {}
    for q in queries:
        score = x @ x[ids == q][0]
        out[int(q)] = [int(ids[i]) for i in np.lexsort((ids, -np.round(score, 9))) if ids[i] != q][:k]
    return out


def recall(got, want):
    near = {}
    for r in got:
        near.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(near.get(q, set()) & set(w)) / len(w) for q, w in want.items()])


@pytest.mark.parametrize(("dim", "spread"), [(64, 1.0), (128, 1.0), (64, 0.0)], ids=["64 unequal", "128 unequal", "64 equal"])
def test_recall_of_full_shards(spark, monkeypatch, dim, spread):
    """Shards of the production size, vectors without structure, lengths over a factor of 4 (or equal)."""
    monkeypatch.setattr(ann, "LEAST_CELLS", 2)
    rng = np.random.default_rng(6)
    n = 2 * ann.SHARD_ROWS
    x = rng.normal(size=(n, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * 2 ** (spread * rng.uniform(-1, 1, (n, 1)))).astype("f4")
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = ann.nearest(df, lambda i: F.pmod(i, F.lit(60)) == 0).collect()
    assert recall(got, brute_nearest(np.arange(n), x.astype("f8"), range(0, n, 60))) >= 0.9


def test_queries_go_to_few_cells_where_there_is_structure(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_CELLS", 32)
    monkeypatch.setattr(ann, "SHARD_ROWS", 256)
    asked = []
    calibrate = ann.Index.calibrate
    monkeypatch.setattr(ann.Index, "calibrate", lambda self, *a: (calibrate(self, *a), asked.append((self.n_cells, len(self.cells.centres), self.parts.agg(F.sum("parts")).first()[0]))))
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(40, 32))
    own = np.where(rng.random(6000) < 0.4, 0, rng.integers(0, 40, 6000))  # one group holds four in ten
    x = (middle[own] + 0.2 * rng.normal(size=(6000, 32))).astype("f4")
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = ann.nearest(df, lambda i: F.pmod(i, F.lit(20)) == 0).collect()
    assert recall(got, brute_nearest(np.arange(6000), x.astype("f8"), range(0, 6000, 20))) >= 0.95
    (cells, of, shards) = asked[0]
    assert cells <= of // 3 and shards > of  # a large cell is several shards


def test_nearest_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.asarray([r["vec_id"] for r in rows]), np.asarray([r["embedding"] for r in rows], "f8")
    got = QUERIES["op6_nearest"](spark, sf).collect()
    want = brute_nearest(ids, x, [i for i in ids if i % 20 == 0])
    assert {r["query_id"] for r in got} == set(want) and recall(got, want) >= 0.95
    for r in got:
        assert r["score"] == pytest.approx(float(x[ids == r["vec_id"]][0] @ x[ids == r["query_id"]][0]), rel=1e-12)


def test_language_id(spark, sf):
    out = QUERIES["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_id_edge_cases(spark):
    rows = [(k, t, lang) for k in range(40) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"), ("ignored", None), (None, "fr"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == ["de", "en"]
    long = "und die katze " * 60_000
    texts = ["The AND", None, "", "123 !?", "die", long, "中"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    assert [got[k][0] for k in range(6)] == ["en", "und", "und", "und", "de", "de"]
    assert got[1][1] == got[2][1] == got[3][1] == 0.0 and got[6][0] in ("de", "en")
    # brute force: one text at a time, by plain sums
    for t in ("The AND", "die", long[:1000]):
        c = langid.text_counts(t)
        s = model.prior + model.weights[:, :-1] @ c
        assert model.predict([t])[1][0] == pytest.approx(1 / np.exp(s - s.max()).sum())
    assert model.predict([long])[1][0] == pytest.approx(1.0)
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.predict(["abc", None])[0] == ["und", "und"]
    assert langid.identify(df.limit(0), model).collect() == []


def plain_grams(text):
    """Every n-gram of the whole text between its blanks, one by one."""
    chars = [32, *(int(c) for c in langid.fold(text)), 32, 32]
    total = np.zeros(langid.BUCKETS, np.int64)
    for n in langid.ORDERS:
        for k in range(len(chars) - n + 1):
            if any(c != 32 for c in chars[k : k + n]):
                total[langid.gram_buckets(np.asarray(chars[k : k + n], np.uint32), n)[0]] += 1
    return total


@pytest.mark.parametrize("extra", range(-4, 4))
def test_texts_around_the_window_are_scored_whole(monkeypatch, extra):
    monkeypatch.setattr(langid, "WINDOW", 64)
    rng = random.Random(extra)
    texts = ["".join(rng.choice("abcde ä1 ") for _ in range(k * 64 + extra)) for k in (1, 2, 5)] + ["", "a", "ab", "  ", "1"]
    for t in texts:
        assert (langid.text_counts(t) == plain_grams(t)).all()
    model = langid.NaiveBayes(["x", "y"], np.random.default_rng(3).normal(size=(2, langid.BUCKETS + 1)), np.asarray([-0.5, -0.9]))
    model.weights[:, -1] = 0
    scores, letters = model.log_scores(texts)  # all in one batch: what stands beside a text changes nothing
    for t, row, has in zip(texts, scores, letters, strict=True):
        assert row == pytest.approx(model.prior + model.weights[:, :-1] @ plain_grams(t))
        assert has == any(c.isalpha() for c in t)


@pytest.fixture(scope="module")
def stage_rows(spark, sf):
    """The driver's smallest table with nulls, ties, repeated rows and a long text."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    some = next(r for r in rows if r[1] and len(r[1]) > 300 and r[2] is not None)
    line = some[1].split()  # in one line, and with a word of its own
    rows += [(9_000_010 + k, " ".join(line[: len(line) - k] + ["und"] * k), some[2], "near", 0) for k in range(3)]
    rows += [(9_000_001, None, "en", "s", 0), (9_000_002, "", None, None, 0), (9_000_003, "  \n\n 12 !", some[2], None, 0), (9_000_004, some[1] + "\nand one more line of words", None, None, 5), some, (None, some[1], some[2], some[3], some[4]), (9_000_005, (some[1] + "\n") * 300, some[2], some[3], 0)]
    return rows


def brute_mix(rows):
    """Copies that the mix takes whole: (doc_id, text) as often as taken."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    goals = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    out = Counter()
    for s in sizes:
        stream = sorted(((hashlib.md5(str(d).encode()).hexdigest() if d is not None else "0" * 32, d is not None, d or 0, size(t), t) for d, t, _, x, _ in rows if x == s), key=lambda r: r[:4])
        at = 0
        for _, known, d, n, t in stream * 2:
            taken = max(0, min(n, int(goals[s] + 1e-6) - at))
            at += n
            if taken and 2 * taken >= n:
                out[(d if known else None, t)] += 1
    return out


def test_pipeline_stages_against_brute_force(spark, sf, stage_rows, exact):
    docs = spark.createDataFrame(stage_rows, DOCS).repartition(5)
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "pack"]
    bag = lambda df: Counter(map(tuple, df.select(*docs.columns).collect()))

    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    told = [model.predict([r[1]]) for r in stage_rows]  # one text at a time
    got = corpus_pipeline.language_id(spark, docs, sf)
    assert bag(got) == Counter(r for r, (label, sure) in zip(stage_rows, told, strict=True) if label[0] != "und" and sure[0] >= 0.5)

    rows = list(bag(got).elements())
    want = Counter()
    kept = {}
    for d, _, lost, text in brute_lines([(r[0], r[1]) for r in rows]):
        kept.setdefault(d, []).append((lost, text))
    for d, _, lang, source, n in rows:
        lost, text = kept[d].pop() if len({x for x in kept[d]}) == 1 else next(x for x in kept[d] if x[0] == 0)
        if not lost or text.split():
            want[(d, text, lang, source, len(text))] += 1
    got = corpus_pipeline.line_dedup(spark, got, sf)
    assert bag(got) == want

    rows = list(want.elements())
    first = {d: root for d, _, root, _ in brute([(r[0], r[1]) for r in rows], 5, 80)}
    got = corpus_pipeline.near_dedup(spark, got, sf)
    assert bag(got) == Counter(r for r in rows if r[0] is None or first[r[0]] == r[0])
    assert sum(bag(got).values()) < len(rows)

    rows = list(bag(got).elements())
    got = corpus_pipeline.mix_sources(spark, got, sf)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == brute_mix(rows)

    texts = Counter((r["doc_id"], r["text"]) for r in got.collect())
    want = Counter()
    for (d, t), n in texts.items():
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(cut, len(ids), 1024)]):
            own = np.asarray(ids[s : cut if k == 0 else s + 1024], "<u4")
            want[(d, k, s, len(own), zlib.crc32(own.tobytes()))] += n
    packed = corpus_pipeline.pack(spark, got, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    ends = {}
    for r in packed:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for parts in ends.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] <= 1024 and all(a[1] == b[0] for a, b in pairwise(parts))


def test_pipeline_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = corpus_pipeline.run(spark, sf)
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert whole.agg(F.max("n")).first()[0] <= 1024
    assert packed.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
