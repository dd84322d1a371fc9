"""Near-dedup against brute force, with groups large enough for the blocked comparison."""

import os
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import common, neardup, shingles
from claimloom.llm.common import work_dir
from claimloom.llm.neardup import OP4, NearDup, near_duplicates

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    words = WORD.findall((text or "").encode().translate(UP))
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def brute(rows, n, percent):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets[d] = shingle_set(t, n)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(d, len(sets[d]), find(d), find(d) == d) for d in sets}


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(n)]


def edited(rng, base, k):
    out = list(base)
    for _ in range(k):
        out[rng.randrange(len(out))] = "X" + str(rng.randrange(10**6))
    return out


def corpus(seed=1, groups=((1, 90), (100, 40), (7, 3)), loners=30):
    rng = random.Random(seed)
    rows, doc = [], 1000
    for edits, size in groups:
        base = words(rng, 120)
        doc -= 1
        rows.append((doc, " ".join(base)))
        for _ in range(size):
            doc -= 1
            rows.append((doc, " ".join(edited(rng, base, rng.randrange(1, 2 + edits % 9)))))
    for _ in range(loners):
        doc -= 1
        rows.append((doc, " ".join(words(rng, rng.randrange(1, 200)))))
    rows += [(5000 + k, rows[0][1].upper() if k % 2 else rows[0][1] + " \n") for k in range(20)]  # copies but for case and space
    return rows


@pytest.mark.parametrize("params", [OP4, NearDup()], ids=["op4", "default"])
@pytest.mark.parametrize("small", [16, 4])
def test_components_equal_brute_force(spark, monkeypatch, params, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 8)  # many cells
    rows = corpus(groups=((6, 60), (8, 40), (7, 3)))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), params).collect()}
    assert got == brute(rows, params.words, params.percent)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two\n"), (6, "one"), (7, "one"), (7, "one"), (None, "one"), (8, "\u0085 x"), (9, "ÄB c d"), (10, "äB c d")]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame([(a, b, "k", 1) for a, b in rows], "doc_id long, text string, key string, n int"), OP4).collect()), key=str)
    want = brute(rows, 3, 85)
    assert {g for g in got if g[0] is not None} == want
    assert [g for g in got if g[0] is None] == [(None, 1, None, True)]
    assert len(got) == len(rows)  # repeated rows stay
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), OP4).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(3)
    base = words(rng, 60_000)
    rows = [(1, " ".join(base)), (2, " ".join(edited(rng, base, 500))), (3, " ".join(words(rng, 60_000)))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), OP4).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_prefilter_of_huge_sets_loses_no_link():
    """Sets of a million hashes have more 32-bit collisions than a fixed allowance would spare."""
    rng = np.random.default_rng(7)
    n = 1_000_000
    # 100 * common = 85 * union exactly: 17 of 20 members are common
    whole = rng.integers(0, 2**63, n * 20 // 17 + 1, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    common, rest = whole[:n], whole[n : n + (n * 3) // 17]
    a, b = (np.unique(x) for x in (np.concatenate([common, rest[: len(rest) // 2]]), np.concatenate([common, rest[len(rest) // 2 :]])))
    assert OP4.linked(a, b)
    short = [np.unique((x >> np.uint64(32)).astype("<u4")) for x in (a, b)]
    assert len(a) - len(short[0]) > 100
    assert shingles.near(*short, 85)
    assert not shingles.near(short[0], np.unique((rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) >> np.uint64(31)).astype("<u4")), 85)
    assert shingles.collisions(10) == 2


def test_one_group_of_very_many_copies(spark, tmp_path):
    """100,000 copies, some hundreds of them edited, and a hub with very many links; no table of the work stays."""
    rng = random.Random(8)
    base = words(rng, 60)
    rows = [(k, " ".join(base)) for k in range(100, 100_000)]
    rows += [(200_000 + k, " ".join(edited(rng, base, 1))) for k in range(3000)]
    rows += [(300_000 + k, " ".join(words(rng, 60))) for k in range(50)] + [(5, " ".join(base) + " and more words")]
    before = set(os.listdir(f"{work_dir(spark)}/claimloom")) if os.path.isdir(f"{work_dir(spark)}/claimloom") else set()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), OP4)
    left = sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(f"{work_dir(spark)}/claimloom")) - before)
    assert left == ["dup-placed", "dup-signatures"]
    sets = {}
    for d, t in rows:
        sets.setdefault(shingle_set(t, 3), []).append(d)
    main = shingle_set(rows[0][1], 3)
    alike = {s for s in sets if 100 * len(s & main) >= 85 * len(s | main)}
    assert len(alike) > 500
    for r in got.collect():
        if r["doc_id"] < 300_000:
            assert r["component_id"] == 5 and r["kept"] == (r["doc_id"] == 5)
        else:
            assert r["component_id"] == r["doc_id"]


def test_components_of_chains_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "hot_keys", lambda counts, key, n, total, most=2000, least=500: counts.where(F.col(n) > 5).select(key, F.lit(3).alias("_parts")))
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(300, 300), (301, 302), (302, 301), (401, 400)]
    nodes = sorted({x for pair in links for x in pair} | {999})
    work = common.Scratch(spark)
    got = {r["doc_id"]: r["component"] for r in neardup.components(spark.createDataFrame([(n,) for n in nodes], "doc_id long"), spark.createDataFrame(links, "a long, b long"), work).collect()}
    want = {n: n for n in nodes} | {k: 100 for k in range(100, 141)} | {k: 7 for k in range(200, 260)} | {302: 301, 401: 400}
    assert got == want


def test_pruning_rules_follow_the_posterior():
    rng = np.random.default_rng(5)
    for n, m in shingles.least_matches(252, 28, 0.85, 1e-6):
        s = rng.beta(m, n - m + 2, 400_000)  # one match fewer than needed
        assert (s >= 0.85).mean() < 1e-4


def test_word_hashes_do_not_depend_on_white_space():
    a = shingles.word_hashes(b"Foo bar\tBAZ")
    assert (a == shingles.word_hashes(b"  foo\n\nBAR baz ")).all()
    assert len(shingles.word_hashes(b" \x0b\x0c ")) == 0
    assert len(set(shingles.word_hashes("a b ab ba aa a\u00a0b".encode()).tolist())) == 6
