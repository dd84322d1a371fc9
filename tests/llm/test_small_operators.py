"""Chat formatting, URL filter, mixing, line dedup: against SQL, plain Python and odd inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimloom.llm import chat, linededup, mixing, urlfilter
from claimloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query_equals_sql(spark, sf, name):
    assert assert_same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf) > 0


TEXTS = ["", "plain", "\\", "\\\\", "###", "####", "\\###", "</turn>", "<</turn>/turn>", "### User: hi</turn>\n", "a\\nb\n", "#\\##", "\\</turn>\\", "é\U0001f600###\U0001f600", None]


TEMPLATES = {
    "own": chat.ChatTemplate(),
    "tags": chat.ChatTemplate(open="<|im_start|>", sep="\n", close="<|im_end|>\n"),
    "brackets": chat.ChatTemplate(open="[INST a]", sep="b]", close="aab", other="~", escape="%", labels={"user": "U"}),
    "short": chat.ChatTemplate(open="x", sep=":", close="y", labels={}, other="=", escape="^"),
}


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_chat_round_trip(spark, name):
    t = TEMPLATES[name]
    rng = random.Random(name)
    roles = ["system", "user", "assistant", "tool: x", "", None, "Assistant", "=", "= User", t.sep, t.open + t.close, t.escape]
    texts = [*TEXTS, t.open, t.close, t.sep, t.close[:-1], t.close * 2, t.open + "user" + t.sep + "hi" + t.close, t.escape, t.escape * 3 + "a", "".join(t.tokens().values())]
    texts += ["".join(rng.choice([t.open, t.close, t.sep, t.escape, t.open[:1], t.close[:1], "a", "b", "\n", "\\"]) for _ in range(rng.randrange(12))) for _ in range(150)]
    rows = [(k, rng.choice([0, 1, 2, 2, None]), rng.choice(roles), rng.choice(texts)) for k in range(60) for _ in range(rng.randrange(1, 9))]
    rows += rows[:20] + [(None, 0, "assistant", "a"), (None, 0, "assistant", "b")]  # repeated rows, and rows of no conversation
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id int, turn int, role string, text string, formatted string, n_turns int")
    out = chat.format_chats(df, t).withColumn("back", chat.read_back(F.col("formatted"), t)).collect()
    assert sum(r["n_turns"] for r in out) == len(rows) and sum(r["conv_id"] is None for r in out) == 2
    for r in out:
        own = sorted((turn is not None, turn or 0, role or "", text or "") for c, turn, role, text in rows if c == r["conv_id"])
        if r["conv_id"] is not None:
            assert [(b["role"], b["text"]) for b in r["back"]] == [(role, text) for _, _, role, text in own]
            loss = [s["text"] for s in r["segments"] if s["loss"]]
            assert len(loss) == sum(role == "assistant" for _, _, role, _ in own)
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    escaped = spark.createDataFrame([(x,) for x in texts if x is not None], "t string").select("t", chat.escape(F.col("t"), t).alias("e"), chat.unescape(chat.escape(F.col("t"), t), t).alias("b")).collect()
    for r in escaped:
        assert r["t"] == r["b"] and t.open not in r["e"] and t.close not in r["e"]


def test_templates_that_cannot_be_read_back():
    for bad in ({"close": ""}, {"escape": "#"}, {"labels": {"user": "a:b"}}, {"labels": {"user": "=x"}}, {"labels": {"user": "X", "system": "X"}}, {"other": ""}, {"recover": {"user": "assistant"}}, {"sep": "aa", "close": "aab"}, {"open": "x", "close": "x"}):
        with pytest.raises(ValueError):
            chat.ChatTemplate(**bad)


def test_chat_state_machine(spark):
    def conv(c, roles):
        return [(c, k, r, "x") for k, r in enumerate(roles)]

    rows = conv(1, ["system", "user", "assistant"]) + conv(2, ["assistant"]) + conv(3, ["user", "user"]) + conv(4, ["system"]) + conv(5, ["user"]) + [(None, 0, "user", "a")] + conv(6, ["user", "tool", "assistant", "user"])
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: (r["valid"], r["first_invalid"]) for r in chat.format_chats(df).collect()}
    assert got == {1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, None), 5: (True, None), 6: (False, 1), None: (True, None)}
    assert chat.format_chats(df.limit(0)).collect() == []
    # the machine decides what is written and trained on: a second answer in a row has a state of its own
    steps = {("start", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "assistant"): "again", ("assistant", "user"): "user"}
    t = chat.ChatTemplate(transitions=steps, accept=("user", "assistant", "again"))
    row = chat.format_chats(spark.createDataFrame(conv(1, ["user", "assistant", "assistant", "user"]), "conv_id int, turn int, role string, text string"), t).first()
    assert row["first_invalid"] == 3 and [s["loss"] for s in row["segments"]].count(True) == 1
    assert row["formatted"] == "### User: x</turn>\n### Assistant: x</turn>\n### =assistant: x</turn>\n### User: x</turn>\n"


def test_a_long_conversation(spark):
    n = 3 * chat.FOLD + 5
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", str(k)) for k in range(n)] + [(2, k, "user" if k % 2 == 0 or k == 1401 else "assistant", "") for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert got[1]["valid"] and got[1]["formatted"] == "".join(f"### {'User' if k % 2 == 0 else 'Assistant'}: {k}</turn>\n" for k in range(n))
    bad = next(k for k in range(1, n) if rows[n + k][2] == rows[n + k - 1][2])
    assert (got[2]["valid"], got[2]["first_invalid"]) == (False, bad)


def test_url_parts_and_rules(spark):
    urls = {
        "http://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://x.net/fr/a": ("x.net", "/fr/a", "net/fr/", "block"),
        "http://x.net/FR/a": ("x.net", "/FR/a", None, "allow"),
        "a://b.com/?u=c://d.net/es/": ("b.com", "/", "com/", "allow"),
        "no url": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "://com./": ("com.", "/", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://x.org\n.net/es/": ("x.org\n.net", "/es/", "net/es/", "block"),
    }
    df = spark.createDataFrame([(u, "clash", 1) for u in urls] * 2, "url string, host string, n int")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, urlfilter.RULES).collect()}
    assert got == urls
    assert urlfilter.judge(df, urlfilter.RULES).count() == 2 * len(urls)
    assert urlfilter.judge(df.limit(0), urlfilter.RULES).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(2)
    keys = [f"k{k}" for k in range(4000)]
    listed = set(rng.sample(keys, 300))
    universe = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    cascade = urlfilter.Cascade.build(universe, "listed")
    assert len(cascade.levels) > 1
    assert universe.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    with pytest.raises(urlfilter.TooLarge):
        urlfilter.Cascade.build(universe, "listed", max_bytes=8)


def test_filters_and_joins_judge_alike(spark):
    """A list of a million rules, within the bound and beyond it, against an index in plain Python."""
    n = 1_000_000
    rules = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "allow").otherwise("block").alias("verdict"),
        F.concat(F.lit("h"), (F.col("id") / 4).cast("long"), F.lit(".example")).alias("host"),
        F.element_at(F.array(F.lit("/"), F.lit("/a/"), F.lit("/a/b/"), F.lit("/é/")), (F.col("id") % 4 + 1).cast("int")).alias("path"),
    )
    paths = ("/", "/a/", "/a/b/", "/é/")
    urls = [f"http://{sub}h{k}.example{path}" for k in [0, 1, 77, n // 4 - 1, n // 4, n] for sub in ("", "www.", "x") for path in ("", "/", "/a/b/c", "/é/x", "/a", "/b/")]
    urls += [None, "", "no url", "http://h1.example/"]  # and a repeated row
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id int, url string, rule string")

    def want(url):
        if not url or "://" not in url:
            return None, "allow"
        host, _, path = url.split("://", 1)[1].partition("/")
        path = "/" + path if _ else ""
        host = host.removeprefix("www.")
        number = host.removesuffix(".example")[1:]
        if host[0] != "h" or not number.isdigit() or int(number) >= n // 4:
            return None, "allow"
        fits = [(len(p), k) for k, p in enumerate(paths) if path.startswith(p)]
        if not fits:
            return None, "allow"
        k = max(fits)[1]
        return host + paths[k], "allow" if (4 * int(number) + k) % 3 == 0 else "block"

    by_filter, by_join = urlfilter.judge(pages, rules), urlfilter.judge(pages, rules, max_bytes=1000)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in by_filter.collect()}
    assert got == {k: want(u) for k, u in enumerate(urls)}
    assert sorted(map(str, by_filter.collect())) == sorted(map(str, by_join.select(*by_filter.columns).collect()))
    plan = by_filter._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Join" not in plan
    assert "Join" in by_join._jdf.queryExecution().executedPlan().toString()


def test_rules_that_cannot_be(spark):
    pages = spark.createDataFrame([("http://a.b/",)], "url string")
    for rules in ([("allow", "a", "x")], [("allow", "a/b", "/")], [("allow", "a", "/"), ("block", "a", "/")], [("allow", None, "/")]):
        with pytest.raises(ValueError):
            urlfilter.judge(pages, rules)
    assert urlfilter.judge(pages, []).first()["verdict"] == "allow"


def water_fill(sizes, weights, total):
    """Deal by weight again and again, cutting at twice the size."""
    got, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while left > 1e-9 and open_:
        whole = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / whole for s in open_}
        left = 0.0
        for s in list(open_):
            got[s] += share[s]
            if got[s] >= 2 * sizes[s]:
                left += got[s] - 2 * sizes[s]
                got[s] = 2 * sizes[s]
                open_.discard(s)
    return got


def test_mixing_targets_and_amounts(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", "B", "c", None, "é"]) if k > 200 else "hot", " ".join(["w"] * rng.randrange(0, 40))) for k in range(600)] + [(7, "hot", "x y"), (None, "hot", "x y z"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"size": F.lit("clash"), "target": F.lit(1)})
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = {}
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert all(0 <= c["position"] <= 1 for c in r["copies"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix(df.limit(0)).collect() == []


def test_training_order_follows_the_schedules(spark):
    rows = [(k, "s", "w " * 10) for k in range(2000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    positions = [r["position"] for r in mixing.in_training_order(mixed).collect()]
    assert positions == sorted(positions)
    early = sum(p < 0.5 for p in positions) / len(positions)
    assert early == pytest.approx(2 / 3, abs=0.01)  # the first source's schedule is twice as dense before the middle


def test_mixing_query_is_range_sorted(spark, sf):
    rows = QUERIES["op9_mixing"](spark, sf).collect()
    key = [(r["position"] is None, r["position"] or 0.0, r["doc_id"]) for r in rows]
    assert key == sorted(key)
    assert all(r["position_2"] is None or r["position_2"] > r["position"] for r in rows)
    assert any(r["position_2"] is not None for r in rows) and any(r["position"] is None for r in rows)


def brute_lines(rows):
    white = " \t\n\x0b\x0c\r"
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(white).translate(up)
            if d is not None and len(k) >= 10:
                holders.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not ((h := holders.get(x.strip(white).translate(up))) and len(h) > 1 and d != min(h))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    pool = [f"line number {k} of the pool" for k in range(30)] + ["short", "", "ÄÖÜäöü1234", "Line Number 1 OF the pool  ", "\u00a0nbsp is no space 1", "a" * 9, "ä" * 10]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for k in range(300)] + [(7, pool[0]), (None, pool[0]), (9001, None), (9002, ""), (9003, "\r\n" * 3 + "x" * 10), (9004, "x" * 10 + "\r")]
    df = spark.createDataFrame([(a, b, "clash", 2) for a, b in rows], "doc_id long, text string, key string, n int").repartition(6)
    for fanout, batches in ((2, 9), (3, 6)):  # more batches than fan-out, so some meet compacted runs
        runs = linededup.LineRuns(spark, fanout, 5)
        got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in linededup.dedup_lines(df, batches, runs=runs).collect()), key=str)
        assert got == brute_lines(rows)
        assert any(len(level) for level in runs.levels[1:]) and len(runs.batches) > fanout
        runs.delete()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in linededup.dedup_lines(df).collect()), key=str) == brute_lines(rows)
    assert linededup.dedup_lines(df.limit(0)).collect() == []


def test_line_runs_go_on_with_later_batches(spark):
    runs = linededup.LineRuns(spark)
    first = spark.createDataFrame([(1, "the very same line\nother line here")], "doc_id long, text string")
    later = spark.createDataFrame([(2, "the very same line\nsomething quite new")], "doc_id long, text string")
    linededup.dedup_lines(first, 1, runs=runs).collect()
    runs = linededup.LineRuns.restore(spark, runs.manifest())
    assert linededup.dedup_lines(later, 1, runs=runs).first()["kept"] == "something quite new"
    with pytest.raises(ValueError, match="already"):
        runs.add(runs.batches[0], linededup.line_table(first))


def test_a_batch_merges_with_runs_in_place(spark):
    """Known runs are read by bucket: the only shuffle is the batch's own."""
    runs = linededup.LineRuns(spark, fanout=9, buckets=4)
    docs = [spark.createDataFrame([(10 * k + j, f"line {j} of every batch\nline {j} of batch {k}") for j in range(4)], "doc_id long, text string") for k in range(3)]
    for k in range(2):
        runs.add(str(k), linededup.line_table(docs[k]))
    plans = []
    write = linededup.LineRuns._write
    linededup.LineRuns._write = lambda self, rows, level: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(self, rows, level))[1]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = runs.add("2", linededup.line_table(docs[2])).collect()
    finally:
        linededup.LineRuns._write = write
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plans[0].count("Exchange") == 1 and plans[0].count("Bucketed: true") == 2
    assert sorted((r["owner"], r["known"]) for r in got) == [(k, True) for k in range(4)] + [(20 + k, False) for k in range(4)]


def test_a_job_that_ends_after_a_compaction_goes_on(spark):
    runs = linededup.LineRuns(spark, fanout=2, buckets=2)
    docs = [spark.createDataFrame([(k, f"a line of all\nand one of {k} alone")], "doc_id long, text string") for k in range(5)]
    saved = runs.manifest()
    for k in range(4):
        again = linededup.LineRuns.restore(spark, saved)  # as if the job had ended before it saved the last manifest
        first = [sorted(map(str, r.add(str(k), linededup.line_table(docs[k])).collect()))[0] for r in (runs, again)]
        assert first[0] == first[1]
        saved = again.manifest()
        again.clean()
        runs = again
    assert runs.retired == [] and linededup.dedup_lines(docs[4], 1, runs=runs).first()["kept"] == "and one of 4 alone"


def test_kept_hash_is_of_utf8(spark):
    row = QUERIES["op8_line_dedup"]
    assert row.__name__ == "op8_line_dedup"
    out = linededup.dedup_lines(spark.createDataFrame([(1, "é")], "doc_id long, text string"), 1)
    assert out.select(F.sha2(F.encode("kept", "UTF-8"), 256).alias("h")).first()["h"] == hashlib.sha256("é".encode()).hexdigest()
