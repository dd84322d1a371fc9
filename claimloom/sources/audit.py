"""Audit packages: one folder of JSON lines per kind of record, and a manifest."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ir import RuleError
from .shared import Files

#: Records by kind; explicit, so reading never infers a type.
KINDS = {
    "runs": "run_id string, rule_id string, version string, started_at long, finished_at long, rows long, status string",
    "candidates": "run_id string, candidate_id string, candidate_key string, target string, confidence double",
    "writes": "run_id string, candidate_id string, asrt_id string, written_at long",
    "decisions": "candidate_id string, decision string, reason string, decided_at long",
    "failures": "run_id string, candidate_id string, code string, message string",
    "mappings": "pred_id string, key string, value string, asrt_id string, reason string",
    "evidence": "candidate_id string, condition int, predicate string, asrt_id string",
    "rounds": "round_id string, event long, kind string, payload string",
    "traces": "rule_run_id string, run_id string, rule_id string, version string, rows long, parent string",
    "changes": "change_id string, sequence long, action string, target string, status string, at long",
    "annotations": "asrt_id string, namespace string, category string, key string, kind string, value string, origin string, derivation string",
    "meta_history": "asrt_id string, key string, kind string, value string, tx_seq long, op_ordinal int",
}
#: The record kinds that hold one row per run, and those of a candidate.
OF_RUN = ("candidates", "writes", "failures", "traces")
OF_CANDIDATE = ("writes", "decisions", "failures", "evidence")


def export(spark: SparkSession, path: str, records: Mapping[str, DataFrame], schema_digest: str) -> dict:
    """Write records of known kinds; the manifest comes last, so a package without one is unfinished."""
    path = path.rstrip("/")
    counts = {}
    for kind, df in records.items():
        if kind not in KINDS:
            raise RuleError(f"unknown kind of record: {kind}")
        shape = spark.createDataFrame([], KINDS[kind]).schema
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in shape])
        out.write.json(f"{path}/{kind}", ignoreNullFields=False)
        counts[kind] = spark.read.schema(KINDS[kind]).json(f"{path}/{kind}").count()
    manifest = {"format": 1, "schema": schema_digest, "counts": counts}
    if not Files(spark, path).create(f"{path}/manifest.json", json.dumps(manifest, sort_keys=True)):
        raise RuleError(f"there is a package at {path}")
    return manifest


class Package:
    """A package read back, and the questions asked of it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        files = Files(spark, self.path)
        if not files.exists(f"{self.path}/manifest.json"):
            raise RuleError(f"no finished package at {path}")
        self.manifest = json.loads(files.read(f"{self.path}/manifest.json"))

    def __getitem__(self, kind: str) -> DataFrame:
        if kind not in KINDS:
            raise RuleError(f"unknown kind of record: {kind}")
        if kind not in self.manifest["counts"]:
            return self.spark.createDataFrame([], KINDS[kind])
        return self.spark.read.schema(KINDS[kind]).json(f"{self.path}/{kind}")

    def select(self, kind: str, **equal) -> DataFrame:
        rows = self[kind]
        for k, v in equal.items():
            rows = rows.where(F.col(k) == v)
        return rows

    def run_summary(self) -> DataFrame:
        """Per run: candidates, writes, failures."""
        out = self["runs"].select("run_id", "rule_id", "status")
        for kind in ("candidates", "writes", "failures"):
            out = out.join(self[kind].groupBy("run_id").agg(F.count("*").alias(kind)), "run_id", "left").na.fill(0, [kind])
        return out

    def coverage(self) -> DataFrame:
        """Per target: candidates, and how many have evidence."""
        proven = self["evidence"].select("candidate_id").distinct().withColumn("has", F.lit(1))
        return self["candidates"].join(proven, "candidate_id", "left").groupBy("target").agg(F.count("*").alias("candidates"), F.count("has").alias("with_evidence"))

    def trace(self, candidate_id: str) -> DataFrame:
        """A candidate's evidence in order."""
        return self.select("evidence", candidate_id=candidate_id).orderBy("condition")

    def timeline(self, candidate_id: str) -> DataFrame:
        """(at, event) of a candidate: its decision and its write, in order."""
        a = self.select("decisions", candidate_id=candidate_id).select(F.col("decided_at").alias("at"), F.col("decision").alias("event"))
        b = self.select("writes", candidate_id=candidate_id).select(F.col("written_at").alias("at"), F.lit("written").alias("event"))
        return a.union(b).orderBy("at")

    def undecided(self) -> DataFrame:
        return self["candidates"].join(self["decisions"], "candidate_id", "left_anti")

    def failure_codes(self) -> DataFrame:
        return self["failures"].groupBy("code").agg(F.count("*").alias("n"))

    # one record, or None

    def _one(self, kind: str, **equal) -> dict | None:
        found = self.select(kind, **equal).limit(2).collect()
        if len(found) > 1:
            raise RuleError(f"several {kind} with {equal}")
        return found[0].asDict() if found else None

    def run(self, run_id: str) -> dict | None:
        return self._one("runs", run_id=run_id)

    def candidate(self, candidate_id: str) -> dict | None:
        return self._one("candidates", candidate_id=candidate_id)

    def trace_of(self, rule_run_id: str) -> dict | None:
        return self._one("traces", rule_run_id=rule_run_id)

    def decision(self, candidate_id: str) -> dict | None:
        """The last decision on a candidate."""
        found = self.select("decisions", candidate_id=candidate_id).orderBy(F.desc("decided_at")).limit(1).collect()
        return found[0].asDict() if found else None

    def bundle(self, run_id: str) -> dict[str, DataFrame]:
        """All records of a run: its own, and those of its candidates."""
        own = self.select("candidates", run_id=run_id).select("candidate_id")
        out = {k: self.select(k, run_id=run_id) for k in ("runs", *OF_RUN)}
        for k in ("decisions", "evidence"):
            out[k] = self[k].join(own, "candidate_id", "left_semi")
        return out

    # candidates

    def with_evidence(self, has: bool = True) -> DataFrame:
        """Candidates that have evidence, or that have none."""
        return self["candidates"].join(self["evidence"].select("candidate_id"), "candidate_id", "left_semi" if has else "left_anti")

    def status(self) -> DataFrame:
        """(candidate_id, evidence, decision, written): how many conditions are shown, the last decision, and whether it was written."""
        shown = self["evidence"].groupBy("candidate_id").agg(F.count("*").alias("evidence"))
        last = self["decisions"].groupBy("candidate_id").agg(F.max_by("decision", "decided_at").alias("decision"))
        wrote = self["writes"].select("candidate_id").distinct().withColumn("_w", F.lit(True))
        out = self["candidates"].select("candidate_id").join(shown, "candidate_id", "left").join(last, "candidate_id", "left").join(wrote, "candidate_id", "left")
        return out.select("candidate_id", F.coalesce("evidence", F.lit(0)).alias("evidence"), "decision", F.coalesce("_w", F.lit(False)).alias("written"))

    def tree(self, candidate_id: str) -> dict | None:
        """A candidate with its evidence by condition; a candidate has few, so it is read to the driver."""
        own = self.candidate(candidate_id)
        if own is None:
            return None
        rows = self.trace(candidate_id).collect()
        return {**own, "conditions": [{"condition": k, "uses": sorted((r["predicate"], r["asrt_id"] or "") for r in rows if r["condition"] == k)} for k in sorted({r["condition"] for r in rows})]}

    def tell(self, candidate_id: str) -> str | None:
        """The tree as lines."""
        tree = self.tree(candidate_id)
        if tree is None:
            return None
        lines = [f"{tree['target']} ({tree['candidate_key']}), confidence {tree['confidence']}"]
        lines += [f"  condition {c['condition']}: " + ", ".join(f"{p} {a}".strip() for p, a in c["uses"]) for c in tree["conditions"]]
        return "\n".join(lines)

    def timeline_summary(self, candidate_id: str) -> dict:
        """First and last time of a candidate's events, and how many there are of each kind."""
        rows = self.timeline(candidate_id).groupBy("event").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).collect()
        return {"first": min((r["first"] for r in rows), default=None), "last": max((r["last"] for r in rows), default=None), "events": {r["event"]: r["n"] for r in rows}}

    def confidence(self) -> DataFrame:
        """(target, candidates, lowest, mean, highest) of candidates' confidence."""
        c = F.col("confidence")
        return self["candidates"].groupBy("target").agg(F.count("*").alias("candidates"), F.min(c).alias("lowest"), F.avg(c).alias("mean"), F.max(c).alias("highest"))

    # mappings, rules, rounds, changes, annotations

    def mapping(self, pred_id: str | None = None) -> DataFrame:
        return self["mappings"] if pred_id is None else self.select("mappings", pred_id=pred_id)

    def rule_summary(self) -> DataFrame:
        """(rule_id, version, runs, rows) of traces."""
        return self["traces"].groupBy("rule_id", "version").agg(F.count("*").alias("runs"), F.sum("rows").alias("rows"))

    def tell_rule(self, run_id: str) -> str:
        """A run's rules as lines, each under the one that refers to it; one that is its own ancestor is shown once."""
        rows = sorted((r.asDict() for r in self.select("traces", run_id=run_id).collect()), key=lambda r: r["rule_run_id"])
        lines: list[str] = []

        def show(parent: str | None, depth: int) -> None:
            for r in rows:
                if r["parent"] == parent and not r.get("shown"):
                    r["shown"] = True
                    lines.append(f"{'  ' * depth}{r['rule_id']}@{r['version']}: {r['rows']} rows")
                    show(r["rule_run_id"], depth + 1)

        show(None, 0)
        return "\n".join(lines)

    def rounds(self) -> list[str]:
        return sorted(r[0] for r in self["rounds"].select("round_id").distinct().collect())

    def round_events(self, round_id: str, kind: str | None = None) -> DataFrame:
        rows = self.select("rounds", round_id=round_id)
        return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy("event")

    def round_event(self, round_id: str, event: int) -> dict | None:
        return self._one("rounds", round_id=round_id, event=event)

    def round_summary(self) -> DataFrame:
        """(round_id, events, first, last, kinds)."""
        return self["rounds"].groupBy("round_id").agg(F.count("*").alias("events"), F.min("event").alias("first"), F.max("event").alias("last"), F.array_sort(F.collect_set("kind")).alias("kinds"))

    def round_warnings(self) -> DataFrame:
        """(round_id, missing, repeated): rounds whose event numbers have gaps or repeats."""
        own = self["rounds"].groupBy("round_id").agg(F.count("*").alias("n"), F.count_distinct("event").alias("d"), (F.max("event") - F.min("event") + 1).alias("span"))
        return own.where("n <> span OR d <> n").select("round_id", (F.col("span") - F.col("d")).alias("missing"), (F.col("n") - F.col("d")).alias("repeated"))

    def changes(self, change_id: str | None = None, status: str | None = None) -> DataFrame:
        """Changes of rules and schemas, in order."""
        rows = self["changes"]
        for name, value in (("change_id", change_id), ("status", status)):
            if value is not None:
                rows = rows.where(F.col(name) == value)
        return rows.orderBy("change_id", "sequence")

    def change_runs(self) -> DataFrame:
        """(change_id, steps, last_status, began, ended) of each change."""
        return self["changes"].groupBy("change_id").agg(F.count("*").alias("steps"), F.max_by("status", "sequence").alias("last_status"), F.min("at").alias("began"), F.max("at").alias("ended"))

    def annotations(self, asrt_id: str) -> DataFrame:
        return self.select("annotations", asrt_id=asrt_id)

    def meta_at(self, tx_seq: int, op_ordinal: int) -> DataFrame:
        """(asrt_id, key, kind, value) in force at a boundary, from the history in the package alone."""
        at = F.struct("tx_seq", "op_ordinal")
        limit = F.struct(F.lit(tx_seq).cast("long").alias("tx_seq"), F.lit(op_ordinal).alias("op_ordinal"))
        last = self["meta_history"].where(at <= limit).groupBy("asrt_id", "key").agg(F.max_by(F.struct("kind", "value"), at).alias("m"))
        return last.where("m.kind IS NOT NULL").select("asrt_id", "key", "m.kind", "m.value")

    def diff(self, other: Package, kind: str, key: str) -> DataFrame:
        """(key, change) between two packages' records: added, removed or changed."""
        a = self[kind].select(F.col(key), F.xxhash64(*self[kind].columns).alias("_a"))
        b = other[kind].select(F.col(key), F.xxhash64(*self[kind].columns).alias("_b"))
        both = a.join(b, key, "full_outer")
        change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
        return both.select(key, change.alias("change")).where("change IS NOT NULL")
