"""A package of facts for other engines: one TSV folder per predicate, the schema and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import FactSpace
from ..plans.ir import RuleError
from ..schema import Schema
from .shared import Files
from .tsv import read_tsv, write_tsv

#: What the views mean, for readers of the package (fixed values).
POLICY = {"active": "revokes_only", "chosen": "latest_by_claim_seq", "mode": "edb"}


def export_facts(facts: FactSpace, schema: Schema, path: str) -> dict:
    """Write every relation of the schema; the manifest comes last."""
    path = path.rstrip("/")
    files = Files(facts.spark, path)
    counts = {}
    for k, p in enumerate(schema.predicates()):
        rel = facts[p.name]
        cols = [F.col(f"`{c}`") for c in facts.args(p.name)]
        shown = [F.base64(c) if t == "bytes" else c for c, t in zip(cols, p.args, strict=True)]
        asrt = F.col("_asrt") if "_asrt" in rel.columns else F.lit(None)
        out = rel.select(asrt.cast("string").alias("asrt"), *[c.alias(f"a{j}") for j, c in enumerate(shown)])
        write_tsv(out, f"{path}/facts/{k}")
        counts[p.name] = {"folder": k, "arity": len(p.args), "args": list(p.args)}
    files.create(f"{path}/schema.json", schema.to_json())
    manifest = {"format": 1, "schema": schema.digest(), "policy": POLICY, "predicates": counts}
    if not files.create(f"{path}/manifest.json", json.dumps(manifest, sort_keys=True)):
        raise RuleError(f"there is a package at {path}")
    return manifest


def read_facts(spark: SparkSession, path: str, schema: Schema) -> FactSpace:
    """A package's relations again; it must be of this schema."""
    path = path.rstrip("/")
    manifest = json.loads(Files(spark, path).read(f"{path}/manifest.json"))
    if manifest["schema"] != schema.digest():
        raise RuleError("the package has another schema")
    relations: dict[str, DataFrame] = {}
    for p in schema.predicates():
        kinds = [("_asrt", "string")] + [(f"a{j}", "string" if t == "bytes" else f.dataType.simpleString()) for j, (t, f) in enumerate(zip(p.args, p.struct(), strict=True))]
        rows = read_tsv(spark, f"{path}/facts/{manifest['predicates'][p.name]['folder']}", kinds)
        for j, t in enumerate(p.args):
            if t == "bytes":
                rows = rows.withColumn(f"a{j}", F.unbase64(f"a{j}"))
        relations[p.name] = rows.select(*[f"a{j}" for j in range(len(p.args))], F.nullif("_asrt", F.lit("")).alias("_asrt"))
    return FactSpace(spark, relations)
