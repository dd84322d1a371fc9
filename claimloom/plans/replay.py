"""Sealed runs: the relations a query read, the query, and its result, to run again and compare."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Files
from .compile import FactSpace, evaluate
from .ir import RuleError, parse, predicates
from .scenario import diff


def capture(facts: FactSpace, where: Any, select: list[str] | None, path: str) -> dict:
    """Run a body and keep what it read and gave; only the predicates that it names are written."""
    path = path.rstrip("/")
    body = parse(where)
    names = sorted({n for b in body.branches for n in predicates(b)})
    columns = {}
    for k, name in enumerate(names):
        facts[name].write.parquet(f"{path}/facts/{k}")
        columns[name] = k
    sealed = FactSpace(facts.spark, {n: facts.spark.read.schema(facts[n].schema).parquet(f"{path}/facts/{k}") for n, k in columns.items()})
    evaluate(sealed, body, select).write.parquet(f"{path}/result")
    said = {"facts": columns, "body": repr(body), "select": select, "schemas": {n: facts[n].schema.json() for n in names}}
    said["digest"] = hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()
    if not Files(facts.spark, path).create(f"{path}/run.json", json.dumps(said, sort_keys=True)):
        raise RuleError(f"there is a run at {path}")
    return said


def sealed(spark: SparkSession, path: str) -> tuple[dict, FactSpace, DataFrame]:
    """A run's manifest, facts and result; a manifest that was changed is an error."""
    from pyspark.sql.types import StructType

    path = path.rstrip("/")
    said = json.loads(Files(spark, path).read(f"{path}/run.json"))
    digest = said.pop("digest")
    if hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest() != digest:
        raise RuleError(f"the run at {path} was changed")
    facts = {n: spark.read.schema(StructType.fromJson(json.loads(said["schemas"][n]))).parquet(f"{path}/facts/{k}") for n, k in said["facts"].items()}
    return said | {"digest": digest}, FactSpace(spark, facts), spark.read.parquet(f"{path}/result")


def replay(spark: SparkSession, path: str, where: Any) -> DataFrame:
    """Run the body again over the captured facts: rows that differ from the sealed result, with ``change``.

    The body must be the sealed one; another is an error.
    """
    said, facts, result = sealed(spark, path)
    if repr(parse(where)) != said["body"]:
        raise RuleError("this is not the body of the run")
    return diff(result, evaluate(facts, where, said["select"]).select(*result.columns))


def compare_runs(spark: SparkSession, one: str, other: str) -> DataFrame:
    """Rows of two sealed results that differ."""
    return diff(sealed(spark, one)[2], sealed(spark, other)[2])


def round_log(spark: SparkSession, path: str):
    """A recorder of events as JSON lines, one small file per event; returns (record, read)."""
    files, path = Files(spark, path), path.rstrip("/")
    files.make(path)

    def record(kind: str, payload: dict) -> int:
        number = len([n for n in files.names(path) if n.endswith(".json")])
        while not files.create(f"{path}/{number:09d}.json", json.dumps({"event": number, "kind": kind, "payload": json.dumps(payload, sort_keys=True)}) + "\n"):
            number += 1
        return number

    def read() -> DataFrame:
        return spark.read.schema("event long, kind string, payload string").json(f"{path}/*.json").orderBy(F.col("event"))

    return record, read
