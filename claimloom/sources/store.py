"""A workspace: the ledger's tables as Parquet, with commits that appear whole or not at all.

A commit writes its rows into a folder of its own per table and then creates one small file,
``commits/<number>.json``, that names them.  Creating a name that exists fails, so of two
writers on one head one loses and retries.  Readers list the commits and read what they
name; rows of a lost or broken commit are never named.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import LANES, set_digest, state_of_token, state_token
from ..operators.views import ANNOTATIONS, CLAIM_META, CLAIMS, REVOCATIONS, TX_DEFAULTS, Ledger
from ..plans.ir import RuleError
from .shared import Files

TABLES = {"claims": CLAIMS, "claim_meta": CLAIM_META, "tx_defaults": TX_DEFAULTS, "revocations": REVOCATIONS, "annotations": ANNOTATIONS}


class HeadMoved(RuntimeError):
    """Another commit came first."""


class Workspace:
    """Tables in a folder of any store that Spark can write."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema_digest: str) -> Workspace:
        out = cls(spark, path)
        out.files.make(f"{out.path}/commits")
        first = {"tx": 0, "parent": None, "schema": schema_digest, "folders": {}, "state": state_token(np.zeros(LANES, np.uint16))}
        if not out.files.create(f"{out.path}/commits/{0:012d}.json", json.dumps(first, sort_keys=True)):
            raise RuleError(f"there is a workspace at {path}")
        return out

    def commits(self) -> list[dict]:
        return [json.loads(self.files.read(f"{self.path}/commits/{n}")) for n in self.files.names(f"{self.path}/commits") if n.endswith(".json")]

    def head(self) -> dict:
        found = self.commits()
        if not found:
            raise RuleError(f"no workspace at {self.path}")
        return found[-1]

    def ledger(self, tx: int | None = None) -> Ledger:
        """All tables as of a transaction; claims are laid out by predicate, so a scan prunes to its own."""
        found = [c for c in self.commits() if tx is None or c["tx"] <= tx]
        tables = {}
        for name, schema in TABLES.items():
            paths = [f"{self.path}/{name}/{c['folders'][name]}" for c in found if name in c["folders"]]
            tables[name] = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return Ledger(**tables)

    def commit(self, tables: Mapping[str, DataFrame], expected: int, schema_digest: str | None = None) -> dict:
        """Append rows per table on top of transaction ``expected``; raises HeadMoved if that is not the head."""
        head = self.head()
        if head["tx"] != expected:
            raise HeadMoved(f"the head is {head['tx']}, not {expected}")
        folders = {}
        for name, df in tables.items():
            kind = self.spark.createDataFrame([], TABLES[name]).schema
            folders[name] = uuid.uuid4().hex
            out = df.select(*[F.col(f.name).cast(f.dataType) for f in kind])
            if name == "claims":
                # row groups of few predicates; ranges split a predicate that has very many claims
                out = out.repartitionByRange("pred_id", "e_ref").sortWithinPartitions("pred_id", "e_ref")
            out.write.parquet(f"{self.path}/{name}/{folders[name]}")
        new = {"tx": expected + 1, "schema": schema_digest or head["schema"], "folders": folders}
        new["parent"] = hashlib.sha256(json.dumps(head, sort_keys=True).encode()).hexdigest()
        new["state"] = self._state(head["state"], folders)
        if not self.files.create(f"{self.path}/commits/{expected + 1:012d}.json", json.dumps(new, sort_keys=True)):
            raise HeadMoved(f"transaction {expected + 1} is there already")
        return new

    def _state(self, state: str, folders: Mapping[str, str]) -> str:
        """The set hash of all assertions and revocations, from the old one and the new rows alone."""
        total = state_of_token(state).astype(np.uint16)
        for name, key in (("claims", "asrt_id"), ("revocations", "revoker_asrt_id")):
            if name in folders:
                rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{folders[name]}")
                total = total + state_of_token(set_digest(rows.select(F.encode(F.concat(F.lit(f"{name}/"), F.col(key)), "UTF-8").alias("e")), "e")).astype(np.uint16)
        return state_token(total)

    def verify(self) -> bool:
        """Whether every commit names its parent by digest."""
        found = self.commits()
        return all(c["parent"] == hashlib.sha256(json.dumps(p, sort_keys=True).encode()).hexdigest() for p, c in zip(found, found[1:], strict=False))

    # named sets of assertions

    def create_view(self, name: str, ids: DataFrame) -> str:
        """Keep a set of assertion ids under a name; returns its digest."""
        if self.files.exists(f"{self.path}/views/{name}.json"):
            raise RuleError(f"there is a view {name}")
        folder = f"{self.path}/views/{uuid.uuid4().hex}"
        ids.select("asrt_id").distinct().write.parquet(folder)
        digest = set_digest(self.spark.read.parquet(folder).select(F.encode("asrt_id", "UTF-8").alias("e")), "e")
        said = json.dumps({"folder": folder.rsplit("/", 1)[1], "digest": digest, "tx": self.head()["tx"]})
        if not self.files.create(f"{self.path}/views/{name}.json", said):
            raise RuleError(f"there is a view {name}")
        return digest

    def view(self, name: str) -> Ledger:
        """Reads limited to a named set, as of the transaction at which it was made."""
        said = json.loads(self.files.read(f"{self.path}/views/{name}.json"))
        return self.ledger(said["tx"]).restricted(self.spark.read.schema("asrt_id string").parquet(f"{self.path}/views/{said['folder']}"))


__all__ = ["HeadMoved", "Workspace"]
