"""Small documents kept under the digest of their content."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import SparkSession

from ..plans.ir import RuleError
from .shared import Files


class ArtifactStore:
    """JSON documents in a folder of any store; equal documents are one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self.files = Files(spark, self.path)
        self.files.make(self.path)

    @staticmethod
    def _text(value: Any) -> str:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def put(self, value: Any) -> str:
        """Keep a document; returns its digest."""
        text = self._text(value)
        digest = hashlib.sha256(text.encode()).hexdigest()
        self.files.create(f"{self.path}/{digest}.json", text)
        return f"sha256:{digest}"

    def get(self, digest: str) -> Any:
        """The document, checked against its digest."""
        name = f"{self.path}/{digest.removeprefix('sha256:')}.json"
        if not self.files.exists(name):
            raise RuleError(f"no artifact {digest}")
        text = self.files.read(name)
        if f"sha256:{hashlib.sha256(text.encode()).hexdigest()}" != digest:
            raise RuleError(f"{digest} is not what is kept under it")
        return json.loads(text)

    def digests(self) -> list[str]:
        return [f"sha256:{n.removesuffix('.json')}" for n in self.files.names(self.path) if n.endswith(".json")]

    def collect(self, used: Iterable[str]) -> list[str]:
        """Delete what is not used any more; returns the digests that went."""
        gone = sorted(set(self.digests()) - set(used))
        for d in gone:
            self.files.delete(f"{self.path}/{d.removeprefix('sha256:')}.json")
        return gone
