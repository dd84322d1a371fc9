"""Canonical bytes, ids and digests of typed values.

The layouts follow the survey's section 1.4: a prefix, counts and lengths as four bytes
big-endian, a tag code and the value's bytes.  The prefixes separate this library's hashes
from others'; stores that must agree pass the same ``domain``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import struct
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMAIN = b"claimloom"
#: Codes of type tags in canonical bytes (fixed values).
TAG_CODES = {"string": 1, "int": 2, "float64": 3, "bool": 4, "bytes": 5, "time": 6, "uuid": 7, "entity_ref": 8}
REF_PREFIX = "idref_v1:"
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
ENTITY_TYPE = re.compile(r"[A-Za-z][A-Za-z0-9_.-]{0,127}")
LANES = 1024


def float_hex(value: float) -> str:
    """``0x`` and the 16 hex digits of the bits; minus zero counts as zero, NaN and infinities are errors."""
    value = float(value)
    if not math.isfinite(value):
        raise ValueError("float64 must be finite")
    return f"0x{struct.unpack('>Q', struct.pack('>d', value or 0.0))[0]:016x}"


def float_of_hex(text: str) -> float:
    return struct.unpack(">d", bytes.fromhex(text[2:]))[0]


def value_bytes(tag: str, value: Any) -> bytes:
    if tag in ("int", "time"):
        if isinstance(value, (bool, np.bool_)) or not isinstance(value, (int, np.integer)) or not -(2**63) <= value < 2**63:
            raise ValueError(f"{tag} must be a 64-bit integer")
        return str(int(value)).encode() if tag == "int" else struct.pack(">q", int(value))
    if tag == "float64":
        return bytes.fromhex(float_hex(value)[2:])
    if tag == "bool":
        if not isinstance(value, (bool, np.bool_)):
            raise ValueError("bool must be a boolean")
        return bytes([bool(value)])
    if tag == "bytes":
        return bytes(value)
    if not isinstance(value, str):
        raise ValueError(f"{tag} must be text")
    if tag == "uuid":
        if not UUID.fullmatch(value):
            raise ValueError("uuid must be lower-case 8-4-4-4-12")
        return bytes.fromhex(value.replace("-", ""))
    if tag == "entity_ref" and not value.startswith(REF_PREFIX):
        raise ValueError(f"a reference begins with {REF_PREFIX}")
    return value.encode()


def _framed(data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + data


def tuple_bytes(terms: list[tuple[str, Any]], domain: bytes = DOMAIN) -> bytes:
    parts = [bytes([TAG_CODES[t]]) + _framed(value_bytes(t, v)) for t, v in terms]
    return domain + b"\0tup_v1\0" + struct.pack(">I", len(parts)) + b"".join(parts)


def entity_ref(entity: str, identity: list[tuple[str, str, Any]], domain: bytes = DOMAIN) -> str:
    """The id of an entity: a hash over its type and identity fields (name, tag, value)."""
    if not ENTITY_TYPE.fullmatch(entity):
        raise ValueError(f"not an entity type: {entity}")
    out = domain + b"\0idref_v1\0" + _framed(entity.encode()) + struct.pack(">I", len(identity))
    for name, tag, value in identity:
        out += _framed(name.encode()) + bytes([TAG_CODES[tag]]) + _framed(value_bytes(tag, value))
    digest = base64.b32encode(hashlib.sha256(out).digest()).decode().rstrip("=").lower()
    return f"{REF_PREFIX}{entity}:{digest}"


def entity_ref_column(entity: str, identity: list[tuple[str, str]], *values: Column, domain: bytes = DOMAIN) -> Column:
    """Ids as a column, in Arrow batches; null where a value is null or does not encode."""

    @F.pandas_udf("string")
    def refs(*cols: pd.Series) -> pd.Series:
        out = []
        for row in zip(*(c.tolist() for c in cols), strict=True):
            try:
                if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in row):
                    out.append(None)
                    continue
                out.append(entity_ref(entity, [(n, t, int(v) if t in ("int", "time") else v) for (n, t), v in zip(identity, row, strict=True)], domain))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return refs(*values)


def ingest_key(pred: str, ref: str, terms: list[tuple[str, Any]], meta: dict[str, Any], domain: bytes = DOMAIN) -> str:
    """What makes a claim the same claim again: its content, its source and its validity."""

    def material(*names: str) -> bytes:
        return json.dumps({n: meta.get(n) for n in names}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()

    said = [("string", "ingest_key_v2"), ("string", pred), ("entity_ref", ref), *terms, ("bytes", material("source", "source_loc", "trace_id")), ("bytes", material("valid_from", "valid_to", "version"))]
    return "sha256:" + hashlib.sha256(tuple_bytes(said, domain)).hexdigest()


# set hash


def lane_vector(element: bytes, domain: bytes = DOMAIN) -> np.ndarray:
    """An element's 1024 lanes of 16 bits."""
    framed = domain + b"\0lthash16-v2\0element\0" + struct.pack(">Q", len(element)) + element
    return np.frombuffer(hashlib.shake_256(framed).digest(2 * LANES), "<u2")


def state_token(state: np.ndarray) -> str:
    return "lthash16-v2:" + base64.urlsafe_b64encode(state.astype("<u2").tobytes()).decode().rstrip("=")


def state_of_token(token: str) -> np.ndarray:
    text = token.removeprefix("lthash16-v2:")
    return np.frombuffer(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)), "<u2")


def set_digest(elements: DataFrame, column: str, domain: bytes = DOMAIN) -> str:
    """Digest of a set of binary elements that does not depend on order.

    Each task adds up its elements' lanes, so one vector of 2 KB per partition is moved.
    """

    def partial(batches):
        total = np.zeros(LANES, np.uint16)
        for batch in batches:
            for e in batch.column(0).to_pylist():
                total = total + lane_vector(e, domain)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<u2").tobytes()], pa.binary())], ["state"])

    parts = elements.select(column).where(F.col(column).isNotNull()).distinct().mapInArrow(partial, "state binary")
    # sums of partial sums by lane stay in Spark, so the driver gets 1024 numbers
    at = F.sequence(F.lit(0), F.lit(LANES - 1))
    lanes = parts.select(F.posexplode(F.transform(at, lambda k: F.conv(F.concat(F.hex(F.substring("state", k * 2 + 2, F.lit(1))), F.hex(F.substring("state", k * 2 + 1, F.lit(1)))), 16, 10).cast("long"))).alias("lane", "v"))
    sums = {r["lane"]: r["s"] % 65536 for r in lanes.groupBy("lane").agg(F.sum("v").alias("s")).collect()}
    return state_token(np.asarray([sums.get(k, 0) for k in range(LANES)], np.uint16))


def updated(token: str, added: list[bytes] = (), removed: list[bytes] = (), domain: bytes = DOMAIN) -> str:
    """A state after adding and removing elements, without the others."""
    state = state_of_token(token).astype(np.uint16)
    for e in added:
        state = state + lane_vector(e, domain)
    for e in removed:
        state = state - lane_vector(e, domain)
    return state_token(state)
