"""Canonical JSON and its hash; values of a process as JSON."""

from __future__ import annotations

import dataclasses
import enum
import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that don't belong to the content.  Fixed values.
VOLATILE = frozenset({"idx"})
#: Depth and length at which coercion stops.  Fixed values.
DEPTH, SHORT = 12, 500


def canonical(value):
    """Objects with sorted keys, without volatile ones and those whose value is null; lists keep their nulls."""
    if isinstance(value, dict):
        pairs = ((k, canonical(v)) for k, v in sorted(value.items()) if k not in VOLATILE)
        return {k: v for k, v in pairs if v is not None}
    return [canonical(v) for v in value] if isinstance(value, list | tuple) else value


def rendered(value) -> str:
    return json.dumps(canonical(value), separators=(",", ":"), ensure_ascii=False)


def content_hash(value) -> str:
    """SHA-256 of the canonical JSON."""
    return hashlib.sha256(rendered(value).encode()).hexdigest()


def _of_json(f):
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else f(json.loads(v))
            except (ValueError, RecursionError):
                return None

        return values.map(one)

    return run


@F.pandas_udf(T.StringType())
def hash_json(values: pd.Series) -> pd.Series:
    """content_hash() of JSON text; null for null and for what isn't JSON."""
    return _of_json(content_hash)(values)


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null for null and for what isn't JSON."""
    return _of_json(rendered)(values)


def stamped(document: str, content: str) -> str:
    """A journey's document with the hash of its content, and the idempotency key made of it, in its telemetry; both are JSON texts."""
    doc, digest = json.loads(document), content_hash(json.loads(content))
    data = doc["telemetry"]["data"]
    data |= {"content_hash": digest, "idempotency_key": f"{doc['telemetry']['source']}:{data['conversation_id']}:{digest}"}
    return json.dumps(doc, sort_keys=True, ensure_ascii=False)


def idempotency_key(source: Column, run: Column, digest: Column) -> Column:
    return F.concat_ws(":", source, run.cast("string"), digest)


def jsonable(value, depth: int = DEPTH):
    """A value of any type as what JSON can say: enums by value, models by field, sets as lists, the rest by its representation."""
    if value is None or isinstance(value, bool | int | float | str) and not isinstance(value, enum.Enum):
        return value
    if isinstance(value, enum.Enum):
        return jsonable(value.value, depth)
    if depth > 0:
        if isinstance(value, dict):
            return {str(k): jsonable(v, depth - 1) for k, v in value.items()}
        if isinstance(value, list | tuple):
            return [jsonable(v, depth - 1) for v in value]
        if isinstance(value, set | frozenset):
            return sorted((jsonable(v, depth - 1) for v in value), key=lambda x: json.dumps(x, sort_keys=True, default=str))
        if dataclasses.is_dataclass(value) and not isinstance(value, type):
            return {f.name: jsonable(getattr(value, f.name), depth - 1) for f in dataclasses.fields(value)}
        for name in ("model_dump", "to_dict", "_asdict"):
            if callable(method := getattr(value, name, None)):
                return jsonable(method(), depth - 1)
    return repr(value)[:SHORT]
