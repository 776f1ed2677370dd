"""Secrets by the name of their key in free-form JSON: masking them, and finding those that were not masked."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import pii

#: Names of keys that hold secrets, and the mark of a masked value.  Fixed values.
SECRET_KEYS = frozenset(
    {
        "password",
        "passwd",
        "secret",
        "token",
        "api_key",
        "apikey",
        "authorization",
        "auth",
        "cvv",
        "pin",
        "otp",
        "ssn",
        "card_number",
        "account_number",
        "credit_card",
    }
)
MARK = "[REDACTED]"


def is_secret(key: str) -> bool:
    """Whether a key, or a part of it between - and _, names a secret."""
    key = key.lower()
    return not SECRET_KEYS.isdisjoint({key, *re.split("[-_]", key)})


def _empty(value) -> bool:
    return value is None or (isinstance(value, str | list | dict) and not value)


def mask(value):
    """A copy in which non-empty values of secret keys are the mark, at any depth."""
    if isinstance(value, list):
        return [mask(v) for v in value]
    if not isinstance(value, dict):
        return value
    return {k: MARK if is_secret(k) and not _empty(v) else mask(v) for k, v in value.items()}


def unmasked(value) -> list[str]:
    """An error for each secret key whose value is neither empty nor the mark, at any depth.  Fixed values: the wording."""
    found, todo = [], [value]
    while todo:
        at = todo.pop()
        if isinstance(at, dict):
            found += [f"unredacted key {k!r} (value: {v!r})" for k, v in at.items() if is_secret(k) and not _empty(v) and v != MARK]
            at = list(at.values())
        if isinstance(at, list):
            todo.extend(reversed(at))
    return found


def content_findings(value, rules) -> list[str]:
    """An error for each rule that the content or reasoning of a journey's messages breaks.  Fixed values: the wording."""
    found = []
    for step in value.get("steps") or [] if isinstance(value, dict) else []:
        for m in step.get("messages") or []:
            for field in ("content", "reasoning") if isinstance(m, dict) else ():
                if isinstance(m.get(field), str):
                    found += [f"unredacted {rule} in message.{field} ({n} match(es))" for rule, n in sorted(pii.scan(m[field], rules)[0].items())]
    return found


#: Where events carry free-form JSON; their content is left alone.
EVENT_FIELDS = (("metadata",), ("message", "metadata"), ("message", "tool_calls", "arguments"), ("message", "tool_response", "arguments"), ("message", "tool_response", "response"), ("message", "tool_response", "metadata"))


def mask_event(event: dict) -> dict:
    """An event with the secrets in its free-form fields masked."""

    def at(value, path: tuple[str, ...]):
        if isinstance(value, list):
            return [at(v, path) for v in value]
        if not isinstance(value, dict) or path[0] not in value:
            return value
        inner = value[path[0]]
        return value | {path[0]: at(inner, path[1:]) if path[1:] else mask(inner)}

    for path in EVENT_FIELDS:
        event = at(event, path)
    return event


def mask_header(header: dict) -> dict:
    """A header with the secrets in its journey's metadata masked."""
    return header | {"journey_metadata": mask(header["journey_metadata"])} if header.get("journey_metadata") else header


def _over_json(f, otherwise):
    """f of JSON texts; otherwise for what isn't JSON."""

    def one(text):
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return otherwise
        return f(value)

    return one


def _dumped(f):
    return _over_json(lambda v: json.dumps(f(v), separators=(",", ":"), ensure_ascii=False), None)


def _masking(f):
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        one = _dumped(f)
        return values.map(lambda v: None if v is None else one(v))

    return run


#: JSON text with its secrets masked; null for null and for what isn't JSON, which is_json() tells apart.
redact_json = _masking(mask)
redact_event_json = _masking(lambda v: mask_event(v) if isinstance(v, dict) else v)
redact_header_json = _masking(lambda v: mask_header(v) if isinstance(v, dict) else v)


def is_json(text):
    """Whether a text is JSON; null for null."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull())


@F.pandas_udf(T.ArrayType(T.StringType()))
def unmasked_json(values: pd.Series) -> pd.Series:
    """Errors of the secrets left in JSON text; none for null, one for what isn't JSON."""
    one = _over_json(unmasked, ["not JSON"])
    return values.map(lambda v: [] if v is None else one(v))


def findings_json(rules):
    """Errors of the personal data left in a journey's JSON, by the rules given."""
    rules = tuple(rules)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(values: pd.Series) -> pd.Series:
        one = _over_json(lambda v: content_findings(v, rules), ["not JSON"])
        return values.map(lambda v: [] if v is None else one(v))

    return run
