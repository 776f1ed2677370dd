"""Personal data in prose: counting, masked samples, redaction.

Exact guards come first: a text without "@" holds no e-mail, one without enough
digits no number; the patterns run on the few that are left.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns by rule.  Fixed values.
PATTERNS: dict[str, str] = {
    "EMAIL": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "PHONE": r"(?<!\d)(?:\+?\d{1,2}[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?!\d)",
    "CREDIT_CARD": r"\b(?:\d[ -]?){12,18}\d\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
}
RULES = tuple(PATTERNS)
#: Characters on either side of a sample, and samples of a rule.
CONTEXT, SAMPLES = 12, 3

_COMPILED = {rule: re.compile(p) for rule, p in PATTERNS.items()}
#: What every match of a rule holds.
_GUARDS = {"EMAIL": re.compile("@"), "PHONE": re.compile(r"\d{3}[-.\s]\d{4}"), "CREDIT_CARD": re.compile(r"\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"), "SSN": re.compile(r"-\d{2}-")}


def luhn(digits: str) -> bool:
    """Whether the checksum of a number holds; any script's decimal digits count."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _sound(rule: str, found: str) -> bool:
    return rule != "CREDIT_CARD" or luhn(found.replace(" ", "").replace("-", ""))


def matches(text: str, rule: str) -> list[re.Match]:
    """Matches of a rule; none for a rule that isn't known."""
    if rule not in _COMPILED or not _GUARDS[rule].search(text):
        return []
    return [m for m in _COMPILED[rule].finditer(text) if _sound(rule, m[0])]


def redact(text: str, rules: Sequence[str] = RULES) -> str:
    """Each match replaced where it stands, rule by rule, over what the rules before have left."""
    for rule in rules:
        if rule in _COMPILED and _GUARDS[rule].search(text):
            mark = f"[REDACTED_{rule}]"
            text = _COMPILED[rule].sub(lambda m: mark if _sound(rule, m[0]) else m[0], text)  # noqa: B023
    return text


def scan(text: str, rules: Sequence[str] = RULES) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Counts by rule, and the first matches of each as (rule, masked context)."""
    counts, samples = {}, []
    for rule in rules:
        if found := matches(text, rule):
            counts[rule] = len(found)
            for m in found[:SAMPLES]:
                samples.append((rule, f"{text[max(0, m.start() - CONTEXT) : m.start()]}[{rule}]{text[m.end() : m.end() + CONTEXT]}"))
    return counts, samples


_SCAN = T.StructType([T.StructField("counts", T.MapType(T.StringType(), T.LongType())), T.StructField("samples", T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("context", T.StringType())])))])


def _suspect(text: Column, rules: Sequence[str]) -> Column:
    """Whether any pattern can match, by one look in the JVM; texts that can't stay out of Python."""
    tests = {"EMAIL": F.contains(text, F.lit("@"))}
    digits = text.rlike(r"(?U)\d[-.\s ]?\d")
    out = F.lit(False)
    for rule in rules:
        if rule in PATTERNS:
            out = out | tests.get(rule, digits)
    return out


def redacted(text: Column, rules: Sequence[str] = RULES) -> Column:
    """redact() of a column; null stays null."""
    rules = tuple(rules)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t, rules))

    # a UDF can't be skipped row by row, but its input can be null
    return F.coalesce(run(F.when(_suspect(text, rules), text)), text)


def scanned(text: Column, rules: Sequence[str] = RULES) -> Column:
    """scan() of a column as a struct of counts and samples; empty for null."""
    rules = tuple(rules)

    @F.pandas_udf(_SCAN)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [({}, []) if t is None else scan(t, rules) for t in texts]
        return pd.DataFrame({"counts": [c for c, _ in found], "samples": [[{"rule": r, "context": x} for r, x in s] for _, s in found]})

    return run(F.when(_suspect(text, rules), text))


def counts(text: Column, rules: Sequence[str] = RULES) -> dict[str, Column]:
    found = scanned(text, rules)
    return {rule: F.coalesce(found["counts"][rule], F.lit(0)).cast("long") for rule in rules}
