"""Text operators: personal data, encoding, hashes, exact duplicates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters that text doesn't need.  Fixed values.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def repair(text: Column) -> Column:
    """Without control characters other than tab and line ends, in NFC."""
    return nfc(F.regexp_replace(text, CONTROL, ""))


def repaired(text: Column) -> Column:
    """Whether repair() changes a text; false for null."""
    return F.coalesce(repair(text) != text, F.lit(False))


def dedupe_exact(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """The first row of each content and its copies; null and empty contents differ.  Minima combine before the shuffle, so a hot content is a few rows."""
    digest = F.sha2(F.encode(content, "UTF-8"), 256)
    return rows.select(digest.alias("content_hash"), order).groupBy("content_hash").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def safe_stem(name: Column, cap: int = 240) -> Column:
    """A file name from an identifier: outer white space gone, path parts joined by _, no leading dots, bounded."""
    parts = F.filter(F.split(strip(name), r"[/\\]"), lambda p: ~p.isin("", ".", ".."))
    stem = F.substring(F.regexp_replace(F.array_join(parts, "_"), r"^\.+", ""), 1, cap)
    return F.when(F.coalesce(stem, F.lit("")) == "", "journey").otherwise(stem)


def strip(text: Column) -> Column:
    """Without white space of any script, or U+001C to U+001F, at either end."""
    space = r"[\s\x1c-\x1f]"
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)^{space}+", ""), rf"(?U){space}+\z", "")


def normalize_role(role: Column) -> Column:
    """One of the four roles, null if unknown.  Fixed values."""
    r = F.lower(strip(role))
    return F.when(r.isin("system", "user", "assistant", "tool"), r).when(r == "human", "user").when(r.isin("ai", "chatbot", "model", "tool_use"), "assistant").when(r.isin("function", "tool_result"), "tool")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
