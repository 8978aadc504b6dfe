"""User queries, read-only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_STARTS = re.compile(r"^\s*(?:select|with|from|values|show|describe|explain)\b", re.I)
# Words that write.
_WRITES = re.compile(r"\b(?:insert|update|delete|merge|create|drop|alter|truncate|set|load|copy|grant|revoke|cache|uncache|refresh|add|use|analyze|overwrite)\b", re.I)


def is_read_only(text: str) -> bool:
    """Whether a query begins with a reading word and holds no writing one outside quoted texts."""
    plain = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    return bool(_STARTS.match(plain)) and not _WRITES.search(plain) and ";" not in plain.rstrip().rstrip(";")


def guarded_sql(spark: SparkSession, text: str) -> DataFrame:
    if not is_read_only(text):
        raise ValueError("only reading queries are allowed")
    return spark.sql(text)
