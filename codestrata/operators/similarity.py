"""Similarity of code bodies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from codestrata.session import ship

#: Above so many cells of the table, both bodies are taken in strides of equal size.
MAX_CELLS = 1_000_000
_STEPS = [(r"//[^\n]*", ""), (r"#[^\n]*", ""), (r"/\*.*?\*/", ""), (r'""".*?"""', "S"), (r"'''.*?'''", "S"), (r"""(['"`])[^'"`]*['"`]""", "S"), (r"\b\d+\.?\d*\b", "N"), (r"\s+", " ")]


def normalise(code: str) -> str:
    """Code without comments, with texts as S, numbers as N and single blanks."""
    for a, b in _STEPS:
        code = re.sub(a, b, code, flags=re.S)
    return code.strip()


def lcs_ratio(a: str | None, b: str | None) -> float:
    """Length of the longest common subsequence over the longer body; 0 for missing or empty ones. Bit-parallel, so linear in one length."""
    if not a or not b:
        return 0.0
    x, y = normalise(a), normalise(b)
    if not x or not y:
        return 0.0
    if len(x) * len(y) > MAX_CELLS:
        k = -(-max(len(x), len(y)) // 1000)
        x, y = x[::k], y[::k]
    masks: dict = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    s = full
    for c in y:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return (len(x) - bin(s).count("1")) / max(len(x), len(y))


def first_two_similar(functions: DataFrame, least: float = 0.7) -> DataFrame:
    """(repo_id, name, n_files, similarity) of names in three or more files whose first two bodies are alike."""
    ship(functions.sparkSession)
    w = W.partitionBy("repo_id", "name").orderBy("fn_id")
    f = functions.select("repo_id", "name", "file", "fn_id", "code").withColumn("rn", F.row_number().over(w))
    p = f.groupBy("repo_id", "name").agg(F.countDistinct("file").alias("n_files"), F.max(F.when(F.col("rn") == 1, F.col("code"))).alias("a"), F.max(F.when(F.col("rn") == 2, F.col("code"))).alias("b")).where("n_files >= 3")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    return p.select("repo_id", "name", "n_files", F.round(ratio("a", "b"), 4).alias("similarity")).where(F.col("similarity") > least)
