"""Scores of vulnerabilities and codecs of vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Weights of the metrics of the public scoring standard, version 3.1.
_AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
_AC = {"L": 0.77, "H": 0.44}
_PR = {"N": 0.85, "L": 0.62, "H": 0.27}
_PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
_UI = {"N": 0.85, "R": 0.62}
_CIA = {"H": 0.56, "L": 0.22, "N": 0.0}


def _metric(v: Column, name: str, weights: dict[str, float]) -> Column:
    letter = F.regexp_extract(v, rf"(?:^|/){name}:([A-Z])", 1)
    return F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[letter]


def cvss_score(vector: Column) -> Column:
    """Base score of a version 3 vector, to one decimal, rounded up; null where a metric is missing or unknown."""
    changed = F.regexp_extract(vector, r"(?:^|/)S:([UC])", 1) == "C"
    iss = 1 - (1 - _metric(vector, "C", _CIA)) * (1 - _metric(vector, "I", _CIA)) * (1 - _metric(vector, "A", _CIA))
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    pr = F.when(changed, _metric(vector, "PR", _PR_CHANGED)).otherwise(_metric(vector, "PR", _PR))
    exploit = 8.22 * _metric(vector, "AV", _AV) * _metric(vector, "AC", _AC) * pr * _metric(vector, "UI", _UI)
    raw = F.least(F.when(changed, 1.08 * (impact + exploit)).otherwise(impact + exploit), F.lit(10.0))
    known = F.regexp_extract(vector, r"(?:^|/)S:([UC])", 1) != ""
    return F.when(known & exploit.isNotNull() & impact.isNotNull(), F.when(impact <= 0, 0.0).otherwise(F.ceil(F.round(raw * 10, 4)) / 10))


def cvss_severity(score: Column) -> Column:
    """critical from 9, high from 7, medium from 4, else low."""
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score.isNotNull(), "low")


@F.pandas_udf(T.BinaryType())
def floats_to_bytes(v: pd.Series) -> pd.Series:
    """Four bytes per number, the lowest first; null stays null."""
    return v.map(lambda x: None if x is None else x.astype("<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def bytes_to_floats(b: pd.Series) -> pd.Series:
    import numpy as np

    return b.map(lambda x: None if x is None else np.frombuffer(bytes(x), "<f4"))
