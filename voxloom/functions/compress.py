"""Compression ratio: the one text measure without a built-in."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """UTF-8 bytes over zlib bytes at the default level; 0.0 for '', null for null."""
    out = []
    for t in texts:
        raw = None if t is None else t.encode()
        out.append(None if raw is None else len(raw) / len(zlib.compress(raw)) if raw else 0.0)
    return pd.Series(out, dtype="float64")
