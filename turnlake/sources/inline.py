"""Compressed response bodies held in a column."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def response_text(body: Column, encoding: Column) -> Column:
    """Body as text; gzip and deflate bodies are unpacked, unreadable ones kept.

    Spark has no expression for inline gzip, hence the Arrow-batched function.
    It sees the bytes of compressed rows only, and nulls for the others.
    """

    def inflate(data: bytes | None) -> bytes | None:
        try:
            return None if data is None else gzip.decompress(data)
        except (OSError, EOFError, zlib.error):
            return data

    @F.pandas_udf(BinaryType())
    def gunzip(bodies: pd.Series) -> pd.Series:
        return bodies.map(inflate)

    packed = F.coalesce(F.lower(encoding).isin("gzip", "deflate"), F.lit(False))
    return F.when(packed, F.decode(gunzip(F.when(packed, body)), "UTF-8")).otherwise(F.decode(body, "UTF-8"))
