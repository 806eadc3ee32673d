"""Repeatable random numbers from keys: the same in Spark and in any SQL with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str | int) -> Column:
    """An integer below 2**32 from the md5 of the parts, joined by colons."""
    cols = [F.lit(str(p)) if isinstance(p, int) else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("long")


def hash32_sql(*parts: str) -> str:
    """The same as a DuckDB expression; parts are SQL expressions or quoted strings."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT)"
