"""Keyed draws that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DRAW_BITS = 60  # 15 hexadecimal digits


def draw(key: Column | str, seed: int = 0) -> Column:
    """A uniform integer in [0, 2^60), fixed by ``seed`` and the key."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")
