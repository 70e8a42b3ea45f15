"""Seeded pseudo-random choices by md5 of a row key: repeatable on any engine and after retries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(key: str | list[str], seed: int) -> Column:
    keys = [key] if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys], F.lit(str(seed))))


def hex_number(text: Column, start: int, digits: int = 8) -> Column:
    """`digits` hex digits of a digest, from 1-based `start`, as a long."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("long")


def below(text: Column, fraction: float, start: int = 1) -> Column:
    """True for `fraction` of all digests: compares eight hex digits as text."""
    cut = round(fraction * 16**8)
    if cut >= 16**8:
        return F.lit(True)
    return F.substring(text, start, 8) < F.lit(f"{cut:08x}")
