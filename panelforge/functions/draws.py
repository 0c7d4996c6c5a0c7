"""Random draws keyed by columns: the same key, name and seed give the same draw, however rows are partitioned.

Draws come from MD5, which any engine has, so another one can repeat them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # hexadecimal, so 52 bits


def uniform(seed: int, name: str, *keys: str) -> Column:
    """Uniform in (0, 1): the first 52 bits of the MD5 of seed, name and keys, joined by bars."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(name), *(F.col(k).cast("string") for k in keys))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("long")
    return (h.cast("double") + 0.5) / float(1 << 4 * _DIGITS)


def uniform_sql(seed: int, name: str, *keys: str) -> str:
    """The same in SQL of an engine that casts hexadecimal text."""
    text = " || '|' || ".join([f"'{seed}|{name}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"((CAST('0x' || substr(md5({text}), 1, {_DIGITS}) AS BIGINT) + 0.5) / {float(1 << 4 * _DIGITS)!r})"


def choice(u: Column, values: list) -> Column:
    """One of the values, equally likely."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def whole(u: Column, low: int, high: int) -> Column:
    """A whole number from low to high, equally likely."""
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def poisson_table(mean: float) -> list[float]:
    """The distribution function at 0, 1, ...; it ends where the rest is below 1e-16."""
    table, term, total, k = [], math.exp(-mean), 0.0, 0
    while total + term < 1.0 and (k < mean or term > 1e-16):
        total += term
        table.append(total)
        k += 1
        term *= mean / k
    return table


def poisson(u: Column, mean: float) -> Column:
    """Poisson by inversion."""
    return F.size(F.filter(F.array(*map(F.lit, poisson_table(mean))), lambda c: c < u)).cast("int")


def normal(u: Column, v: Column) -> Column:
    """Standard normal from two uniforms."""
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * v)


def log_normal(u: Column, v: Column, mean: float, deviation: float) -> Column:
    return F.exp(mean + deviation * normal(u, v))


def missing(u: Column, share: float, value: Column) -> Column:
    """The value, or null with the given probability."""
    return F.when(u >= share, value)
