"""Scalar formulas shared by jobs and queries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """Seeded draw of 60 bits from a BIGINT key: the first 15 hexadecimal digits of MD5 of ``key:seed``.

    Every engine can compute it, seeds share nothing, and it does not depend on partitioning.
    """
    text = F.concat(key.cast("bigint").cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def pick(key: Column, seed: int, n) -> Column:
    """Seeded draw in ``[0, n)`` from a BIGINT key, for n up to 2^60 and beyond any row count."""
    n = F.lit(n).cast("bigint") if not isinstance(n, Column) else n.cast("bigint")
    return F.pmod(draw(key, seed), n)


def uniform(key: Column, seed: int) -> Column:
    """Seeded draw in the open interval (0, 1)."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52))
    return (h.cast("double") + 0.5) / float(1 << 52)


def normal(key: Column, seed: int) -> Column:
    """Seeded standard normal draw (Box-Muller), independent of row order and partitioning."""
    radius = F.sqrt(-2.0 * F.ln(uniform(key, 2 * seed + 1)))
    return radius * F.cos(2 * math.pi * uniform(key, 2 * seed + 2))


def condensed_index(i: Column, j: Column, n) -> Column:
    """Position of the pair (i<j) in the row-major upper triangle of an n x n matrix."""
    n = n if isinstance(n, Column) else F.lit(n)
    i, j, n = i.cast("bigint"), j.cast("bigint"), n.cast("bigint")
    return n * i - F.floor(i * (i + 1) / 2).cast("bigint") + j - i - 1


def batch_rows(step: Column, steps: int, smallest: int, largest: int) -> Column:
    """Batch size growing linearly over training, rounded to whole 200s (ties to even)."""
    size = F.bround(step / F.lit(float(steps)) * (largest - smallest) + smallest)
    return (F.bround(size / 200.0) * 200).cast("bigint")


def hop_length_limit(step: Column, steps: int, shortest: float, longest: float) -> Column:
    return F.pow(step / F.lit(float(steps)), F.lit(0.15)) * (shortest - longest) + longest


def cosine_with_warmup(epoch: int, lr: float, start_factor: float = 0.1, warmup_epochs: int = 5,
                       T_max: int = 50) -> float:
    """Learning rate of ``epoch`` (0-based): linear warm-up, then a cosine down to zero."""
    if epoch < warmup_epochs:
        return lr * (start_factor + (1 - start_factor) * epoch / warmup_epochs)
    span = max(T_max - warmup_epochs, 1)
    return lr * 0.5 * (1 + math.cos(math.pi * min(epoch - warmup_epochs, span) / span))


def linear_lr(epoch: int, lr: float, start_factor: float = 1.0 / 3, end_factor: float = 1.0,
              total_iters: int = 5) -> float:
    part = min(epoch, total_iters) / total_iters
    return lr * (start_factor + (end_factor - start_factor) * part)


def cosine_lr(epoch: int, lr: float, T_max: int = 50, eta_min: float = 0.0) -> float:
    return eta_min + (lr - eta_min) * 0.5 * (1 + math.cos(math.pi * min(epoch, T_max) / T_max))
