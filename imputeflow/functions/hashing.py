"""Seeded draws that depend on the row key only, never on partitioning.

One md5 per row gives three numbers below a prime; each (seed, tag) mixes them with its own
multipliers. Every step fits a signed 64-bit integer, so SQL engines give the same draws, and
Spark computes the md5 once per row however many columns draw.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the modulus, the largest prime below 2**31.
PRIME = 2**31 - 1


def multipliers(seed: int, tag: str) -> tuple[int, int, int]:
    digest = hashlib.md5(f"{seed}|{tag}".encode()).hexdigest()
    return tuple(1 + int(digest[i:i + 8], 16) % (PRIME - 1) for i in (0, 8, 16))


def key_numbers(key: Column | str) -> list[Column]:
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(key.cast("string"))
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % F.lit(PRIME)
            for at in (1, 9, 17)]


def hash_uniform(seed: int, tag: str, key: Column | str) -> Column:
    """A draw in [0, 1) fixed by seed, tag and key."""
    h1, h2, h3 = key_numbers(key)
    a, b, c = (F.lit(m).cast("bigint") for m in multipliers(seed, tag))
    x = (h1 * a + h2 * b) % F.lit(PRIME)
    return ((x * x + h3 * c) % F.lit(PRIME)).cast("double") / F.lit(float(PRIME))


def hash_uniform_sql(seed: int, tag: str, numbers=("h1", "h2", "h3")) -> str:
    """The same draw as SQL text over columns that hold the three key numbers."""
    h1, h2, h3 = numbers
    a, b, c = multipliers(seed, tag)
    x = f"(({h1} * {a} + {h2} * {b}) % {PRIME})"
    return f"((({x} * {x} + {h3} * {c}) % {PRIME})::DOUBLE / {PRIME}.0::DOUBLE)"


def key_numbers_sql(key: str) -> str:
    parts = [f"(('0x' || substr(md5({key}::VARCHAR), {at}, 8))::BIGINT % {PRIME}) AS h{i}"
             for i, at in ((1, 1), (2, 9), (3, 17))]
    return ", ".join(parts)
