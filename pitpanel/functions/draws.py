"""Random numbers that depend on keys only, never on partitioning.

``rand(seed)`` differs with the number of partitions and on a retried task;
hashes of (seed, keys) do not.  The hash is md5 of ``seed:key:key...`` as text, so that
other engines, SQL among them, can draw the same numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Default seed of every operator that draws.
SEED = 7_310_429

#: Signs that one hash gives, a bit each, and hexadecimal digits of a uniform number.
SIGNS_A_HASH, DIGITS = 128, 13


def key_text(*keys: Column) -> Column:
    return F.concat_ws(":", *[k.cast("string") for k in keys])


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform on (0, 1) with 52 random bits."""
    digits = F.substring(F.md5(key_text(F.lit(seed), *keys)), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal from two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, F.lit(1), *keys)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, F.lit(2), *keys))


def signs(seed: int, texts: Sequence[str], first: int, last: int) -> np.ndarray:
    """+1.0 or -1.0 with equal chance, in the task: a row for each text, a column for each draw from ``first`` to ``last`` - 1.

    Draw d is bit d % 128, from the left, of the md5 of ``seed:(d // 128):text``.
    """
    begin, end = first // SIGNS_A_HASH, -(-last // SIGNS_A_HASH)
    hashes = b"".join(hashlib.md5(f"{seed}:{block}:{text}".encode()).digest() for text in texts for block in range(begin, end))
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(len(texts), -1)
    return bits[:, first - begin * SIGNS_A_HASH:last - begin * SIGNS_A_HASH] * 2.0 - 1.0


def choice(seed: int, n: Column | int, *keys: Column) -> Column:
    """Integer in 0..n-1."""
    count = n if isinstance(n, Column) else F.lit(n)
    return F.least(F.floor(uniform(seed, *keys) * count), count.cast("bigint") - F.lit(1)).cast("bigint")
