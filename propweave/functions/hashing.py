"""Seeded pseudo-randomness that does not depend on partitioning or task order.

``rand()`` gives other numbers when a lost executor's task runs again; a digest of
the row's own key does not.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _cols(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def seeded_digest(seed: int, *keys: str | Column) -> Column:
    """32 hex digits that order rows at random, the same way on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in _cols(keys)]))


def seeded_bucket(n: int, seed: int, *keys: str | Column) -> Column:
    """Integer in [0, n) from the first 32 bits of the digest."""
    head = F.substring(seeded_digest(seed, *keys), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % F.lit(n)


def seeded_unit(seed: int, *keys: str | Column) -> Column:
    """Double in [0, 1) from the first 32 bits of the digest."""
    head = F.substring(seeded_digest(seed, *keys), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)
