"""Random draws that depend on the row and never on partitioning.

Every draw hashes ``seed|row id|salt[|position]`` with md5, so a re-run task, another
partition count or another engine yields the same value. ``rand(seed)`` would not: it
follows the partition layout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 4294967296  # first 8 hex digits of the digest


@dataclass(frozen=True)
class Draws:
    """All draws of one row."""

    seed: int
    row_id: Column

    def digest(self, salt: str, pos: Column | None = None) -> Column:
        parts = [F.lit(str(self.seed)), self.row_id.cast("string"), F.lit(salt)]
        if pos is not None:
            parts.append(pos.cast("string"))
        return F.md5(F.concat_ws("|", *parts))

    def number(self, salt: str, pos: Column | None = None) -> Column:
        """A whole number in ``0 .. 2^32-1``."""
        return F.conv(F.substring(self.digest(salt, pos), 1, 8), 16, 10).cast("bigint")

    def uniform(self, salt: str, pos: Column | None = None) -> Column:
        """A double in ``[0, 1)``."""
        return self.number(salt, pos) / F.lit(float(DRAW_RANGE))

    def below(self, limit: Column, salt: str, pos: Column | None = None) -> Column:
        """A whole number in ``0 .. limit-1``; ``limit`` must be positive."""
        return (self.number(salt, pos) % limit).cast("int")

    def pick(self, choices: Column, salt: str, pos: Column | None = None) -> Column:
        """One element of ``choices``, or null when there is none."""
        index = self.below(F.size(choices), salt, pos)
        return F.when(F.size(choices) > 0, F.element_at(choices, index + 1))

    def shuffled(self, array: Column, salt: str) -> Column:
        """The zero-based positions of ``array`` in random order."""
        keyed = F.transform(
            array, lambda _, i: F.struct(self.digest(salt, i).alias("k"), i.cast("int").alias("i"))
        )
        return F.transform(F.sort_array(keyed), lambda s: s["i"])
