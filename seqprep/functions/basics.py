"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain column variable would be inlined wherever it is used, and inside a lambda that
    means once per array element. Binding it as a lambda argument evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``columns``, each evaluated once a row whatever later steps do with them.

    The optimiser moves a filter on a computed column below the projection that computes it, with a copy
    of the whole expression for every use. It moves none below a generator, here of one row for a row.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.withColumns(columns).select(*kept, F.inline(F.array(F.struct(*columns))))


def ints(*values: Column | int) -> Column:
    """An ``array<int>`` of the given values."""
    return F.array(*[F.lit(v).cast("int") if isinstance(v, int) else v.cast("int") for v in values])


def repeat(value: int, times: Column) -> Column:
    """``value`` repeated ``times`` times as ``array<int>``; a negative count gives an empty array."""
    return F.array_repeat(F.lit(value).cast("int"), F.greatest(times.cast("int"), F.lit(0)))


def ones(array: Column) -> Column:
    return repeat(1, F.size(array))


def masked(array: Column) -> Column:
    """The loss mask of a prompt: one ``IGNORE`` per element."""
    return repeat(IGNORE, F.size(array))


# The label value left out of the loss. It is also the id of ":" in the numeral vocabularies.
IGNORE = -1
