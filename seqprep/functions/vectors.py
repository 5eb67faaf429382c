"""Vector functions on ``array<double>`` columns (logits and probabilities)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqprep.functions.basics import let


def argmax(vector: Column) -> Column:
    """Zero-based index of the first maximum."""
    return let(vector, lambda v: F.array_position(v, F.array_max(v)) - 1).cast("int")


def _sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def log_sum_exp(vector: Column) -> Column:
    """Stable ``ln(sum(exp(v)))``."""

    def body(v: Column) -> Column:
        return let(
            F.array_max(v), lambda m: m + F.ln(_sum(F.transform(v, lambda x: F.exp(x - m))))
        )

    return let(vector, body)


def softmax(vector: Column) -> Column:
    def body(v: Column) -> Column:
        powers = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
        return let(powers, lambda p: let(_sum(p), lambda s: F.transform(p, lambda x: x / s)))

    return let(vector, body)


def token_prob(probs: Column, token: Column) -> Column:
    """The probability of one token id; null when the id is outside the vector."""
    return F.when(token >= 0, F.try_element_at(probs, token.cast("int") + 1))


def topk_tokens(vector: Column, k: int = 3) -> Column:
    """The ``k`` largest entries as ``array<struct<token, value>>``; ties go to the lower id.

    One pass that keeps the best ``k`` sorted: a later entry goes behind all that are as large.
    """
    item = "struct<token:int,value:double>"
    start = F.array().cast(f"array<{item}>")

    def step(best: Column, entry: Column) -> Column:
        full = F.size(best) >= k
        beaten = full & (entry["value"] <= F.element_at(best, -1)["value"])
        before = F.filter(best, lambda b: b["value"] >= entry["value"])
        after = F.filter(best, lambda b: b["value"] < entry["value"])
        put = F.slice(F.concat(before, F.array(entry), after), 1, k)
        return F.when(full & beaten, best).otherwise(put)

    entries = F.transform(
        vector, lambda x, i: F.struct(i.cast("int").alias("token"), x.cast("double").alias("value")).cast(item)
    )
    return F.aggregate(entries, start, step)


def token_nll(vector: Column, label: Column) -> Column:
    """Cross-entropy of one position: ``ln sum exp(v) - v[label]``."""
    return log_sum_exp(vector) - F.element_at(vector, label.cast("int") + 1)


def tail_slice(sequence: Column, n: Column) -> Column:
    """The last ``n`` elements, or the whole sequence when it is shorter."""

    def body(s: Column) -> Column:
        take = F.least(n.cast("int"), F.size(s))
        return F.slice(s, F.size(s) - take + 1, take)

    return let(sequence, body)
