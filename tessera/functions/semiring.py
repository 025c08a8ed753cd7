"""Semirings for closures, walks and matrix products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """plus is an aggregate over a column, times combines two columns. An absent row is zero; a unit
    label must not be zero. idempotent: plus of a label with itself is the label, which the
    iterative closures need."""

    name: str
    plus: Callable[[Column], Column]
    times: Callable[[Column, Column], Column]
    zero: Column | None = None
    idempotent: bool = True


BOOLEAN = Semiring("boolean", F.bool_or, lambda a, b: a & b)
COUNTING = Semiring("counting", F.sum, lambda a, b: a * b, idempotent=False)
MIN_PLUS = Semiring("min-plus", F.min, lambda a, b: a + b)
MAX_MIN = Semiring("max-min", F.max, lambda a, b: F.least(a, b))

#: Occurrence labels in the order in which one decides a composition with another (unused,
#: mixed, negative, positive, guarded, strict); only two negatives differ, they make a positive.
POLARITIES = ("_", "*", "-", "+", "g+", "++")


def polarity_times(a: Column, b: Column) -> Column:
    """Composition of occurrence labels along a walk; "++" is the unit."""
    order = F.array(*map(F.lit, POLARITIES))
    first = F.element_at(order, F.least(F.array_position(order, a), F.array_position(order, b)).cast("int"))
    return F.when((a == "-") & (b == "-"), F.lit("+")).otherwise(first)


def polarity_plus(label: Column) -> Column:
    """Aggregate: the meet. Mixed wins, as does a negative beside any positive; then negative, positive, strict,
    guarded; unused is the zero."""
    has = lambda *x: F.bool_or(label.isin(*x))
    return (
        F.when(has("*") | (has("-") & has("+", "g+", "++")), F.lit("*"))
        .when(has("-"), F.lit("-")).when(has("+"), F.lit("+")).when(has("++"), F.lit("++")).when(has("g+"), F.lit("g+")).otherwise(F.lit("_"))
    )


POLARITY = Semiring("polarity", polarity_plus, polarity_times)
