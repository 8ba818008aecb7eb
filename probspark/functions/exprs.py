"""Column expressions: everything here stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def lit(x) -> Column:
    return F.lit(float(x))


def ln(c: Column) -> Column:
    """Natural logarithm; minus infinity at zero and null below."""
    return F.when(c == 0, lit(NEG_INF)).otherwise(F.log(c))


def lgamma(x: Column) -> Column:
    """ln Gamma of a positive column: the Stirling series at x + 8, brought back by the recurrence."""
    z = x + 8
    y = 1 / (z * z)
    s = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * (691 / 360360)))))) / z
    p = x
    for k in range(1, 8):
        p = p * (x + k)
    return s - F.log(p)


def total(terms: list[Column]) -> Column:
    """Sum of terms in which a missing one counts nothing."""
    out = F.coalesce(terms[0], lit(0))
    for t in terms[1:]:
        out = out + F.coalesce(t, lit(0))
    return out


def log_add(*terms: Column) -> Column:
    """ln of the sum of exponentials of columns, shifted by the largest; all minus infinity stays so.

    Terms are written out, so that a row costs as many steps as there are terms.
    """
    m = F.greatest(*terms)
    s = F.exp(terms[0] - m)
    for t in terms[1:]:
        s = s + F.exp(t - m)
    return F.when(m == NEG_INF, m).otherwise(m + F.log(s))


def logsumexp(a: Column) -> Column:
    """Of an array column.  One fold over (maximum, sum of exponentials below it), so a row costs as many steps as elements."""
    state = F.struct(lit(NEG_INF).alias("m"), lit(0).alias("s"))

    def step(s, x):
        m = F.greatest(s["m"], x)
        old = F.when(s["m"] == NEG_INF, lit(0)).otherwise(s["s"] * F.exp(s["m"] - m))
        new = F.when(x == NEG_INF, lit(0)).otherwise(F.exp(x - m))
        return F.struct(m.alias("m"), (old + new).alias("s"))

    return F.when(a.isNotNull(), F.aggregate(a, state, step, lambda s: F.when(s["m"] == NEG_INF, s["m"]).otherwise(s["m"] + F.log(s["s"]))))


def softmax(a: Column, total: Column) -> Column:
    """Shares of an array column; ``total`` is its logsumexp as a column of its own, not an expression to be repeated."""
    return F.transform(a, lambda x: F.exp(x - total))


def argmax(a: Column) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def look_up(values: list[float], index: Column) -> Column:
    """Element of a constant table; null index gives null, one out of range raises as ANSI arrays do."""
    return F.when(index.isNotNull(), F.element_at(F.array(*[lit(v) for v in values]), index.cast("int") + 1))


def look_up_code(values: list[float], cols: list[Column], cards) -> Column:
    """Element of a constant table at a row of codes; null where a code is missing, minus infinity where one is not in the table."""
    at, inside, there = lit(0).cast("int"), F.lit(True), F.lit(True)
    for x, k in zip(cols, cards):
        there = there & x.isNotNull()
        inside = inside & (x >= 0) & (x < int(k)) & (x == F.floor(x))
        at = at * int(k) + x.cast("int")
    table = F.array(*[lit(v) for v in values])
    return F.when(there & inside, F.element_at(table, F.when(there & inside, at).otherwise(F.lit(0)) + 1)).when(there, lit(NEG_INF))
