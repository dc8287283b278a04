"""Seeded draws from counters, in plain integer arithmetic.

``draw(seed, a, b, ...)`` is a number in 0 .. 2^32 - 1 that depends on its
arguments only: a 32-bit mixer over the halves of each 64-bit argument.  All
steps are shifts, exclusive ors and products below 2^60, so any SQL engine
with 64-bit integers computes the same numbers (the oracles do).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 32
# The multiplier of the mixer, and the increment between arguments.
MULTIPLIER, INCREMENT = 73244475, 2654435769
_MASK = (1 << BITS) - 1


def draw(seed: int, *counters: Column) -> Column:
    """A long column; a null counter gives null.

    The steps are ``aggregate`` over the arguments' halves: each step's value
    is used several times, and written out the expression would double with each.
    """
    halves = [h for c in counters for h in (c.cast("long").bitwiseAND(F.lit(_MASK)),
                                            F.shiftrightunsigned(c.cast("long"), BITS).bitwiseAND(F.lit(_MASK)))]
    some_null = reduce(lambda a, b: a | b, [c.isNull() for c in counters])
    start = F.lit(seed & _MASK).cast("long")
    return F.when(~some_null, F.aggregate(F.array(*halves), start, _staged))


def _staged(x: Column, part: Column) -> Column:
    """One step, by inner aggregates so that each value is computed once."""
    first = (x + F.lit(INCREMENT)).bitwiseAND(F.lit(_MASK)).bitwiseXOR(part)
    mixed = F.aggregate(F.array(F.lit(0), F.lit(0)), first,
                        lambda y, _: (y.bitwiseXOR(F.shiftright(y, 16)) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(_MASK)))
    return F.aggregate(F.array(F.lit(0)), mixed, lambda y, _: y.bitwiseXOR(F.shiftright(y, 16)))


def sql(seed: int, *counters: str) -> str:
    """The same number as SQL text over bigint expressions that are not negative (for other engines)."""
    x = f"{seed & _MASK}::BIGINT"
    step = ("list_reduce([xor(({x} + " + str(INCREMENT) + ") & " + str(_MASK) + ", {part}), 0, 0]::BIGINT[], lambda y, z: "
            "(xor(y, y >> 16) * " + str(MULTIPLIER) + ") & " + str(_MASK) + ")")
    for c in counters:
        for part in (f"(({c}) & {_MASK})", f"((({c}) >> {BITS}) & {_MASK})"):
            x = f"list_reduce([{step.format(x=x, part=part)}, 0]::BIGINT[], lambda y, z: xor(y, y >> 16))"
    return x
