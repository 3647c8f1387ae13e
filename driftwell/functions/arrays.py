"""Passes over array columns whose time grows with the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a chunk: appending to its result copies that result only.
CHUNK = 256


def empty(kind: str) -> Column:
    return F.expr("array()").cast(f"array<{kind}>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def swept(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What one pass from left to right gives: ``step(state, item)`` is the next state and an array of results of type ``kind``.

    A plain fold would copy all results for each new one. Here chunks are folded one after another, and their results joined at the end.
    """

    def chunk(acc: Column, part: Column) -> Column:
        def one(inner: Column, x: Column) -> Column:
            new, more = step(inner["state"], x)
            return F.struct(new.alias("state"), F.concat(inner["out"], more).alias("out"))

        found = F.aggregate(part, F.struct(acc["state"].alias("state"), empty(kind).alias("out")), one)
        return bound(found, lambda f: F.struct(f["state"].alias("state"), F.concat(acc["parts"], F.array(f["out"])).alias("parts")))

    def whole(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(CHUNK)), lambda k: F.slice(x, k + 1, CHUNK))
        return F.aggregate(chunks, F.struct(state.alias("state"), empty(f"array<{kind}>").alias("parts")), chunk, lambda acc: F.flatten(acc["parts"]))

    return bound(items, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(empty(kind)))
