"""Lists that a fold makes: gathered in blocks, since appending to one array would copy all of it each time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def nothing(kind: str) -> list[Column]:
    """The fields (blocks, open) of a fold's first state, for items of this type."""
    return [F.array().cast(f"array<array<{kind}>>").alias("blocks"), F.array().cast(f"array<{kind}>").alias("open")]


def added(state: Column, item: Column, wanted: Column | None = None) -> list[Column]:
    """The fields with one more item, if it is wanted."""
    full = F.size(state["open"]) >= BLOCK
    blocks = F.when(full, F.concat(state["blocks"], F.array(state["open"]))).otherwise(state["blocks"])
    rest = F.when(full, F.array(item)).otherwise(F.concat(state["open"], F.array(item)))
    if wanted is not None:
        blocks, rest = F.when(wanted, blocks).otherwise(state["blocks"]), F.when(wanted, rest).otherwise(state["open"])
    return [blocks.alias("blocks"), rest.alias("open")]


def gathered(state: Column) -> Column:
    """All items, in the order in which they came."""
    return F.concat(F.flatten(state["blocks"]), state["open"])
