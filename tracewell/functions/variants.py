"""Walks over JSON of any depth as expressions over VARIANT: one narrow pass, no Python and no shuffle.

VARIANT reads no object with a repeated key and nothing nested deeper than 1,000;
such texts, like others that are not JSON, give no rows.  What follows a whole value
is not read.  The keys of an object come in the order of their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: deepest nesting that the JSON reader takes.
DEEPEST = 1000


def members(v: Column) -> Column:
    """Keys and values of an object, null for anything else."""
    return F.try_variant_get(v, "$", "map<string, variant>")


def items(v: Column, path: str = "$") -> Column:
    """Items of a list, null for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def has_key(v: Column, name: str) -> Column:
    """Whether ``v`` is an object with this key; its values are not taken out, as that costs what lies below them."""
    return F.coalesce(F.map_contains_key(F.try_variant_get(v, "$", "map<string, boolean>"), name), F.lit(False))


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_at(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def walk(text: Column, first: Callable[[Column], Column], below: Callable[[Column], Column], found: Callable[[Column], Column], shape: str) -> Column:
    """All ``found`` of the nodes of a JSON text, level by level, as an array of ``shape``.

    ``first`` makes the root's entry of its VARIANT, ``below`` an array of the entries
    under an entry, ``found`` an array of results.  A text has no more levels than
    opening brackets; levels without entries cost nothing.
    """
    root = F.try_parse_json(text)
    openings = F.length(text) - F.length(F.translate(text, "{[", ""))
    levels = F.sequence(F.lit(0), F.least(openings, F.lit(DEEPEST)))
    start = F.when(root.isNotNull(), F.array(first(root)))
    nothing = F.array().cast(f"array<{shape}>")
    return F.when(
        root.isNotNull(),
        F.aggregate(
            levels, F.struct(start.alias("level"), nothing.alias("found")),
            lambda a, _: F.struct(F.flatten(F.transform(a["level"], below)).alias("level"), F.concat(a["found"], F.flatten(F.transform(a["level"], found))).alias("found")),
            lambda a: a["found"],
        ),
    ).otherwise(nothing)
