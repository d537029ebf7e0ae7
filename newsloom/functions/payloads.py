"""Walking JSON payloads held as VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def member(value: Column, name: Column) -> Column:
    """The member of a JSON object, null where there is none."""
    quote = F.when(F.contains(name, F.lit("'")), F.lit('"')).otherwise(F.lit("'"))
    return F.try_variant_get(value, F.concat(F.lit("$["), quote, name, quote, F.lit("]")), "variant")


def as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def keys_of(value: Column) -> Column:
    """Key names of a JSON object."""
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def get_path(data: Column, path: Column) -> Column:
    """Follow a dotted path through objects and lists; an empty path or ``$`` is the payload itself.

    A part is a key in an object and an index in a list, counted from the end when negative. Dead ends are null.
    """

    def step(value: Column, part: Column) -> Column:
        entries = as_list(value)
        index = F.when(part.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(part).try_cast("int"))
        from_start = F.when(index < 0, F.size(entries) + index).otherwise(index)
        return F.when(entries.isNotNull(), F.get(entries, from_start)).otherwise(member(value, part))

    root = F.coalesce(path, F.lit("")).isin("", "$")
    return F.when(root, data).otherwise(F.aggregate(F.split(path, r"\."), data, step))


def value_text(value: Column) -> Column:
    """A JSON value as text: scalars plainly, objects and lists as JSON. A number with a fraction shows one."""
    kind, plain = F.schema_of_variant(value), value.cast("string")
    # Long whole numbers are decimals as well, but have more digits than a fraction of zero leaves.
    whole = kind.startswith("DECIMAL") & ~F.contains(plain, F.lit(".")) & (F.length(plain) <= 18)
    return F.when(kind == "BOOLEAN", F.initcap(plain)).when(whole, F.concat(plain, F.lit(".0"))).otherwise(plain)


def has_value(value: Column) -> Column:
    """Neither missing, null, empty, zero nor false."""
    kind, plain = F.schema_of_variant(value), value.cast("string")
    nothing = (
        F.when(kind == "STRING", plain == "")
        .when(kind == "BOOLEAN", plain == "false")
        .when(kind.startswith("ARRAY"), plain == "[]")
        .when(kind.startswith("OBJECT"), plain == "{}")
        .otherwise(plain.try_cast("double") == 0)
    )
    return F.coalesce(~nothing, plain.isNotNull())


def pick_field(keys: Column, candidates: Sequence[str]) -> Column:
    """The first of the candidate names that is among the keys."""
    names = F.array(*(F.lit(name) for name in candidates))
    return F.get(F.filter(names, lambda name: F.array_contains(keys, name)), F.lit(0))
