"""JSON values by their own types, and a canonical text of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = "end of the text"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often and in whatever branches it is named: a lambda's argument."""
    return F.get(F.transform(F.array(value), then), 0)


def json_value(text: Column) -> Column:
    """The text as a VARIANT; null where it is no JSON (or names a key twice, or goes on after its value).

    Spark's parser stops after the first value; a second one behind a comma shows whether the text ended there.
    """
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    return once(both, lambda b: F.when(F.try_variant_get(b, "$[1]", "string") == _END, F.try_variant_get(b, "$[0]", "variant")))


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind_at(value: Column, path: str) -> Column:
    """STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID (a JSON null), ARRAY<..>, OBJECT<..>; null where nothing is."""
    return F.schema_of_variant(at(value, path))


def text_at(value: Column, path: str) -> Column:
    """A string that is one in the JSON; numbers and objects are none."""
    return F.when(kind_at(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def filled_at(value: Column, *paths: str) -> Column:
    """The first string that isn't blank."""
    found = [text_at(value, p) for p in paths]
    return F.coalesce(*(F.when(t.rlike(r"\S"), t) for t in found))


def integer_at(value: Column, *paths: str) -> Column:
    """The first whole number: integral floats count, booleans, strings and fractions don't."""

    def one(path: str) -> Column:
        kind, number = kind_at(value, path), F.try_variant_get(value, path, "double")
        whole = (kind == "BIGINT") | ((kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (F.floor(number) == number))
        return F.when(whole, F.try_variant_get(value, path, "bigint"))

    return F.coalesce(*map(one, paths))


def items_at(value: Column, path: str) -> Column:
    """An array's elements, else null (a cast to an array succeeds for arrays alone)."""
    return F.try_variant_get(value, path, "array<variant>")


def is_object(value: Column) -> Column:
    """Whether it is an object, told by a cast: the type of all that is in it, as kind_at() gives it, takes a walk through the value."""
    return F.try_variant_get(value, "$", "struct<`_`: variant>").isNotNull()


def canonical(text: Column) -> Column:
    """Compact JSON with sorted keys and numbers in their shortest form (1.0 as 1), for digests; null where it is no JSON."""
    return F.to_json(json_value(text))
