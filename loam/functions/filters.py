"""Metadata filters as columns: {key: value} or {key: {operator: value}}, all of which must hold.

On a JSON column keys are read with their type; a value of the wrong type does not match and does not fail. With
missing="differs", as in searches, a row without the key matches $ne and $nin; with missing="fails", as in routing rules,
it matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operators of the filter grammar.
OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin")


def validated(spec: Mapping[str, Any]) -> list[tuple[str, str, Any]]:
    """(key, operator, value) of each condition; ValueError for what the grammar does not have."""
    out = []
    for key, want in spec.items():
        if not isinstance(want, Mapping):
            out.append((key, "$eq", want))
            continue
        if len(want) != 1:
            raise ValueError(f"{key}: a condition has exactly one operator")
        ((op, value),) = want.items()
        if op not in OPERATORS:
            raise ValueError(f"{key}: unknown operator {op}")
        if op in ("$in", "$nin") and not isinstance(value, (list, tuple)):
            raise ValueError(f"{key}: {op} takes a list")
        out.append((key, op, value))
    return out


def json_field(column: str) -> Callable[[str, Any], Column]:
    """Reads a key of a JSON column as the type that the wanted value has."""

    def read(key: str, value: Any) -> Column:
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"
        return F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", kind)

    return read


def plain_field(key: str, value: Any) -> Column:
    return F.col(key)


def compiled(spec: Mapping[str, Any], field: Callable[[str, Any], Column] = plain_field, missing: str = "differs", arrays: frozenset[str] = frozenset()) -> Column:
    """The filter as one boolean column, never null. Keys in `arrays` hold lists, which equal what they contain."""
    out = F.lit(True)
    for key, op, value in validated(spec):
        sample = value[0] if isinstance(value, (list, tuple)) and value else value
        col = field(key, sample)
        equal = (lambda v, col=col, key=key: F.array_contains(col, v)) if key in arrays else (lambda v, col=col: col == F.lit(v))
        among = F.lit(False)
        for v in value if isinstance(value, (list, tuple)) else [value]:
            among = among | F.coalesce(equal(v), F.lit(False))
        hit = {"$eq": among, "$in": among, "$ne": ~among, "$nin": ~among}.get(op)
        if hit is None:
            hit = F.coalesce({"$gt": col > value, "$gte": col >= value, "$lt": col < value, "$lte": col <= value}[op], F.lit(False))
        if missing == "fails":
            hit = hit & col.isNotNull()
        out = out & hit
    return out


def routed(rules: list[tuple[Mapping[str, Any], str]], default: str) -> Column:
    """The model of the first rule that fits."""
    out = F.lit(default)
    for spec, model in reversed(rules):
        out = F.when(compiled(spec, missing="fails"), model).otherwise(out)
    return out
