"""Typed reading of metadata strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of integers, decimals and words that make a list
# unreadable as a literal.
INTEGER = r"^-?[0-9]+$"
DECIMAL = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"
LITERAL = r"(^|[\[,\s])(True|False|None)(?=$|[\],\s])"
NOT_LITERAL = r"(^|[\[,\s])(true|false|null)($|[\],\s])"


def listed_value(value: Column) -> Column:
    """Elements of a bracketed list as strings, NULL for anything else."""
    return F.when(
        value.startswith("[") & value.endswith("]") & ~value.rlike(NOT_LITERAL),
        F.coalesce(
            F.from_json(value, "array<string>"),
            F.from_json(F.regexp_replace(value, LITERAL, '$1"$2"'), "array<string>"),
        ),
    )


def value_kind(value: Column, listed: Column) -> Column:
    """First fitting kind of bool, int, float, list and str."""
    return (
        F.when(F.lower(value).isin("true", "false"), "bool")
        .when(value.rlike(INTEGER), "int")
        .when(value.rlike(DECIMAL), "float")
        .when(listed.isNotNull(), "list")
        .otherwise("str")
    )
