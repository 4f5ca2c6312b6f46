"""Attributes as a typed map, and tests of the types of JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_type(value: Column) -> Column:
    """STRING, BOOLEAN, OBJECT, ARRAY, VOID (a JSON null) or the name of a number type; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_number(kind: Column) -> Column:
    return ~kind.isin("STRING", "BOOLEAN", "OBJECT", "ARRAY", "VOID")


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def finite(value: Column) -> Column:
    number = as_double(value)
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))


def allowed(value: Column) -> Column:
    """A value that an attribute may have: text, boolean or finite number."""
    kind = json_type(value)
    return F.coalesce(kind.isin("STRING", "BOOLEAN") | (is_number(kind) & finite(value)), F.lit(False))


def type_attributes(attributes: Column) -> Column:
    """map<string, variant> to the typed map of the log schema; the type decides, as casts are lenient."""

    def typed(_: Column, value: Column) -> Column:
        kind = json_type(value)
        return F.struct(
            F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number").alias("kind"),
            F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).alias("str"),
            F.when(is_number(kind), as_double(value)).alias("num"),
            F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).alias("bool"),
        )

    return F.transform_values(attributes, typed)
