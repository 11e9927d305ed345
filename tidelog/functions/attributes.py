"""Attributes: flat JSON objects as text, and the same with every value as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_text(v: Column) -> Column:
    """A string, number or boolean variant as text.

    Numbers print as the shortest plain decimal; as a power of ten (``1e+21``, ``1e-7``) from 1e21 up and below 1e-6. Whole
    numbers written without exponent are exact at any size.
    """
    number = v.cast("double")
    size = F.abs(number)
    digits = F.regexp_replace(number.cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    small = F.regexp_replace(number.cast("decimal(38,30)").cast("string"), r"\.?0+$", "")
    large = number.cast("decimal(38,0)").cast("string")
    power = F.regexp_replace(F.regexp_replace(number.cast("string"), r"\.0E", "E"), r"E(\d)", "E+$1")
    plain = F.when(size == 0, "0").when(size >= 1e21, F.lower(power)).when(size >= 1e15, large).when(size >= 1, digits).when(size >= 1e-6, small).otherwise(F.lower(power))
    return F.when(F.schema_of_variant(v).isin("DOUBLE", "FLOAT"), plain).otherwise(v.cast("string"))


def texts(values: Column) -> Column:
    """A map of variants with every value as text."""
    return F.map_from_entries(F.transform(F.map_entries(values), lambda e: F.struct(e["key"], variant_text(e["value"]))))


def normalized(attributes: Column) -> Column:
    """The map of keys to texts of a JSON object's text; of repeated keys the last counts; null for anything but an object."""
    return texts(F.try_parse_json(attributes).try_cast("map<string,variant>"))
