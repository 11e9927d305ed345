"""Positions in a page as text tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.times import micros_text


def page_token(timestamp: Column, id_: Column) -> Column:
    """base64url, without padding, of ``{"v":1,"t":<instant>,"i":"<id>"}``: where a next page starts after."""
    position = F.to_json(F.struct(F.lit(1).alias("v"), micros_text(timestamp).alias("t"), id_.cast("string").alias("i")))
    return F.rtrim(F.translate(F.base64(F.encode(position, "UTF-8")), "+/", "-_"), F.lit("="))
