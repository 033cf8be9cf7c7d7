"""Rows from JSON replies of a recogniser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("survey", "meter", "remarks")


def strip_fence(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "(?s)^\\s*```[a-zA-Z]*\\s*|\\s*```\\s*$", ""))


def parse_reply(x: Column) -> Column:
    """The reply as a variant: whole, or else its outermost braces; null if neither is JSON."""
    text = strip_fence(x)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, "(?s)\\{.*\\}", 0)))


def reply_rows(df: DataFrame, reply: str) -> DataFrame:
    """df with row_index, survey, meter, remarks for each object of the reply's list; what is no object is passed over.

    The list is the reply itself or its `rows`. Missing and null fields are empty, values are trimmed.
    """
    parsed = df.withColumn("_v", parse_reply(F.col(reply)))
    rows = F.coalesce(F.try_variant_get("_v", "$.rows", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>"))
    objects = F.filter(rows, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    exploded = parsed.withColumn("_rows", objects).select(*df.columns, F.posexplode("_rows").alias("row_index", "_row"))
    fields = [F.coalesce(F.trim(F.try_variant_get("_row", f"$.{f}", "string")), F.lit("")).alias(f) for f in FIELDS]
    return exploded.select(*df.columns, "row_index", *fields)
