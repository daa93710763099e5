"""Stable identities: fingerprints and occurrence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prefix, kept hex digits, separator.
PREFIX, DIGITS, SEPARATOR = "hs1-", 32, 31


def fingerprint(vuln_class: Column, path: Column, function: Column, sink: Column, occurrence: Column | None = None) -> Column:
    """Prefix and 128 bits of SHA-256 over the parts; a null or empty function is the module, an occurrence over 0 is a part of its own."""
    parts = [F.coalesce(vuln_class, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(F.nullif(function, F.lit("")), F.lit("<module>")), F.coalesce(sink, F.lit(""))]
    if occurrence is not None:  # concat_ws leaves nulls out
        parts.append(F.when(occurrence > 0, F.concat(F.lit("#"), occurrence.cast("string"))))
    return F.concat(F.lit(PREFIX), F.left(F.sha2(F.concat_ws(chr(SEPARATOR), *parts), 256), F.lit(DIGITS)))


def with_ids(df: DataFrame, vuln_class: Column, path: Column, function: Column, sink: Column, order: list[Column]) -> DataFrame:
    """df with `occurrence` (0-based, among equal bases in a total order) and `id`. Equal bases are split over tasks by AQE only as far as the window allows: salt the path if one base may hold very many rows."""
    w = Window.partitionBy("_base").orderBy(*order)
    out = df.withColumn("_base", fingerprint(vuln_class, path, function, sink)).withColumn("occurrence", (F.row_number().over(w) - 1).cast("int"))
    return out.withColumn("id", fingerprint(vuln_class, path, function, sink, F.col("occurrence"))).drop("_base")
