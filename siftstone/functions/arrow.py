"""Arrow schemas of DDL strings, for functions that hand rows through with their other columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ddl_of(schema: StructType, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *more])


def arrow_schema(ddl: str) -> pa.Schema:
    """Every level nullable, as functions' results are declared."""
    return to_arrow_schema(StructType.fromDDL(ddl))
