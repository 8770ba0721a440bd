"""Type text to registered type kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds a registry knows. Parameterised types are matched by their head.
HEADS = {
    "DECIMAL": "DECIMAL",
    "VARCHAR": "STRING",
    "CHAR": "STRING",
    "ARRAY": "ARRAY",
    "MAP": "MAP",
    "STRUCT": "STRUCT",
}
PLAIN = {
    "INT": "INT",
    "INTEGER": "INT",
    "BIGINT": "LONG",
    "LONG": "LONG",
    "SMALLINT": "SHORT",
    "SHORT": "SHORT",
    "TINYINT": "BYTE",
    "BYTE": "BYTE",
    "FLOAT": "FLOAT",
    "REAL": "FLOAT",
    "DOUBLE": "DOUBLE",
    "STRING": "STRING",
    "BOOLEAN": "BOOLEAN",
    "DATE": "DATE",
    "TIMESTAMP": "TIMESTAMP",
    "TIMESTAMP_NTZ": "TIMESTAMP_NTZ",
    "BINARY": "BINARY",
}


def type_kind(type_text: Column) -> Column:
    """Kind of a SQL type text. A type the registry lacks is `OTHER`, never silently a string."""
    head = F.regexp_extract(F.upper(F.trim(type_text)), r"^([A-Z_]+)", 1)
    parameterised = F.upper(F.trim(type_text)).rlike(r"^[A-Z_]+\s*[(<]")
    kinds = F.create_map(*[F.lit(x) for pair in {**PLAIN, **HEADS}.items() for x in pair])
    known = F.try_element_at(kinds, head)
    takes_parameters = head.isin(*HEADS)
    return (
        F.when(type_text.isNull(), F.lit(None).cast("string"))
        .when(parameterised & ~takes_parameters, F.lit("OTHER"))
        .when(~parameterised & (F.upper(F.trim(type_text)) != head), F.lit("OTHER"))
        .otherwise(F.coalesce(known, F.lit("OTHER")))
    )
