"""Arrow types of results, parsed from DDL without a session (workers have none)."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type
from pyspark.sql.types import DataType, StructType

_SIMPLE = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
_LEXEME = re.compile(r"\s*([a-z_A-Z0-9]+|[<>,:])")


@lru_cache(maxsize=64)
def arrow_type(ddl: str) -> pa.DataType:
    """The type of simple names, array<...> and struct<name:type,...>."""
    lexemes = _LEXEME.findall(ddl)[::-1]

    def one() -> pa.DataType:
        name = lexemes.pop()
        if name not in ("array", "struct"):
            return _SIMPLE[name]
        lexemes.pop()
        if name == "array":
            out = pa.list_(one())
            lexemes.pop()
            return out
        fields = []
        while True:
            field = lexemes.pop()
            lexemes.pop()
            fields.append(pa.field(field, one()))
            if lexemes.pop() == ">":
                return pa.struct(fields)

    return one()


def arrow_schema(ddl: str) -> pa.Schema:
    """The schema of 'name type, ...'."""
    body = re.sub(r"(^|,\s*)([a-z_0-9]+) ", r"\1\2:", ddl)
    return pa.schema(list(arrow_type(f"struct<{body}>")))


def spark_schema(ddl: str) -> StructType:
    return from_arrow_schema(arrow_schema(ddl))


def spark_type(ddl: str) -> DataType:
    return from_arrow_type(arrow_type(ddl))
