"""Bringing records into table shape: envelopes, nested objects, safe headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import GateError
from sluice.functions import fixed
from sluice.functions.cells import ORD, data_columns, long_texts, cells_of, quoted
from sluice.functions.names import safe_names
from sluice.operators.rows import first_rows


def _is_record_list(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType)


def envelope_key(schema: T.StructType) -> str | None:
    """Name of the list of records in an envelope, the first known one that is a list."""
    for key in fixed.ENVELOPE_KEYS:
        field = next((f for f in schema.fields if f.name == key), None)
        if field is not None and isinstance(field.dataType, T.ArrayType):
            if not _is_record_list(field.dataType):
                raise GateError(f"the list {key!r} must hold objects")
            return key
    return None


def unwrap(df: DataFrame, *keep: str) -> DataFrame:
    """Records of an envelope, one row each; ``keep`` columns are repeated beside them."""
    key = envelope_key(df.schema)
    if key is None:
        raise GateError(f"no list of records under any of {', '.join(fixed.ENVELOPE_KEYS)}")
    kept = [quoted(name) for name in keep]
    return df.select(*kept, F.inline(quoted(key)))


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as ``outer.inner`` columns, at any depth; lists stay as they are."""

    def leaves(column: Column, name: str, dtype: T.DataType) -> list[Column]:
        if not isinstance(dtype, T.StructType):
            return [column.alias(name)]
        return [
            leaf
            for field in dtype.fields
            for leaf in leaves(column.getField(field.name), f"{name}.{field.name}", field.dataType)
        ]

    columns = [leaf for f in df.schema.fields for leaf in leaves(F.col(quoted(f.name)), f.name, f.dataType)]
    return df.select(*columns)


def renamed(df: DataFrame) -> DataFrame:
    """Safe unique column names, metadata only; the row position keeps its name."""
    names = data_columns(df)
    to = dict(zip(names, safe_names(names)))
    return df.toDF(*[to.get(name, name) for name in df.columns])


SCHEMA_REPORT = "name string, original_name string, source_type string, examples array<string>, renamed boolean"


def schema_report(df: DataFrame, rows: int | None = None, examples: bool = True) -> list[dict]:
    """Per column: its safe and original name, type and first three non-null values by position."""
    names = data_columns(df)
    shown: dict[int, list[str]] = {}
    if examples and ORD in df.columns:
        rows = df.count() if rows is None else rows
        long = long_texts(df, cells_of(df), [F.col(ORD)]).filter("text IS NOT NULL")
        marked = long.select(F.col("column").alias("label"), ORD, F.left("text", F.lit(80)).alias("value"))
        for row in sorted(first_rows(marked, 3, rows).collect(), key=lambda r: (r.label, r.place)):
            shown.setdefault(row.label, []).append(row.value)
    return [
        {
            "name": safe,
            "original_name": name,
            "source_type": df.schema[name].dataType.simpleString(),
            "examples": shown.get(i, []),
            "renamed": safe != name,
        }
        for i, (safe, name) in enumerate(zip(safe_names(names), names))
    ]
