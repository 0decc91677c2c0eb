"""Reading extracts: CSV, JSON, payload tables, databases, SQL over tables, Parquet."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import GateError
from sluice.functions.cells import data_columns, quoted
from sluice.functions.names import safe_name
from sluice.sources.positions import (
    FILE_PLACE,
    file_place,
    own_position_renamed,
    parquet_with_positions,
    with_file_positions,
    with_positions,
)
from sluice.sources.shape import envelope_key, flatten, unwrap

_MALFORMED = "__malformed"
# A CSV column whose every cell reads like this is numeric from the start.
NATIVE_NUMBER = r"\A ?[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)? ?\z"
NATIVE_INTEGER = r"\A ?[-+]?[0-9]{1,18} ?\z"


@dataclass(frozen=True)
class Source:
    """What to read: ``kind`` and where, or which statement."""

    kind: str
    location: str = ""
    query: str | None = None
    name: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    @property
    def display_name(self) -> str:
        if self.name:
            return safe_name(self.name)
        if self.kind in ("csv", "json", "jsonl", "parquet", "sqlite") and self.location:
            last = self.location.rstrip("/").rpartition("/")[2]
            return safe_name(last.rpartition(".")[0] or last)
        return safe_name(self.kind or "dataset")


def read(spark: SparkSession, source: Source) -> DataFrame:
    """The rows of a source, with positions; the one entry for every kind."""
    kind = source.kind.lower().strip()
    if kind == "csv":
        return read_csv(spark, source.location, **source.options)
    if kind in ("json", "jsonl"):
        return read_json(spark, source.location, lines=kind == "jsonl")
    if kind == "parquet":
        return _found(lambda: parquet_with_positions(spark, source.location), source.location)
    if kind == "api":
        files = _found(lambda: payload_files(spark, source.location), source.location).select("payload", *file_place())
        return with_file_positions(own_position_renamed(payload_records(files, keep=FILE_PLACE)))
    if kind in ("postgres", "postgresql", "sqlite", "jdbc"):
        return with_positions(read_database(spark, source))
    raise GateError(f"unknown source kind {source.kind!r}: csv, json, jsonl, parquet, api, postgres or sqlite")


def _found(load, location: str) -> DataFrame:
    try:
        return load()
    except AnalysisException as error:
        raise GateError(f"cannot read {location}: {error.getCondition()}") from error


def require_rows(df: DataFrame) -> DataFrame:
    if not data_columns(df) or df.isEmpty():
        raise GateError("the source has no rows or no columns")
    return df


# -- CSV ----------------------------------------------------------------------------------


def _header(names: list[str | None]) -> list[str]:
    """Header cells made unique the usual way: ``a``, ``a.1``; an empty one by its place."""
    seen: dict[str, int] = {}
    unique = []
    for place, name in enumerate(names):
        name = (name or "").lstrip("﻿") or f"Unnamed: {place}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        unique.append(f"{name}.{count}" if count else name)
    return unique


def read_csv(spark: SparkSession, path: str, multiline: bool = True, typed: bool = True, **options: str) -> DataFrame:
    """CSV with a header, as text; columns that are wholly numbers or booleans get that type.

    Empty cells are null, short rows are padded and longer rows are refused, and so are
    files of a folder whose headers differ. Rows come in order of file and place. Turn
    ``multiline`` off when no cell holds a line break: only then can one file be split.
    """
    reader = spark.read.options(quote='"', escape='"', multiLine=multiline, encoding="UTF-8", **options)
    first = _found(lambda: reader.option("header", False).csv(path), path).limit(1).collect()
    if not first:
        raise GateError(f"{path} is empty")
    names = _header(list(first[0]))  # one of them may be the name of the row position
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, _MALFORMED]])
    as_written = names == list(first[0])  # else the header cannot be compared with the schema
    rows = (
        reader.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_MALFORMED, enforceSchema=not as_written)
        .schema(schema)
        .csv(path)
    )
    if not as_written and len(rows.inputFiles()) > 1:
        raise GateError(f"{path} has several files, and headers with empty or repeated names")
    try:
        landed = with_file_positions(own_position_renamed(rows))
    except Exception as error:
        if "CSV header does not conform" in str(error):
            raise GateError(f"{path} has files with different headers") from error
        raise
    _refuse_long_rows(landed, len(names), path)
    landed = landed.drop(_MALFORMED)
    return natively_typed(landed) if typed else landed


def _refuse_long_rows(landed: DataFrame, width: int, path: str) -> None:
    wide = ", ".join(f"c{i} STRING" for i in range(width + 1))
    bad = landed.filter(F.col(_MALFORMED).isNotNull())
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    cells = bad.select(F.from_csv(_MALFORMED, wide, options).alias("row"))
    if not cells.filter(F.col(f"row.c{width}").isNotNull()).isEmpty():
        raise GateError(f"{path} has rows with more than {width} cells")


def natively_typed(df: DataFrame) -> DataFrame:
    """Text columns whose every cell is a number (or a boolean) cast to that type."""
    names = [f.name for f in df.schema.fields if f.name in data_columns(df) and isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    long = df.select(*[F.col(quoted(n)).alias(str(i)) for i, n in enumerate(names)]).unpivot(
        [], [str(i) for i in range(len(names))], "column", "text"
    )
    text = F.col("text")

    def every(test):
        return F.bool_and(F.coalesce(test, F.lit(False)))

    found = {
        int(row["column"]): row
        for row in long.groupBy("column")
        .agg(
            every(text.rlike(NATIVE_INTEGER)).alias("whole"),
            every(text.rlike(NATIVE_NUMBER)).alias("number"),
            every(text.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias("truth"),
        )
        .collect()
    }
    casts = {}
    for i, name in enumerate(names):
        row = found.get(i)
        if row is None:
            continue
        to = "bigint" if row.whole else "double" if row.number else "boolean" if row.truth else None
        if to:
            casts[name] = F.trim(quoted(name)).cast(to)
    return df.withColumns(casts) if casts else df


# -- JSON ---------------------------------------------------------------------------------


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of a JSON document (a list or an envelope) or of JSON lines, flattened.

    Columns come in the order of the first record, then any others.
    """
    df = _found(lambda: spark.read.json(path, multiLine=not lines, columnNameOfCorruptRecord=_MALFORMED), path)
    if _MALFORMED in df.columns or not df.columns:
        raise GateError(f"{path} is not JSON with records")
    df = df.select("*", *file_place())
    text = spark.read.text(path, wholetext=not lines).filter("trim(value) <> ''").limit(1)
    first = "value"
    if not lines:
        first = "get_json_object(value, '$[0]')"
        if text.select(F.left(F.ltrim("value"), F.lit(1)).alias("c")).first().c == "{":
            first = f"get_json_object(value, '$.{envelope_key(df.schema)}[0]')"
            df = unwrap(df, *FILE_PLACE)
    keys = text.selectExpr(f"json_object_keys({first}) AS keys").first()["keys"] or []
    ordered = [name for name in keys if name in df.columns]
    ordered += [name for name in df.columns if name not in (*ordered, *FILE_PLACE)]
    # a document is read by one task, so its records keep their order, and files follow in order of their names
    return with_file_positions(own_position_renamed(flatten(df.select(*map(quoted, ordered), *FILE_PLACE))))


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Saved API responses, one whole file per row."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def payload_records(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of raw API responses held in a text column, flattened.

    The common schema of all payloads is found by one aggregate over the table, so
    a field that only one payload has is not lost.
    """
    text = F.col(quoted(payload))
    parsed = df.agg(
        F.schema_of_variant_agg(F.try_parse_json(text)).alias("schema"),
        F.count_if(text.isNotNull() & F.try_parse_json(text).isNull()).alias("broken"),
    ).first()
    if parsed.broken:
        raise GateError(f"{parsed.broken} responses are not JSON")
    schema = parsed.schema.replace("OBJECT<", "STRUCT<")
    kept = [quoted(name) for name in keep]
    if schema.upper().startswith("ARRAY<STRUCT"):
        records = df.select(*kept, F.inline(F.from_json(text, schema)))
        return flatten(records)
    if not schema.upper().startswith("STRUCT<"):
        raise GateError("a response must be a list of objects or an envelope")
    whole = df.select(*kept, F.from_json(text, schema).alias("p"))
    fields = [f.name for f in whole.schema["p"].dataType.fields]
    opened = whole.select(*kept, *[F.col("p").getField(name).alias(name) for name in fields if name not in keep])
    if envelope_key(opened.schema) is None:
        raise GateError("the responses hold no list of records")
    return flatten(unwrap(opened, *keep))


# -- databases and SQL ----------------------------------------------------------------------

_DRIVERS = {"postgres": "org.postgresql.Driver", "postgresql": "org.postgresql.Driver", "sqlite": "org.sqlite.JDBC"}


def jdbc_options(source: Source) -> dict[str, str]:
    """Options of the JDBC read for a SELECT that the database itself runs.

    The statement goes in as a sub-select, so nothing but a SELECT can run. A table
    read in parallel names ``dbtable``, ``partitionColumn``, bounds and ``numPartitions``.
    """
    kind, url = source.kind.lower().strip(), source.location.strip()
    if not url:
        raise GateError("a database URL is required")
    options = dict(source.options)
    if not source.query and "dbtable" not in options:
        raise GateError("a SELECT is required for a database source")
    if not url.startswith("jdbc:"):
        if kind == "sqlite":
            url = f"jdbc:sqlite:{url}"
        else:
            url = "jdbc:postgresql://" + url.partition("://")[2]
    if source.query:
        options["query"] = source.query.strip().rstrip(";")
    if driver := _DRIVERS.get(kind):
        options.setdefault("driver", driver)
    return options | {"url": url}


def read_database(spark: SparkSession, source: Source) -> DataFrame:
    try:
        return spark.read.format("jdbc").options(**jdbc_options(source)).load()
    except GateError:
        raise
    except Exception as error:  # driver class missing, server unreachable, bad statement
        raise GateError(f"cannot read the database: {str(error).splitlines()[0]}") from error


def read_sql(
    spark: SparkSession, tables: Mapping[str, DataFrame], statement: str, args: Mapping[str, object] | None = None
) -> DataFrame:
    """A SELECT over named tables; ``:name`` markers take their values from ``args``."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return spark.sql(statement, args=dict(args or {}))


