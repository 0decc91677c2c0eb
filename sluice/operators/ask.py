"""The fixed questions a published table answers, as typed DataFrame operators."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import GateError
from sluice.functions.cells import ORD, data_columns, parse_number, strip
from sluice.functions.sqltext import quoted, text

METRICS = {
    "avg": ("average", F.avg),
    "sum": ("sum", F.sum),
    "min": ("minimum", F.min),
    "max": ("maximum", F.max),
}
GROUP_LIMIT, SHOW_LIMIT, TOP_LIMIT, PREVIEW_LIMIT = 100, 50, 5, 200

Schema = Sequence[Mapping[str, str]]


def _known(name: str, df: DataFrame) -> str:
    if name not in data_columns(df):
        raise GateError(f"unknown column {name!r}; there are {', '.join(data_columns(df))}")
    return name


def _numeric_types(df: DataFrame, schema: Schema | None) -> dict[str, bool]:
    if schema is None:
        return {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    return {column["name"]: column["inferred_type"] in ("integer", "float") for column in schema}


def where_equals(df: DataFrame, column: str, value: object, schema: Schema | None = None) -> DataFrame:
    """Rows whose cell equals ``value``: as a number where both are, else as caseless text."""
    cell = F.col(quoted(_known(column, df)))
    if _numeric_types(df, schema).get(column):
        if (whole := _as_whole(value)) is not None:
            return df.filter(cell == _literal(whole, df.schema[column].dataType))
        number = _as_number(value, df)
        if number is not None:
            return df.filter(cell == F.lit(number))
    return df.filter(F.lower(cell.cast("string")) == F.lit(str(value).lower()))


def _as_whole(value: object) -> int | None:
    """A whole number as it is written, with all its digits."""
    if isinstance(value, bool):
        return None
    if isinstance(value, int):
        return value
    return int(value) if isinstance(value, str) and re.fullmatch(r" *[-+]?[0-9]+ *", value) else None


def _literal(whole: int, dtype: T.DataType) -> Column:
    """The number in the column's own type where it fits, so that the filter reaches the scan."""
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(dtype))
    if bits and -(1 << bits - 1) <= whole < 1 << bits - 1:
        return F.lit(whole).cast(dtype)
    return F.lit(Decimal(whole)) if abs(whole) < 10**38 else F.lit(float(whole))


def _as_number(value: object, df: DataFrame) -> float | None:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return value
    one = df.sparkSession.range(1).selectExpr(f"{strip(text(str(value)))} AS v").selectExpr(f"{parse_number('v')} AS x")
    return one.first().x


def default_measure(df: DataFrame, schema: Schema) -> str:
    """The only numeric column that is no key."""
    numeric = [
        column["name"]
        for column in schema
        if column["inferred_type"] in ("integer", "float") and column["role"] != "key"
    ]
    if len(numeric) != 1:
        raise GateError(f"say which column to aggregate; there are {', '.join(data_columns(df))}")
    return numeric[0]


def ask(
    df: DataFrame,
    agg: str | None = None,
    measure: str | None = None,
    group: str | None = None,
    where: tuple[str, object] | None = None,
    limit: int | Literal["all"] | None = None,
    schema: Schema | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One answer: ``count``, ``avg``, ``sum``, ``min``, ``max``, ``top`` or ``show``.

    Without ``agg`` a group is counted. Ties in a ranking go to the group, or to
    ``tie_break`` and the row position, so that an answer is the same every time.
    ``limit`` is 100 groups, 5 top rows or 50 shown rows unless told otherwise; "all" sets none.
    """
    if agg is None:
        if group is None:
            raise GateError("say what to compute: count, avg, sum, min, max, top or show")
        agg = "count"
    if where is not None:
        df = where_equals(df, *where, schema=schema)
    if agg == "count":
        return _grouped(df, group, F.count(F.lit(1)), "count", limit)
    if agg in METRICS:
        if measure is None and schema is not None:
            measure = default_measure(df, schema)
        if measure is None:
            raise GateError(f"say which column to aggregate; there are {', '.join(data_columns(df))}")
        word, function = METRICS[agg]
        return _grouped(df, group, function(quoted(_known(measure, df))), f"{word}_{measure}", limit)
    columns = [quoted(name) for name in data_columns(df)]
    position = [F.col(ORD)] if ORD in df.columns else []
    if agg == "top":
        if measure is None:
            raise GateError("say which column to rank")
        order = [F.col(quoted(_known(measure, df))).desc_nulls_last(), *map(quoted, tie_break), *position]
        return df.orderBy(*order).transform(_first, limit, TOP_LIMIT).select(*columns)
    if agg == "show":
        if position and not tie_break and limit != "all":
            df = _front(df, limit or SHOW_LIMIT)
        ordered = df.orderBy(*map(quoted, tie_break), *position) if tie_break or position else df
        return ordered.transform(_first, limit, SHOW_LIMIT).select(*columns)
    raise GateError(f"unknown question {agg!r}")


def _first(df: DataFrame, limit: int | str | None, default: int) -> DataFrame:
    return df if limit == "all" else df.limit(limit or default)


def _front(df: DataFrame, rows: int) -> DataFrame:
    """``df`` up to a position before which it has so many rows, so that a scan of a table in order of position
    skips the files and row groups after it. Each try reaches further by a fixed factor."""
    reach, last = 16 * rows, None
    while df.filter(F.col(ORD) < reach).limit(rows).count() < rows:
        last = df.agg(F.max(ORD)).first()[0] if last is None else last
        if last is None or reach > last:
            return df
        reach *= 256
    return df.filter(F.col(ORD) < reach)


def _grouped(df: DataFrame, group: str | None, metric: Column, name: str, limit: int | str | None) -> DataFrame:
    if group is None:
        return df.agg(metric.alias(name))
    by = quoted(_known(group, df))
    answer = df.groupBy(by).agg(metric.alias(name))
    ordered = answer.orderBy(F.col(quoted(name)).desc_nulls_last(), F.col(by).asc_nulls_last())
    return _first(ordered, limit, GROUP_LIMIT)


def preview(df: DataFrame, limit: int = 20) -> DataFrame:
    """First rows by position; between 1 and 200 of them."""
    return ask(df, "show", limit=max(1, min(int(limit), PREVIEW_LIMIT)))


def short_preview(df: DataFrame, limit: int = 8) -> DataFrame:
    """First rows as text, blanks for nulls."""
    shown = ask(df, "show", limit=limit)
    return shown.select(
        *[F.coalesce(F.col(quoted(n)).cast("string"), F.lit("")).alias(n) for n in shown.columns]
    )
