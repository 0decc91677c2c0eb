"""The rules for one cell, as SQL expressions over a whole column.

Functions such as ``strip`` take the SQL text of an operand (mostly a column name)
and return SQL text. ``Cell`` binds them to one column of a DataFrame and picks the
right form for its Spark type; ``with_facts`` adds the derived columns, in stages, so
that each is computed once per row however many detectors read it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import fixed
from sluice.functions.dates import dated, day_of, iso, plausible
from sluice.functions.names import is_date_name
from sluice.functions.sqltext import mapping, pattern, quoted, text, texts
from sluice.rules import DEFAULT_RULES, Rules

ORD = "_ord"  # 0-based row position, where a table has one

_SPACE = "".join(f"\\u{ord(ch):04x}" for ch in fixed.WHITESPACE)
CURRENCY_AND_SPACE = fixed.CURRENCY + "," + fixed.WHITESPACE
# One optional currency sign, digits with optional sign and fraction; commas anywhere.
NUMBER = rf"\A[{fixed.CURRENCY}]?[{_SPACE}]*,*[-+]?,*[0-9][0-9,]*(?:\.,*[0-9][0-9,]*)?\z"
_NUMBER_STARTS = "0123456789+-," + fixed.CURRENCY
EMAIL = rf"\A[^@{_SPACE}]+@[^@{_SPACE}]+\.[^@{_SPACE}]+\z"
# Numbers that are already written the way they print.
PLAIN_NUMBER = r"\A(?!-0\z)-?(?:0|[1-9][0-9]*)(?:\.0|\.[0-9]*[1-9])?\z"


def strip(x: str) -> str:
    return f"btrim({x}, {text(fixed.WHITESPACE)})"


def fold(x: str) -> str:
    """Caseless form of stripped text."""
    return f"replace(lower({x}), 'ß', 'ss')"


def one_of(x: str, words: Iterable[str]) -> str:
    """Caseless membership; long texts are ruled out by their size alone."""
    words = list(words)
    if not words:
        return "false"
    longest = max(len(word.encode()) for word in words) + 2
    return f"coalesce(octet_length({x}) <= {longest} AND {fold(x)} IN ({texts(words)}), false)"


def read_number(x: str) -> str:
    """DOUBLE of stripped text such as ``$1,240.00``, infinite for a far too long one."""
    fits = f"left({x}, 1) IN ({texts(_NUMBER_STARTS)}) AND {x} RLIKE {pattern(NUMBER)}"
    return f"CASE WHEN {fits} THEN try_cast(translate({x}, {text(CURRENCY_AND_SPACE)}, '') AS DOUBLE) END"


def finite(x: str) -> str:
    return f"CASE WHEN abs({x}) < double('Infinity') THEN {x} END"


def parse_number(x: str) -> str:
    """DOUBLE of stripped text; NULL when it is not a finite number."""
    return finite(read_number(x))


def parse_bool(x: str, rules: Rules = DEFAULT_RULES) -> str:
    return f"CASE WHEN {one_of(x, rules.true_words)} THEN true WHEN {one_of(x, rules.false_words)} THEN false END"


def parse_day(x: str) -> str:
    """DATE of a stripped text cell, NULL where it is not a date."""
    return plausible(day_of(dated(x)))


def looks_like_email(x: str) -> str:
    return f"coalesce(contains({x}, '@') AND {x} RLIKE {pattern(EMAIL)}, false)"


def country_of(x: str, rules: Rules = DEFAULT_RULES) -> str:
    """Canonical country of a stripped alias, NULL when unknown."""
    aliases = dict(rules.country_aliases)
    if not aliases:
        return "CAST(NULL AS STRING)"
    longest = max(len(alias.encode()) for alias in aliases) + 2
    return f"CASE WHEN octet_length({x}) <= {longest} THEN try_element_at({mapping(aliases)}, {fold(x)}) END"


def data_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name != ORD]


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "nested" if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else "other"


class Cell:
    """One column and the rules that hold for it."""

    def __init__(self, name: str, dtype: T.DataType, index: int, rules: Rules = DEFAULT_RULES):
        self.name, self.dtype, self.index, self.rules = name, dtype, index, rules
        self.kind = _kind(dtype)
        self.is_text = self.kind in ("text", "nested", "other")
        # Whole numbers in a date-named column are read as compact dates.
        self.dates_from_number = self.kind == "number" and is_date_name(name)

    @property
    def raw(self) -> Column:
        return F.col(quoted(self.name))

    @property
    def text_sql(self) -> str:
        """The cell as text: as it is, or its canonical JSON or cast."""
        name = quoted(self.name)
        if self.kind == "text":
            return name
        return f"to_json({name})" if self.kind == "nested" else f"CAST({name} AS STRING)"

    @property
    def text(self) -> Column:
        return F.expr(self.text_sql)

    def ref(self, what: str) -> str:
        """Name of a derived column, available after with_facts."""
        return f"__{what}_{self.index}"

    # -- what is known of a cell, as SQL ----------------------------------------------
    @property
    def present_sql(self) -> str:
        blank = f"NOT {self.ref('blank')}"
        return f"({blank} AND NOT {self.ref('sentinel')})" if self.is_text else f"({blank})"

    @property
    def number_sql(self) -> str:
        return self.ref("number") if self.is_text or self.kind == "number" else "CAST(NULL AS DOUBLE)"

    @property
    def truth_sql(self) -> str:
        if self.kind == "bool":
            return quoted(self.name)
        return self.ref("truth") if self.is_text else "CAST(NULL AS BOOLEAN)"

    @property
    def day_sql(self) -> str:
        if self.kind == "time":
            return f"CAST({quoted(self.name)} AS DATE)"
        return self.ref("day") if self.is_text or self.dates_from_number else "CAST(NULL AS DATE)"

    def flag_sql(self, what: str) -> str:
        """A test that is never null: blank, sentinel, decorated, not_number, negative, ..."""
        return f"({self._flags()[what]})"

    def _flags(self) -> dict[str, str]:
        present, number, day = self.present_sql, self.number_sql, self.day_sql
        flags = {
            "blank": self.ref("blank"),
            "sentinel": self.ref("sentinel") if self.is_text else "false",
            "present": present,
            "decorated": "false",
            "not_number": f"{present} AND {number} IS NULL",
            "negative": f"coalesce({number} < 0, false)",
            "not_email": f"{present} AND NOT {self.ref('email') if self.is_text else 'false'}",
            "not_day": f"{present} AND {day} IS NULL",
            "not_iso": f"{present} AND coalesce({self.ref('bare')} != {iso(day)}, false)",
            "padded": "false",
        }
        if self.is_text:
            sign = pattern(f"[{fixed.CURRENCY},]")
            flags["decorated"] = f"{number} IS NOT NULL AND {self.text_sql} RLIKE {sign}"
            flags["padded"] = f"NOT {self.ref('blank')} AND {self.text_sql} != {self.ref('bare')}"
        if self.kind == "time":
            whole = isinstance(self.dtype, T.DateType) or not self.rules.truncate_time
            flags["not_iso"] = "false" if whole else present
        return flags

    # -- the same as Columns ----------------------------------------------------------
    def flag(self, what: str) -> Column:
        return F.expr(self.flag_sql(what))

    @property
    def bare(self) -> Column:
        return F.col(self.ref("bare"))

    @property
    def blank(self) -> Column:
        return F.col(self.ref("blank"))

    @property
    def sentinel(self) -> Column:
        return self.flag("sentinel")

    @property
    def present(self) -> Column:
        return F.expr(self.present_sql)

    @property
    def number(self) -> Column:
        return F.expr(self.number_sql)

    @property
    def truth(self) -> Column:
        return F.expr(self.truth_sql)

    @property
    def day(self) -> Column:
        return F.expr(self.day_sql)

    # -- how the derived columns are made -------------------------------------------
    # One select per stage: what later stages read twice is computed once.
    def _stages(self) -> tuple[dict[str, str], ...]:
        if self.is_text:
            return self._text_stages()
        name = quoted(self.name)
        floating = isinstance(self.dtype, (T.FloatType, T.DoubleType))
        blank = f"{name} IS NULL OR isnan({name})" if floating else f"{name} IS NULL"
        first = {"blank": blank, "bare": f"CAST({name} AS STRING)"}
        if self.kind != "number":
            return (first,)
        second = {"value": f"CASE WHEN {self.present_sql} THEN CAST({name} AS DOUBLE) END"}
        third = {"number": finite(self.ref("value"))}
        if not self.dates_from_number:
            return first, second, third
        second["shaped"] = f"CASE WHEN {self.present_sql} THEN {dated(self.ref('bare'))} END"
        third["date"] = day_of(self.ref("shaped"))
        return first, second, third, {"day": plausible(self.ref("date"))}

    def _sentinel_word(self) -> str:
        return one_of(self.ref("bare"), self.rules.sentinels_for(self.name))

    def _text_stages(self) -> tuple[dict[str, str], ...]:
        bare = self.ref("bare")

        def if_present(sql: str) -> str:
            return f"CASE WHEN {self.present_sql} THEN {sql} END"

        return (
            {"bare": strip(self.text_sql)},
            {"blank": f"coalesce({bare} = '', true)", "sentinel": self._sentinel_word()},
            {
                "value": if_present(read_number(bare)),
                "truth": if_present(parse_bool(bare, self.rules)),
                "email": f"{self.present_sql} AND {looks_like_email(bare)}",
                "shaped": if_present(dated(bare)),
            },
            {"number": finite(self.ref("value")), "date": day_of(self.ref("shaped"))},
            {"day": plausible(self.ref("date"))},
        )


def cells_of(df: DataFrame, names: Sequence[str] | None = None, rules: Rules = DEFAULT_RULES) -> list[Cell]:
    wanted = data_columns(df) if names is None else list(names)
    return [Cell(name, df.schema[name].dataType, index, rules) for index, name in enumerate(wanted)]


def with_facts(df: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """``df`` plus the derived columns of ``cells``; unused ones are pruned away."""
    stages = [(index, cell._stages()) for index, cell in {cell.index: cell for cell in cells}.items()]
    for depth in range(max((len(made) for _, made in stages), default=0)):
        columns = [
            f"{sql} AS __{what}_{index}"
            for index, made in stages
            if depth < len(made)
            for what, sql in made[depth].items()
        ]
        if columns:
            df = df.selectExpr("*", *columns)
    return df


def without_facts(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(name) for name in df.columns if not re.fullmatch(r"__[a-z]+_\d+", name)])


def long_texts(df: DataFrame, cells: Sequence[Cell], keep: Sequence[Column] = ()) -> DataFrame:
    """``(column, text)``: the text of many columns below each other, ``column`` the cell's index.

    Rules then run as one small piece of code, however many columns there are.
    """
    texts = [F.expr(f"{cell.text_sql} AS `{cell.index}`") for cell in cells]
    wide = df.select(*keep, *texts)
    kept = wide.columns[: len(keep)]
    return wide.unpivot(kept, [str(cell.index) for cell in cells], "column", "text").withColumn(
        "column", F.col("column").cast("int")
    )


def long_cell(cells: Sequence[Cell]) -> Cell:
    """The cell of ``long_texts``' text column, under the rules of the columns it holds."""
    return _LongCell(cells)


class _LongCell(Cell):
    def __init__(self, cells: Sequence[Cell]):
        super().__init__("text", T.StringType(), 0, cells[0].rules if cells else DEFAULT_RULES)
        self.members = cells

    def _sentinel_word(self) -> str:
        test = one_of(self.ref("bare"), self.rules.sentinels)
        for cell in self.members:
            if cell.name in self.rules.column_sentinels:
                own = one_of(self.ref("bare"), self.rules.sentinels_for(cell.name))
                test = f"CASE WHEN column = {cell.index} THEN {own} ELSE {test} END"
        return test
