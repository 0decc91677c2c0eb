"""One table under inspection: every measurement the profile and detectors need.

Measurements run when first asked for, and only a few numbers per column come back:

* ``measure``   what is counted of cells and rows, in one job: text rules over grouped values,
                numbers of native columns, spellings, copies and key conflicts (16 bytes a row shuffled)
* ``quartiles`` exact quartiles of numeric columns
* ``spread``    outliers and histogram buckets, one wide aggregate
* ``distinct``  distinct numbers of native columns
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import ExitStack
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sluice.functions.cells import ORD, Cell, cells_of, long_cell, long_texts, parse_bool, with_facts
from sluice.functions.names import is_country_name, is_key_name, role_of
from sluice.functions.sqltext import double, quoted
from sluice.operators import rows, spellings
from sluice.operators.quantiles import Numbers, approximate_quantiles, exact_quantiles
from sluice.rules import DEFAULT_RULES, Rules
from sluice.workspace import scanned, short_methods, written


@dataclass
class Counts:
    """Measurements of one column; ``rows`` is the size of the table."""

    rows: int = 0
    blank: int = 0
    sentinel: int = 0
    numbers: int = 0
    fractional: int = 0
    inexact: int = 0
    negative: int = 0
    truths: int = 0
    emails: int = 0
    days: int = 0
    decorated: int = 0
    padded: int = 0
    not_iso: int = 0
    longest: int = 0
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    deviation: float | None = None

    @property
    def present(self) -> int:
        return self.rows - self.blank - self.sentinel


@dataclass
class Spread:
    """Outliers and histogram of one numeric column."""

    outliers: int = 0
    unit_scale: bool = False
    low: float | None = None
    high: float | None = None
    edges: list[float] = field(default_factory=list)
    buckets: list[int] = field(default_factory=list)


#: How the rows of ``Inspection._parts`` are put together, whatever they are of.
_TOGETHER = {
    "n": F.sum, "blank": F.sum, "sentinel": F.sum, "decorated": F.sum, "padded": F.sum, "not_iso": F.sum,
    "truths": F.sum, "emails": F.sum, "days": F.sum, "numbers": F.sum, "negative": F.sum, "fractional": F.sum,
    "inexact": F.sum, "low": F.min, "high": F.max, "total": F.sum, "longest": F.max, "deviation": F.stddev_samp,
    "tokens": F.sum, "rewrite": F.sum, "variants": F.sum, "aliases": F.sum, "forms": F.sum,
    "extra": F.sum, "present": F.max,
}
_OF_TWO = {F.sum: lambda a, b: a + b, F.min: min, F.max: max}
_COUNTED = (
    "blank", "sentinel", "decorated", "padded", "not_iso", "truths", "emails", "days", "numbers", "negative",
    "fractional", "inexact", "longest", "low", "high",
)


def _add(found: dict[int, dict], row: Row) -> None:
    """Put a counted row to what is there of its column; ``countries`` lists the countries and their spellings."""
    values = row.asDict()
    canonical, forms = values.pop("canonical", None), values.pop("forms", None)
    values["countries"] = [] if canonical is None else [(canonical, forms)]
    if before := found.get(row["column"]):
        values["countries"] += before["countries"]
        for what, together in _TOGETHER.items():
            a, b = before.get(what), values.get(what)
            if what in values and a is not None:
                values[what] = a if b is None else _OF_TWO[together](a, b)
    found[row["column"]] = values


class Inspection:
    """Measurements, inferred types and roles of one DataFrame."""

    def __init__(self, df: DataFrame, rules: Rules = DEFAULT_RULES, extent: int | None = None, spread: bool = True):
        """``extent``: how far positions reach, where rows were dropped since they were given.
        ``spread=False``: the table lies in enough parts already."""
        self.rules = rules
        self._extent = extent
        self.cells = cells_of(df, rules=rules)
        self.ordered = ORD in df.columns
        self._kept: list[DataFrame] = []
        self._compiled = ExitStack()
        self._done: set[str] = set()
        self._found: dict[str, dict[int, dict]] = {}
        self.df = self._spread(df, spread)

    def _spread(self, df: DataFrame, spread: bool) -> DataFrame:
        """A small table, often one split, is spread over the cores and cached; others are scanned, and written
        first if more than a scan makes them."""
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        self._small = int(str(size)) <= self.rules.small_table_bytes
        if not self.cells:
            return df
        if not self._small:
            return df if scanned(df) else written(df, "inspected")
        if not spread:
            return self.keep(df)
        cores = df.sparkSession.sparkContext.defaultParallelism
        by = [quoted(ORD)] if self.ordered else [quoted(c.name) for c in self.cells if c.kind != "nested"]
        return self.keep(df.repartition(cores, *by))

    def cell(self, name: str) -> Cell:
        return next(cell for cell in self.cells if cell.name == name)

    def facts(self, cells: Sequence[Cell]) -> DataFrame:
        """The table with the derived columns of some of its cells."""
        return with_facts(self.df, cells)

    def keep(self, df: DataFrame) -> DataFrame:
        """What several measurements read: cached if the table is small, else written to the shared folder."""
        if not self._small:
            return written(df, "measured")
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._kept[-1]

    def close(self) -> None:
        self._compiled.close()
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    def __enter__(self) -> Inspection:
        self._compiled.enter_context(short_methods(self.df.sparkSession))
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- one aggregate over everything that is counted ------------------------------------
    def measure(self, cells: bool = True, rows_too: bool = True) -> None:
        """Rules, distinct values and spellings of every column (``cells``), copies and key conflicts
        (``rows_too``): one job with one last aggregate, tagged by what a row belongs to."""
        cells, rows_too = cells and "cells" not in self._done, rows_too and "rows" not in self._done
        parts = (self._cell_parts() if cells else []) + (self._row_parts() if rows_too else [])
        self._found |= {name: {} for name, _ in parts}
        if parts:
            whole = None
            for name, frame in parts:
                frame = frame.withColumn("part", F.lit(name))
                whole = frame if whole is None else whole.unionByName(frame, allowMissingColumns=True)
            made = [together(what).alias(what) for what, together in _TOGETHER.items() if what in whole.columns]
            by = ["part", "column"] + [what for what in ("canonical",) if what in whole.columns]
            for row in whole.groupBy(*by).agg(*made).collect():  # a row more for each country that a column names
                _add(self._found[row["part"]], row)
        self._done |= ({"cells"} if cells else set()) | ({"rows"} if rows_too else set())

    def _cell_parts(self) -> list[tuple[str, DataFrame]]:
        natives = [cell for cell in self.cells if not cell.is_text]
        found = [("words", spellings.measured_tokens(self._measured, self.worded, self.rules))] if self.worded else []
        return [*found, ("natives", self._native_rows(natives))] if natives else found

    def _native_rows(self, cells: list[Cell]) -> DataFrame:
        """One row for each cell of the columns that are no text, of one small set of columns."""
        structs = []
        for cell in cells:
            x = cell.number_sql
            structs.append(f"struct({cell.index} AS column, CAST(__blank_{cell.index} AS BIGINT) AS blank, {x} AS x)")
        long = self.facts(cells).selectExpr(f"explode(array({', '.join(structs)})) AS v").select("v.*")
        tests = {"numbers": "x IS NOT NULL", "negative": "x < 0", "fractional": "abs(x - rint(x)) >= 1e-9D", "inexact": "x != rint(x)"}
        counted = [f"if({test}, 1L, 0L) AS {what}" for what, test in tests.items()]
        return long.selectExpr("column", "1L AS n", "blank", *counted, "x AS low", "x AS high", "x AS total", "x AS deviation")

    def _row_parts(self) -> list[tuple[str, DataFrame]]:
        copies = self.groups.filter("n > 1").selectExpr("-1 AS column", "n", "n - 1 AS extra")
        found = [("copies", copies)] if self.cells else []
        for key in self.keys:
            tokens = rows.conflict_tokens(rows.repeated_keys(self.groups, key))
            counted = tokens.selectExpr(f"{key.index} AS column", "if(variants > 1, rows, 0L) AS n", "if(variants > 1, 1L, 0L) AS tokens", "present")
            found.append((f"key {key.index}", counted))
        return found

    @cached_property
    def _measured(self) -> DataFrame:
        """Every spelling of the columns that are counted as text; short values are grouped before rules run."""
        short = spellings.text_values(self.df, self.worded).filter("NOT long").select("column", "text", "n")
        long = spellings.only_long(self.df, self.worded)
        texts = short.unionByName(long.withColumn("n", F.lit(1).cast("bigint")))
        return self.keep(spellings.measured_spellings(texts, self.worded))

    @cached_property
    def counts(self) -> dict[str, Counts]:
        self.measure(rows_too=False)
        words, natives = self._found.get("words", {}), self._found.get("natives", {})
        found = {}
        for cell in self.cells:
            row = words.get(cell.index) if cell.is_text else natives.get(cell.index)
            if row is None:
                found[cell.name] = Counts()
                continue
            counts = Counts(rows=row["n"], **{what: row[what] for what in _COUNTED if row.get(what) is not None})
            if counts.numbers:
                counts.mean = row["total"] / counts.numbers
            if not cell.is_text:
                counts.deviation = row["deviation"]
                self._count_native(cell, counts, words.get(cell.index))
            found[cell.name] = counts
        return found

    def _count_native(self, cell: Cell, counts: Counts, as_words: dict | None) -> None:
        if cell.kind == "bool":
            counts.truths = counts.present
        elif cell.kind == "time":
            counts.days = counts.present
            clock = self.rules.truncate_time and cell.dtype.typeName() != "date"
            counts.not_iso = counts.present if clock else 0
        elif cell.dates_from_number and as_words:
            counts.days, counts.not_iso = as_words["days"], as_words["not_iso"]

    def deviation(self, cell: Cell) -> float:
        """Sample standard deviation; of a text column about its mean, over distinct spellings."""
        return self._text_deviations[cell.name] if cell.is_text else self.counts[cell.name].deviation or 0.0

    @cached_property
    def _text_deviations(self) -> dict[str, float]:
        """Of all text columns that are numeric, in one job."""
        cells = [cell for cell in self.numeric if cell.is_text]
        means = ", ".join(f"{cell.index}, {double(self.counts[cell.name].mean)}" for cell in cells if self.counts[cell.name].numbers)
        found = {}
        if means:
            off = f"(x - try_element_at(map({means}), column))"
            rows_ = self._measured.filter("x IS NOT NULL").groupBy("column").agg(F.expr(f"sum({off} * {off} * n) AS squares")).collect()
            found = {row["column"]: row["squares"] for row in rows_}
        numbers = {cell.name: self.counts[cell.name].numbers for cell in cells}
        return {c.name: math.sqrt(found.get(c.index) or 0.0) / math.sqrt(max(numbers[c.name] - 1, 1)) for c in cells}

    @cached_property
    def rows(self) -> int:
        return next(iter(self.counts.values())).rows if self.cells else self.df.count()

    @property
    def extent(self) -> int:
        return self.rows if self._extent is None else self._extent

    # -- value counts -----------------------------------------------------------------
    @cached_property
    def worded(self) -> list[Cell]:
        """Columns whose values are counted as text."""
        return [cell for cell in self.cells if cell.kind != "number" or cell.dates_from_number]

    @cached_property
    def tokens(self) -> DataFrame:
        """``(column, folded, spelling, digest, n)`` of the present cells, by spelling."""
        return self._measured.filter("folded IS NOT NULL").select("column", "folded", "spelling", "digest", "n")

    def sentinel_words(self, cells: Sequence[Cell]) -> dict[int, list[str]]:
        """The words for no value that stand in some columns; case variants of a dozen short words."""
        wanted = F.col("column").isin([cell.index for cell in cells]) & (F.col("sentinel") > 0)
        found: dict[int, list[str]] = {}
        for row in self._measured.filter(wanted).select("column", "spelling").distinct().collect():
            found.setdefault(row["column"], []).append(row.spelling)
        return {column: sorted(words) for column, words in found.items()}

    @cached_property
    def distinct(self) -> dict[str, int]:
        """Distinct caseless values among the present cells of each column."""
        if self.rules.approximate:
            row = self.facts(self.cells).agg(
                *[F.approx_count_distinct(F.when(c.present, c.bare)).alias(str(c.index)) for c in self.cells]
            ).first()
            return {cell.name: row[str(cell.index)] for cell in self.cells}
        found = {**self.distinct_words, **self.distinct_numbers}
        return {cell.name: found[cell.name] for cell in self.cells}

    @cached_property
    def distinct_words(self) -> dict[str, int]:
        if not self.worded:
            return {}
        if self.rules.approximate:
            return {cell.name: self.distinct[cell.name] for cell in self.worded}
        self.measure(rows_too=False)
        found = self._found.get("words", {})
        return {cell.name: found[cell.index]["tokens"] if cell.index in found else 0 for cell in self.worded}

    @cached_property
    def distinct_numbers(self) -> dict[str, int]:
        cells = [cell for cell in self.cells if cell.kind == "number"]
        if not cells:
            return {}
        if self.rules.approximate:
            return {cell.name: self.distinct[cell.name] for cell in cells}
        structs = []
        for cell in cells:
            whole = cell.dtype.typeName() in ("byte", "short", "integer", "long")
            exact = cell.dtype.typeName() == "decimal"
            value = f"CASE WHEN NOT __blank_{cell.index} THEN {quoted(cell.name)} END"
            long, decimal = value if whole else "NULL", value if exact else "NULL"
            other = "NULL" if whole or exact else value
            fields = f"CAST({long} AS BIGINT) AS l, CAST({other} AS DOUBLE) AS d, CAST({decimal} AS STRING) AS e"
            structs.append(f"struct({cell.index} AS column, {fields})")
        rows_ = (
            self.facts(cells)
            .selectExpr(f"explode(array({', '.join(structs)})) AS v")
            .selectExpr("v.*")
            .filter("l IS NOT NULL OR d IS NOT NULL OR e IS NOT NULL")
            .distinct()
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        found = {row["column"]: row["n"] for row in rows_}
        return {cell.name: found.get(cell.index, 0) for cell in cells}

    # -- types and roles --------------------------------------------------------------
    @cached_property
    def types(self) -> dict[str, str]:
        return {cell.name: self._infer(cell) for cell in self.cells}

    def _infer(self, cell: Cell) -> str:
        counts = self.counts[cell.name]
        present = counts.present
        if not present:
            return "unknown"
        if cell.kind == "time":
            return "datetime"
        if cell.kind == "number":
            return "float" if counts.fractional else "integer"
        if counts.numbers >= self.rules.number_share * present:
            return "float" if counts.fractional else "integer"
        if counts.truths >= self.rules.truth_share * present:
            return "boolean"
        needed = self.rules.named_email_share if "email" in cell.name.lower() else self.rules.email_share
        if counts.emails >= needed * present:
            return "email"
        if counts.days >= self.rules.day_share * present:
            return "datetime"
        return "categorical" if self.few_tokens(cell) else "string"

    def few_tokens(self, cell: Cell) -> bool:
        """Few distinct values, each repeated: the values are categories."""
        present = self.counts[cell.name].present
        if not present:
            return False
        distinct = self.distinct_words[cell.name]
        return distinct <= self.rules.max_categories and distinct <= 0.5 * present

    @cached_property
    def roles(self) -> dict[str, str]:
        return {name: role_of(name, inferred) for name, inferred in self.types.items()}

    def is_numeric(self, cell: Cell) -> bool:
        return self.types[cell.name] in ("integer", "float")

    @cached_property
    def numeric(self) -> list[Cell]:
        return [cell for cell in self.cells if self.is_numeric(cell)]

    @property
    def schema(self) -> list[dict[str, str]]:
        return [{"name": n, "inferred_type": t, "role": self.roles[n]} for n, t in self.types.items()]

    # -- numbers ----------------------------------------------------------------------
    @cached_property
    def quartiles(self) -> dict[str, list[float]]:
        """First quartile, median and third quartile of each numeric column."""
        numbers, exact = {}, not self.rules.approximate
        for cell in self.numeric:
            counts = self.counts[cell.name]
            value = cell.index if cell.is_text and exact else cell.number
            numbers[cell.name] = Numbers(value, counts.numbers, counts.low, counts.high)
        shares = (0.25, 0.5, 0.75)
        if not exact:
            return approximate_quantiles(self.facts(self.numeric), numbers, shares)
        facts = self.facts([cell for cell in self.numeric if not cell.is_text])
        return exact_quantiles(facts, numbers, shares, self.rules.quantile_rows_per_task, self._read_numbers)

    @property
    def _read_numbers(self) -> DataFrame | None:
        """``(column, x, n)``: the numbers that were read from text, by spelling, so that no text is read again."""
        texts = any(cell.is_text for cell in self.numeric)
        return self._measured.filter("x IS NOT NULL").select("column", "x", "n") if texts else None

    def _bucket_count(self, cell: Cell) -> int:
        """Equal-width buckets of a histogram, at most one per distinct number."""
        counts = self.counts[cell.name]
        if not counts.numbers:
            return 0
        return 1 if counts.low == counts.high else min(8, self._distinct_parsed[cell.name])

    @cached_property
    def _distinct_parsed(self) -> dict[str, int]:
        """Distinct numbers per numeric column, exact up to eight."""
        found = {c.name: self.distinct_numbers[c.name] for c in self.numeric if c.kind == "number"}
        texts = [cell for cell in self.numeric if cell.kind != "number"]
        if texts:
            parsed = self._measured.filter(F.col("column").isin([cell.index for cell in texts])).select("column", "x")
            sizes = parsed.filter("x IS NOT NULL").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
            by_index = {row["column"]: row["n"] for row in sizes}
            found |= {cell.name: by_index.get(cell.index, 0) for cell in texts}
        return found

    def fences(self, cell: Cell, width: float) -> tuple[float, float] | None:
        """Quartile fences; None when there are too few numbers or no spread."""
        if self.counts[cell.name].numbers < 8:
            return None
        q1, _, q3 = self.quartiles[cell.name]
        return None if q1 == q3 else (q1 - width * (q3 - q1), q3 + width * (q3 - q1))

    def _far(self, cell: Cell) -> tuple[float, float | None]:
        """Sizes beyond which a number is far from the median, and of another unit."""
        median = abs(self.quartiles[cell.name][1])
        far, unit = self.rules.far_medians * median, self.rules.unit_medians * median
        return (max(far, 1.0), max(unit, 1.0)) if median else (1000.0, None)

    def outlier_sql(self, cell: Cell) -> str:
        """Outside some interquartile ranges and far from the median."""
        fences = self.fences(cell, self.rules.outlier_fence)
        if fences is None:
            return "false"
        x, (low, high), far = cell.number_sql, fences, self._far(cell)[0]
        return f"coalesce({x} NOT BETWEEN {double(low)} AND {double(high)} AND abs({x}) > {double(far)}, false)"

    @cached_property
    def outliers(self) -> dict[str, Spread]:
        return self._measure_spread(self.numeric, histogram=False)

    @cached_property
    def histograms(self) -> dict[str, Spread]:
        found = self._measure_spread(self.numeric, histogram=True)
        self.__dict__.setdefault("outliers", found)
        return found

    def _measure_spread(self, cells: list[Cell], histogram: bool) -> dict[str, Spread]:
        """One scan of ``(column, number, parameters, n)``, counted by bucket and outlier flags."""
        found: dict[str, Spread] = {}
        longs, of_texts = [], []
        for cell in cells:
            counts = self.counts[cell.name]
            spread = found[cell.name] = Spread()
            buckets, fences = 0, self.fences(cell, self.rules.outlier_fence)
            if histogram and (buckets := self._bucket_count(cell)):
                step = (counts.high - counts.low) / buckets
                spread.edges = [counts.low + i * step for i in range(buckets)] + [counts.high]
                spread.buckets = [0] * buckets
            far, unit = None, None
            if fences:
                spread.low, spread.high = fences
                far, unit = self._far(cell)
            if counts.numbers:
                parameters = {
                    "low": counts.low,
                    "step": step if buckets > 1 else None,
                    "buckets": float(buckets),
                    "fence_low": spread.low,
                    "fence_high": spread.high,
                    "far": far,
                    "unit": unit,
                }
                literals = ", ".join(f"{double(value)} AS {name}" for name, value in parameters.items())
                if cell.is_text:
                    of_texts.append(f"{cell.index}, struct({literals})")
                else:
                    longs.append(f"struct({cell.index} AS column, __number_{cell.index} AS x, {literals}, 1L AS n)")
        frames = []
        if longs:
            natives = self.facts([cell for cell in cells if not cell.is_text])
            frames.append(natives.selectExpr(f"explode(array({', '.join(longs)})) AS v").selectExpr("v.*"))
        if of_texts:
            wanted = self._read_numbers.selectExpr("column", "x", f"try_element_at(map({', '.join(of_texts)}), column) AS p", "n")
            frames.append(wanted.filter("p IS NOT NULL").select("column", "x", "p.*", "n"))
        if not frames:
            return found
        long = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        long = long.filter("x IS NOT NULL")
        last = "buckets - 1"
        coded = (
            long.selectExpr("*", f"least(floor((x - low) / step), {last}) AS guess")
            # closed below, open above but for the last, whatever rounding did to the guess
            .selectExpr(
                "*",
                f"""coalesce(CASE WHEN x < low + guess * step THEN guess - 1
                    WHEN x >= low + (guess + 1) * step AND guess < {last} THEN guess + 1 ELSE guess END, 0) AS bucket""",
                "coalesce(x NOT BETWEEN fence_low AND fence_high AND abs(x) > far, false) AS outlier",
            )
            .selectExpr("column", "bucket", "outlier", "coalesce(outlier AND abs(x) > unit, false) AS slip", "n")
        )
        counted = coded.groupBy("column", "bucket", "outlier", "slip").agg(F.sum("n").alias("n"))
        for row in counted.collect():
            spread = found[self.cells[row["column"]].name]
            if spread.buckets:
                spread.buckets[int(row.bucket)] += row.n
            spread.outliers += row.n if row.outlier else 0
            spread.unit_scale |= row.slip
        return found

    # -- whole rows -------------------------------------------------------------------
    @cached_property
    def keys(self) -> list[Cell]:
        return [cell for cell in self.cells if is_key_name(cell.name)]

    @cached_property
    def groups(self) -> DataFrame:
        groups = rows.row_groups(self.df, self.cells, self.keys)
        return written(groups, "groups") if self.keys and not self._small else groups

    @cached_property
    def copies(self) -> tuple[int, int]:
        """(rows that have an exact copy, rows beyond the first of each)."""
        measured = self.__dict__.get("distinct_numbers", {}) | self.__dict__.get("distinct_words", {})
        if not self.rules.approximate and any(measured.get(key.name) == self.rows for key in self.keys):
            return 0, 0  # a key that never repeats leaves no room for copies
        self.measure(cells=False)
        row = self._found.get("copies", {}).get(-1)
        return (row["n"], row["extra"]) if row else (0, 0)

    def key_conflicts(self, key: Cell) -> tuple[int, int]:
        """(rows, groups) that share a key but differ elsewhere."""
        self.measure(cells=False)
        row = self._found[f"key {key.index}"].get(key.index)
        return (row["n"], row["tokens"]) if row and row["present"] else (0, 0)

    # -- categories -------------------------------------------------------------------
    def checks_categories(self, cell: Cell) -> bool:
        if not cell.is_text or self.types[cell.name] == "boolean" or not self.counts[cell.name].present:
            return False
        return is_country_name(cell.name) or self.types[cell.name] == "categorical" or self.few_tokens(cell)

    @cached_property
    def category_cells(self) -> list[Cell]:
        return [cell for cell in self.cells if self.checks_categories(cell)]

    @cached_property
    def category_spellings(self) -> DataFrame:
        """Whole-text spelling counts of the columns that hold categories."""
        short = [c for c in self.category_cells if 3 * self.counts[c.name].longest <= spellings.LONG]
        long = [c for c in self.category_cells if c not in short]
        made = (
            self.tokens.filter(F.col("column").isin([cell.index for cell in short]))
            .select("column", "folded", "spelling", "n")
        )
        return made.unionByName(spellings.whole_spellings(self.df, long)) if long else made

    @cached_property
    def categories(self) -> dict[str, dict]:
        """Rows to rewrite, losing spellings, aliases and countries of several spellings, by column."""
        found = {}
        long = [c for c in self.category_cells if 3 * self.counts[c.name].longest > spellings.LONG]
        for cell in self.category_cells:
            row = self._found["words"][cell.index]
            forms: dict[str, int] = {}
            for canonical, n in row["countries"]:
                forms[canonical] = forms.get(canonical, 0) + n
            mixed = sum(n > 1 for n in forms.values())
            found[cell.name] = {"rows": row["rewrite"], "variants": row["variants"], "aliases": row["aliases"] or 0, "mixed": mixed}
        if long:  # their whole texts decide
            names = {cell.index: cell.name for cell in long}
            for row in spellings.category_findings(self.category_spellings, long, self.rules).collect():
                if row["column"] in names:
                    found[names[row["column"]]] = row.asDict()
        return found

    def truth_counts(self, cell: Cell) -> DataFrame:
        """``(value, n)`` of the booleans a column is read as."""
        words = self.tokens.filter((F.col("column") == cell.index) & F.col("digest").isNull())
        label = F.initcap(F.expr(parse_bool("spelling", self.rules)).cast("string"))
        return words.select(label.alias("value"), "n").filter("value IS NOT NULL").groupBy("value").agg(
            F.sum("n").alias("n")
        )
