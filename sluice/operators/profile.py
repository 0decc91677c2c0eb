"""The profile: one row per column, from the measurements of an inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.cells import ORD, Cell, long_cell, long_texts, with_facts
from sluice.operators import rows, spellings
from sluice.operators.inspection import Inspection

NEAR = 10_000  # positions among which examples are looked for before the whole table is
PROFILE_SCHEMA = """
    name string, inferred_type string, role string,
    null_count bigint, null_pct double, sentinel_count bigint, sentinel_pct double, unique_count bigint,
    examples array<string>,
    stats struct<min: double, max: double, mean: double, median: double, stdev: double, p25: double, p75: double>,
    histogram array<struct<lo: double, hi: double, count: bigint>>,
    top_values array<struct<value: string, count: bigint>>
"""


def table_profile(inspection: Inspection) -> dict[str, int]:
    return {
        "row_count": inspection.rows,
        "column_count": len(inspection.cells),
        "duplicate_row_count": inspection.copies[1],
    }


def column_stats(inspection: Inspection, cell: Cell) -> dict[str, float] | None:
    counts = inspection.counts[cell.name]
    if not inspection.is_numeric(cell) or not counts.numbers:
        return None
    p25, median, p75 = inspection.quartiles[cell.name]
    exact = {
        "min": counts.low,
        "max": counts.high,
        "mean": counts.mean,
        "median": median,
        "stdev": inspection.deviation(cell),
        "p25": p25,
        "p75": p75,
    }
    return {name: round(value, 4) for name, value in exact.items()}


def column_histogram(inspection: Inspection, cell: Cell) -> list[dict]:
    if not inspection.is_numeric(cell):
        return []
    spread = inspection.histograms[cell.name]
    if len(spread.buckets) == 1:
        return [{"lo": spread.edges[0], "hi": spread.edges[1], "count": spread.buckets[0]}]
    return [
        {"lo": round(lo, 4), "hi": round(hi, 4), "count": n}
        for lo, hi, n in zip(spread.edges, spread.edges[1:], spread.buckets)
    ]


def examples(inspection: Inspection, limit: int = 3) -> dict[str, list[str]]:
    """First present values of each column by row position, 80 characters each."""
    if not inspection.ordered:
        return {}
    near = _first_present(inspection.df.filter(F.col(ORD) < NEAR), inspection.cells, limit, NEAR)
    few = [cell for cell in inspection.cells if len(near.get(cell.index, [])) < limit]
    if few and inspection.extent > NEAR:
        near |= _first_present(inspection.df, few, limit, inspection.extent)
    return {cell.name: near.get(cell.index, []) for cell in inspection.cells}


def _first_present(df: DataFrame, cells: Sequence[Cell], limit: int, extent: int) -> dict[int, list[str]]:
    """The first present values of some columns, by the cell's index; ``extent``: how far positions reach."""
    cell = long_cell(cells)
    long = with_facts(long_texts(df, cells, [F.col(ORD)]), [cell]).filter(cell.present)
    marked = long.select(F.col("column").alias("label"), ORD, F.left(cell.text, F.lit(80)).alias("value"))
    found: dict[int, list[str]] = {}
    for row in sorted(rows.first_rows(marked, limit, extent).collect(), key=lambda r: (r.label, r.place)):
        found.setdefault(row.label, []).append(row.value)
    return found


def top_value_rows(inspection: Inspection, limit: int = 8) -> dict[str, list[dict]]:
    """Most frequent values of every column that is not numeric."""
    found: dict[str, list[dict]] = {}
    plain = []
    for cell in inspection.worded:
        if inspection.types[cell.name] == "boolean":
            ranked = inspection.truth_counts(cell).orderBy(F.desc("n"), "value").limit(limit).collect()
            found[cell.name] = [{"value": row.value, "count": row.n} for row in ranked]
        elif not inspection.is_numeric(cell):
            plain.append(cell)
    if plain:
        counts = inspection.tokens.filter(F.col("column").isin([cell.index for cell in plain]))
        ranked = spellings.top_values(inspection.df, plain, counts, limit).collect()
        names = {cell.index: cell.name for cell in plain}
        for row in sorted(ranked, key=lambda r: (r["column"], r.place)):
            found.setdefault(names[row["column"]], []).append({"value": row.value, "count": row.n})
    return found


def profile_rows(inspection: Inspection, detail: bool = True) -> list[dict]:
    """One dict per column; ``detail=False`` leaves out what no decision needs."""
    shown = examples(inspection) if detail else {}
    top = top_value_rows(inspection) if detail else {}
    described = []
    for cell in inspection.cells:
        counts, total = inspection.counts[cell.name], max(inspection.rows, 1)
        described.append(
            {
                "name": cell.name,
                "inferred_type": inspection.types[cell.name],
                "role": inspection.roles[cell.name],
                "null_count": counts.blank,
                "null_pct": round(counts.blank / total, 4),
                "sentinel_count": counts.sentinel,
                "sentinel_pct": round(counts.sentinel / total, 4),
                "unique_count": inspection.distinct[cell.name] if detail else None,
                "examples": shown.get(cell.name, []),
                "stats": column_stats(inspection, cell) if detail else None,
                "histogram": column_histogram(inspection, cell) if detail else [],
                "top_values": top.get(cell.name, []),
            }
        )
    return described


def profile(inspection: Inspection) -> DataFrame:
    """The full profile as a DataFrame, one row per column."""
    spark: SparkSession = inspection.df.sparkSession
    return spark.createDataFrame(profile_rows(inspection), PROFILE_SCHEMA)


