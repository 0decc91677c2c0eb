"""Whole-row operators: fingerprints, copies, keep-first and first-k rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.cells import ORD, Cell, cells_of, data_columns, one_of, quoted, strip
from sluice.operators.sieve import sieve, sifted
from sluice.rules import DEFAULT_RULES, Rules
from sluice.workspace import written


def may_broadcast(lookup: DataFrame, rules: Rules) -> bool:
    """Whether a written lookup is within both bounds, measured."""
    size = F.sum(sum(F.coalesce(F.octet_length(F.col(quoted(n)).cast("string")), F.lit(0)) for n in lookup.columns))
    rows, values = lookup.agg(F.count(F.lit(1)), size).first()
    return rows <= rules.broadcast_rows and (values or 0) <= rules.broadcast_bytes


def comparable_sql(cell: Cell) -> str:
    """The cell in a form that can be hashed, grouped and joined on."""
    return cell.text_sql if cell.kind in ("nested", "other") else quoted(cell.name)


def comparable(cell: Cell) -> Column:
    return F.expr(comparable_sql(cell))


def fingerprint(cells: Sequence[Cell]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row, chained from different seeds.

    Together they identify a row: among 10^12 different rows the chance of any
    false match is about 10^-14, and only 16 bytes a row are shuffled. Nulls are
    hashed as flags because the hash itself skips them.
    """
    values = ", ".join(comparable_sql(cell) for cell in cells)
    flags = ", ".join(f"{quoted(cell.name)} IS NULL" for cell in cells)
    return F.expr(f"xxhash64({values}, {flags})"), F.expr(f"xxhash64('second', {flags}, {values})")


def row_groups(df: DataFrame, cells: Sequence[Cell], keys: Sequence[Cell] = ()) -> DataFrame:
    """One row per distinct row of ``df``: key values, fingerprint ``f1 f2``, copies ``n``."""
    f1, f2 = fingerprint(cells)
    kept = [comparable(key).alias(f"k{key.index}") for key in keys]
    return (
        df.select(*kept, f1.alias("f1"), f2.alias("f2"))
        .groupBy(*[f"k{key.index}" for key in keys], "f1", "f2")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every distinct row that occurs more than once, with its number of ``copies``."""
    names = data_columns(df)
    return df.groupBy(*map(quoted, names)).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def repeated_keys(groups: DataFrame, key: Cell) -> DataFrame:
    """Raw key values on more than one row, grouped by how they read.

    Columns: ``key``, ``token``, ``rows``, ``token_variants`` (different full rows
    that share the token) and ``present``.
    """
    if key.is_text:
        bare = strip("key")
        word = one_of(bare, key.rules.sentinels_for(key.name))
        token, present = f"coalesce({bare}, '')", f"coalesce({bare} != '', false) AND NOT {word}"
    else:
        token, present = "key", "key IS NOT NULL"
        if key.dtype.typeName() in ("float", "double"):
            present += " AND NOT isnan(key)"
    return (
        groups.groupBy(F.col(f"k{key.index}").alias("key"))
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("variants"))
        .filter("rows > 1")
        .selectExpr("key", "rows", "variants", f"{token} AS token", f"{present} AS present")
    )


def conflict_tokens(repeated: DataFrame) -> DataFrame:
    """Per token: ``rows`` flagged and whether different full rows share it."""
    return repeated.groupBy("token").agg(
        F.sum("rows").alias("rows"), F.sum("variants").alias("variants"), F.max("present").alias("present")
    )


def key_conflicts(df: DataFrame, key: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Keys whose repeated rows differ elsewhere: ``token``, ``rows``, ``variants``.

    Nothing is reported when no present key value occurs twice exactly.
    """
    cells = cells_of(df, rules=rules)
    cell = next(c for c in cells if c.name == key)
    tokens = conflict_tokens(repeated_keys(row_groups(df, cells, [cell]), cell))
    triggered = tokens.agg(F.max("present").alias("present")).scalar()
    return tokens.filter((F.col("variants") > 1) & triggered).select("token", "rows", "variants")


def without_positions(df: DataFrame, gone: DataFrame) -> DataFrame:
    """``df`` without the rows at the written positions ``gone(_ord)``.

    Each position is a bit of a bitmap of bounded size. Rows whose bit is not set stay where they are;
    only the others, which nearly all go, are compared with the list itself.
    """
    caught, kept = sifted(df, F.col(ORD), sieve(gone, F.col(ORD)))
    return kept.unionByName(caught.join(gone, ORD, "left_anti").select(*map(quoted, df.columns)))


def later_rows(marked: DataFrame, names: Sequence[str]) -> DataFrame:
    """Positions of all but the first row of each group of ``marked(_ord, names...)``, written.

    Groups are combined before the shuffle. Only rows that may be in a group of several, as a bitmap
    tells, are compared with the first positions; a hot group is a skewed partition of few narrow rows,
    which Spark splits.
    """
    groups = marked.groupBy(*names).agg(F.min(ORD).alias("__first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = written(groups.drop("n"), "firsts")
    suspects, _ = sifted(marked, F.xxhash64(*names), sieve(firsts, F.xxhash64(*names)))
    others = firsts.select("__first", *[F.col(name).alias(f"{name}_first") for name in names])
    same = [F.col(name).eqNullSafe(F.col(f"{name}_first")) for name in names]
    return written(suspects.join(others, same).filter(F.col(ORD) > F.col("__first")).select(ORD), "later")


def drop_copies(df: DataFrame, rules: Rules = DEFAULT_RULES, rows: int | None = None) -> DataFrame:
    """Distinct rows, each at its first position.

    Fingerprints and positions are shuffled, 24 bytes a row, and what goes is deleted by position. A table
    without positions, or one known to be small, is simply grouped.
    """
    if ORD not in df.columns:
        return df.dropDuplicates()
    if rows is not None and rows <= rules.broadcast_rows:
        names = data_columns(df)
        return df.groupBy(*map(quoted, names)).agg(F.min(ORD).alias(ORD)).select(*map(quoted, df.columns))
    f1, f2 = fingerprint(cells_of(df, rules=rules))
    gone = later_rows(df.select(ORD, f1.alias("f1"), f2.alias("f2")), ["f1", "f2"])
    return without_positions(df, gone)


def keep_first(df: DataFrame, key: str, rules: Rules = DEFAULT_RULES, rows: int | None = None) -> DataFrame:
    """First row of every key; rows without a key all stay unless told otherwise.

    Only keys and positions are shuffled, and what goes is deleted by position. Without positions any row
    of a key is its first.
    """
    column = F.col(quoted(key))
    keyed = F.lit(True) if rules.collapse_null_keys else column.isNotNull()
    if ORD not in df.columns:
        return df.filter(keyed).dropDuplicates([key]).unionByName(df.filter(~keyed))
    gone = later_rows(df.filter(keyed).select(ORD, column.alias("__key")), ["__key"])
    return without_positions(df, gone)


def digest_of(value: Column) -> list[Column]:
    """A value, null included, as two 64-bit numbers ``h1 h2``, however long it is."""
    flag = value.isNull()
    return [F.xxhash64(value, flag).alias("h1"), F.xxhash64(F.lit("second"), flag, value).alias("h2")]


def listed(df: DataFrame, value: Column, entries: DataFrame, rows: int) -> DataFrame:
    """Rows of ``df`` whose value is among ``entries(h1, h2, n)``, which is written or kept; n rows have it.

    A bitmap first lets those through that may be. An entry that a thousandth of all rows have is one of a
    thousand at most, so these are broadcast, and a hot value is never shuffled; the others are joined.
    """
    names = df.columns
    suspects, _ = sifted(df.select("*", *digest_of(value)), F.col("h1"), sieve(entries, F.col("h1")))
    common = entries.filter(F.col("n") * 1000 > rows).select("h1", "h2", F.lit(True).alias("common"))
    marked = suspects.join(F.broadcast(common), ["h1", "h2"], "left")
    rare = marked.filter(F.col("common").isNull()).join(entries, ["h1", "h2"], "left_semi")
    return marked.filter("common").select(*names).unionByName(rare.select(*names))


_POSITION_BLOCKS = 1024


def first_rows(marked: DataFrame, limit: int, rows: int, tails: dict[int, float] | None = None) -> DataFrame:
    """First ``limit`` rows of each label of ``marked(label, _ord, value)`` by position.

    One aggregate over blocks of positions first tells how far each label has to be read, so the
    ranking sees only rows up to there. It also gives the share of each label's rows that lie in the
    last fifth of the positions, which is put into ``tails``. ``marked`` is read twice: give it written
    or cached where it is dear.
    """
    block = F.expr(f"CAST({ORD} * {_POSITION_BLOCKS}D / {max(rows, 1)}D AS INT)")
    late = F.count_if(F.col(ORD) >= rows * 0.8)
    counts = marked.groupBy("label", block.alias("block")).agg(F.count(F.lit(1)).alias("n"), late.alias("late")).collect()
    reach, seen, behind = {}, {}, {}
    for row in sorted(counts, key=lambda r: (r.label, r.block)):
        if seen.get(row.label, 0) < limit:
            reach[row.label] = row.block
        seen[row.label] = seen.get(row.label, 0) + row.n
        behind[row.label] = behind.get(row.label, 0) + row.late
    if tails is not None:
        tails |= {label: round(behind[label] / n, 4) for label, n in seen.items()}
    if reach:
        last = ", ".join(f"{label}, {block}" for label, block in reach.items())
        marked = marked.filter(block <= F.expr(f"try_element_at(map({last}), label)"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(ORD))
    return marked.withColumn("place", place).filter(F.col("place") <= limit)


def mark(df: DataFrame, flags: Mapping[int, tuple[str, str]]) -> DataFrame:
    """Long frame ``(label, _ord, value)`` of the rows that each (test, value), as SQL, holds for."""
    marks = [
        f"CASE WHEN {test} THEN struct({label} AS label, left({value}, 80) AS value) END"
        for label, (test, value) in flags.items()
    ]
    long = df.selectExpr(ORD, f"explode(array({', '.join(marks)})) AS m").filter("m IS NOT NULL")
    return long.select("m.label", ORD, "m.value")
