"""Value counts of text columns: distinct tokens, top values, spelling variants."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.cells import Cell, cells_of, country_of, fold, long_cell, long_texts, with_facts
from sluice.functions.names import is_country_name
from sluice.rules import DEFAULT_RULES, Rules

LONG = 200  # bytes; longer texts are counted by digest so that they are not shuffled
HEAD = 64  # characters of a long text kept beside its digest, to order by
SHORT_HEAD = 16  # characters by which ties are looked at first
STEP = 32  # and in every further round
OPEN = 1000  # texts with one beginning that are fetched whole


def present_texts(df: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """``(column, bare)``: stripped present texts of many columns below each other."""
    cell = long_cell(cells)
    return with_facts(long_texts(df, cells), [cell]).filter(cell.present).select("column", cell.bare.alias("bare"))


def text_values(df: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """``(column, long, text, n)``: raw values of many columns with their frequency.

    Rules then run once per distinct value. Long texts, which seldom repeat, are not
    grouped: of them only the number is given, under a null ``text``.
    """
    long = F.coalesce(F.octet_length("text") > LONG, F.lit(False))
    return (
        long_texts(df, cells)
        .select("column", long.alias("long"), F.when(~long, F.col("text")).alias("text"))
        .groupBy("column", "long", "text")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def only_long(df: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """``(column, text)`` of the long texts of many columns; rows without any are ruled out before columns are
    put below each other."""
    any_long = " OR ".join(f"octet_length({cell.text_sql}) > {LONG}" for cell in cells)
    return long_texts(df.filter(any_long), cells).filter(F.octet_length("text") > LONG)


def measured_spellings(values: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """``(column, folded, spelling, digest, n, x, ...)`` of ``(column, text, n)``: what the text rules count, by spelling.

    ``column`` is the cell's index. For a long text ``folded`` and ``digest`` are 128-bit digests of the whole
    text and ``spelling`` its head; for any other ``digest`` is null and both are the text itself. Of cells that
    are not present, ``folded`` is null and only words for no value are spelt out. ``x`` is the number read.
    """
    cell = long_cell(cells)
    flags = {what: cell.flag_sql(what) for what in ("blank", "sentinel", "decorated", "padded", "not_iso")} | {
        "truths": f"{cell.truth_sql} IS NOT NULL",
        "emails": cell.ref("email"),
        "days": f"{cell.day_sql} IS NOT NULL",
    }
    shown = f"{cell.present_sql} OR {cell.flag_sql('sentinel')}"
    rows = (
        with_facts(values, [cell])
        .withColumn("bare", F.expr(f"CASE WHEN {shown} THEN {cell.ref('bare')} END"))
        .withColumn("folded", F.expr(f"CASE WHEN {cell.present_sql} THEN {fold('bare')} END"))
    )
    long, bare, folded = F.coalesce(F.octet_length("folded") > LONG, F.lit(False)), F.col("bare"), F.col("folded")
    rows = rows.select(
        "column",
        F.when(long, F.md5(folded)).otherwise(folded).alias("folded"),
        F.when(long, F.left(bare, F.lit(HEAD))).otherwise(bare).alias("spelling"),
        F.when(long, F.md5(bare)).alias("digest"),
        "n",
        *[F.expr(f"if({test}, n, 0L) AS {what}") for what, test in flags.items()],
        F.octet_length(cell.bare).alias("longest"),
        cell.number.alias("x"),
    )
    # spellings of one caseless value meet in one place, so that they need not be shuffled again
    return (
        rows.repartition("column", "folded")
        .groupBy("column", "folded", "spelling", "digest")
        .agg(F.sum("n").alias("n"), *[F.sum(what).alias(what) for what in flags], F.max("longest").alias("longest"), F.max("x").alias("x"))
    )


def measured_tokens(measured: DataFrame, cells: Sequence[Cell], rules: Rules) -> DataFrame:
    """One row for each caseless value of a column: sums over its spellings, and how these vary.

    ``rewrite`` counts the rows whose spelling loses or is an alias of a country's name, ``canonical`` and
    ``forms`` are the country and the number of its spellings here.
    """
    countries = [cell.index for cell in cells if is_country_name(cell.name)]
    with_alias = [cell.index for cell in cells] if rules.alias_rows_everywhere else countries
    canonical = F.when(F.col("column").isin(with_alias) & F.col("folded").isNotNull(), F.expr(country_of("spelling", rules)))
    weighed = {
        "numbers": "x IS NOT NULL",
        "negative": "x < 0",
        "fractional": "abs(x - rint(x)) >= 1e-9D",
        "inexact": "x != rint(x)",
    }
    sums = ("n", "blank", "sentinel", "decorated", "padded", "not_iso", "truths", "emails", "days")
    whole = [
        *[F.sum(what).alias(what) for what in sums],
        *[F.sum(F.expr(f"if({test}, n, 0L)")).alias(what) for what, test in weighed.items()],
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.sum(F.expr("x * n")).alias("total"),
        F.max("longest").alias("longest"),
        F.count(F.lit(1)).alias("forms"),
    ]
    # Only an alias needs to know which spelling wins. Other tokens, which are many, need but its rows: their
    # sums are numbers alone, so they are hashed where texts among them would have to be sorted.
    aliases = [alias for alias in rules.country_aliases if with_alias]
    by_text = F.col("folded").isin(aliases) | F.col("digest").isNotNull()  # of a long text only the head is known
    is_alias = F.coalesce(F.col("column").isin(with_alias) & by_text, F.lit(False))
    plain = measured.filter(~is_alias).groupBy("column", "folded").agg(*whole, F.max("n").alias("kept"))
    tokens = plain.select("*", F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("boolean").alias("named"))
    if aliases:
        named = (
            measured.filter(is_alias)
            .withColumn("canonical", canonical)
            .groupBy("column", "folded")
            .agg(
                *whole,
                F.min(F.struct(-F.col("n"), -F.length("spelling"), F.col("spelling").alias("winner"))).alias("best"),
                F.max("canonical").alias("canonical"),
                F.max(F.expr("spelling = canonical")).alias("named"),
            )
        )
        kept = F.when(F.coalesce(F.col("canonical") == F.col("best.winner"), F.lit(True)), F.expr("-best.col1")).otherwise(0)
        tokens = tokens.unionByName(named.withColumn("kept", kept).drop("best"))
    present = F.col("folded").isNotNull()
    of_country = F.col("column").isin(countries) & F.col("canonical").isNotNull()
    return tokens.select(
        "column", *sums, *weighed, "low", "high", "total", "longest",
        present.cast("long").alias("tokens"),
        F.when(present, F.expr("n - kept")).alias("rewrite"),
        F.when(present, F.col("forms") - 1).alias("variants"),
        F.when(of_country, F.col("forms") - F.coalesce(F.col("named"), F.lit(False)).cast("long")).alias("aliases"),
        F.when(of_country, F.col("canonical")).alias("canonical"),
        F.when(of_country, F.col("forms")).alias("forms"),
    )


def digest_counts(df: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """``(column, spelling, digest, n)`` of present texts, for columns that hardly repeat: only a digest
    and a short head of each text is shuffled."""
    texts = present_texts(df, cells).select("column", F.left("bare", F.lit(SHORT_HEAD)).alias("spelling"), F.unhex(F.md5("bare")).alias("digest"))
    return texts.groupBy("column", "spelling", "digest").agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.lower(F.hex("digest")))


def top_values(df: DataFrame, cells: Sequence[Cell], counts: DataFrame, limit: int = 8) -> DataFrame:
    """``(column, place, value, n)``: most frequent values, ties in code-point order.

    ``counts`` has ``(column, spelling, digest, n)``, where a text with a digest is known by its head only. It is
    counted how many values each frequency has, which settles all but the last frequency that is
    needed. Of the values that tie there, the first are found by longer and longer beginnings: beginnings are
    counted, and only the few texts under those that matter are ever fetched whole.
    """
    levels = counts.groupBy("column", "n").agg(F.count(F.lit(1)).alias("values"))
    by_count = Window.partitionBy("column").orderBy(F.desc("n"))
    levels = levels.withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= limit).collect()
    level: dict[int, int] = {}  # the last frequency that is needed, by column
    left: dict[int, int] = {}  # and how many of its values
    needed: dict[int, int] = {}
    for row in sorted(levels, key=lambda r: (r["column"], r.place)):
        column = row["column"]
        before = needed.get(column, limit)
        if before > 0:
            level[column], left[column] = row.n, min(before, row["values"])
            needed[column] = before - row["values"]
    empty = "column int, value string, n bigint"
    if not level:
        return df.sparkSession.createDataFrame([], empty).withColumn("place", F.lit(0)).select("column", "place", "value", "n")

    at = F.expr(f"try_element_at(map({', '.join(f'{c}, {n}L' for c, n in level.items())}), column)")
    head = F.left("spelling", F.lit(SHORT_HEAD))
    tied = counts.filter(F.col("n") == at)
    open_, deep = _first_beginnings(tied.select("column", head.alias("beginning")), dict.fromkeys(level, ""), left, limit)
    near = counts.filter(F.col("n") > at).unionByName(tied.filter(_begins(open_, F.col("spelling"), dict.fromkeys(open_, SHORT_HEAD))))
    near = near.select("column", F.col("spelling").alias("value"), "digest", "n")
    wanted = near.filter("digest IS NOT NULL").select("column", "digest", "n")
    texts = present_texts(df, cells).select("column", F.col("bare").alias("value"), F.md5("bare").alias("digest"))
    # OPEN texts of a column at most, and fewer than ``limit`` above them
    fetched = texts.join(F.broadcast(wanted), ["column", "digest"]).groupBy("column", "value", "n").count()
    found = near.filter("digest IS NULL").select("column", "value", "n").unionByName(fetched.select("column", "value", "n"))
    if deep:
        found = found.unionByName(_first_of_many(present_texts(df, cells), level, deep, limit))
    exact = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return found.withColumn("place", F.row_number().over(exact)).filter(F.col("place") <= limit).select("column", "place", "value", "n")


def _first_beginnings(
    values: DataFrame, before: dict[int, str], left: dict[int, int], limit: int
) -> tuple[dict[int, list[str]], dict[int, tuple[str, int]]]:
    """The beginnings under which the first ``left`` values of each column lie.

    ``values``: one row ``(column, beginning)`` for each value, all of which begin with ``before``. Returns the
    beginnings with few values by column, and the one with many: the beginning and how many of its values are needed.
    """
    counted = values.groupBy("column", "beginning").agg(F.count(F.lit(1)).alias("values"))
    in_order = Window.partitionBy("column").orderBy("beginning")
    rows = counted.withColumn("place", F.row_number().over(in_order)).filter(F.col("place") <= limit).collect()
    open_: dict[int, list[str]] = {}
    deep: dict[int, tuple[str, int]] = {}
    still = dict(left)
    for row in sorted(rows, key=lambda r: (r["column"], r.place)):
        column, beginning = row["column"], before[row["column"]] + row.beginning
        if still[column] <= 0:
            continue
        if row["values"] > OPEN:
            deep[column] = (beginning, min(still[column], row["values"]))
        else:
            open_.setdefault(column, []).append(beginning)
        still[column] -= row["values"]
    return open_, deep


def _begins(beginnings: dict[int, list[str]], text: Column, lengths: dict[int, int]) -> Column:
    """Whether the first ``lengths`` characters of a column's text are one of its beginnings."""
    found = F.lit(False)
    for column, wanted in beginnings.items():
        found = found | ((F.col("column") == column) & F.left(text, F.lit(lengths[column])).isin(wanted))
    return found


def _first_of_many(texts: DataFrame, level: dict[int, int], deep: dict[int, tuple[str, int]], limit: int) -> DataFrame:
    """``(column, value, n)``: the first texts, in order, of those that occur ``level`` times and begin as ``deep`` says.

    Each round lengthens a beginning to all that its texts have in common and counts what comes next.
    """
    at = F.expr(f"try_element_at(map({', '.join(f'{c}, {n}L' for c, n in level.items())}), column)")
    found = None
    while deep:
        inside = texts.filter(_begins({c: [b] for c, (b, _) in deep.items()}, F.col("bare"), {c: len(b) for c, (b, _) in deep.items()}))
        ends = inside.groupBy("column").agg(F.min("bare").alias("first"), F.max("bare").alias("last")).collect()
        common = {row["column"]: os.path.commonprefix([row.first, row["last"]]) for row in ends}
        length = F.expr(f"try_element_at(map({', '.join(f'{c}, {len(text)}' for c, text in common.items())}), column)")
        once = inside.groupBy("column", F.substr("bare", length + 1, F.lit(STEP)).alias("beginning"), F.md5("bare").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
        values = once.filter(F.col("n") == at).select("column", "beginning")
        open_, deep = _first_beginnings(values, common, {c: n for c, (_, n) in deep.items()}, limit)
        few = texts.filter(_begins(open_, F.col("bare"), {c: len(common[c]) + STEP for c in open_})).groupBy("column", F.col("bare").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == at)
        found = few if found is None else found.unionByName(few)
    return found


def whole_spellings(df: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """``(column, folded, spelling, n)`` over whole texts, for columns of few tokens."""
    return (
        present_texts(df, cells)
        .groupBy("column", F.col("bare").alias("spelling"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("column", F.expr(fold("spelling")).alias("folded"), "spelling", "n")
    )


def with_winner(spellings: DataFrame) -> DataFrame:
    """Adds ``winner`` where a token has several spellings: most frequent, longest, first."""
    best = (
        spellings.groupBy("column", "folded")
        .agg(
            F.min(F.struct(-F.col("n"), -F.length("spelling"), F.col("spelling").alias("winner"))).alias("best"),
            F.count(F.lit(1)).alias("forms"),
        )
        .filter("forms > 1")
        .select("column", "folded", F.col("best.winner").alias("winner"))
    )
    return spellings.join(best, ["column", "folded"], "left")


def case_map(df: DataFrame, column: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """``(spelling, winner, n)``: spellings of a column that lose to a more common one."""
    (cell,) = cells_of(df, [column], rules)
    spellings = with_winner(whole_spellings(df, [cell]))
    return spellings.filter("spelling <> winner").select("spelling", "winner", "n")


def category_findings(spellings: DataFrame, cells: Sequence[Cell], rules: Rules) -> DataFrame:
    """Per column: ``rows`` to rewrite, ``variants`` and ``mixed`` countries; one row each.

    A column is inconsistent when it has variants or one country under several
    spellings. Aliases that differ from the country's name count as rows to rewrite.
    """
    countries = [cell.index for cell in cells if is_country_name(cell.name)]
    with_alias = [cell.index for cell in cells] if rules.alias_rows_everywhere else countries
    canonical = F.when(F.col("column").isin(with_alias), F.expr(country_of("spelling", rules)))
    marked = with_winner(spellings).withColumns(
        {"variant": F.coalesce(F.col("spelling") != F.col("winner"), F.lit(False)), "canonical": canonical}
    )
    off = F.coalesce(F.col("canonical") != F.col("spelling"), F.lit(False))
    mixed = (
        marked.filter(F.col("column").isin(countries) & F.col("canonical").isNotNull())
        .groupBy("column", "canonical")
        .agg(F.count(F.lit(1)).alias("forms"))
        .filter("forms > 1")
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("mixed"))
    )
    return (
        marked.groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(F.col("variant") | off, F.col("n"))), F.lit(0)).alias("rows"),
            F.count_if("variant").alias("variants"),
            F.count_if(off & F.col("column").isin(countries)).alias("aliases"),
        )
        .join(mixed, "column", "left")
        .na.fill(0, ["mixed"])
    )


def category_examples(spellings: DataFrame, cells: Sequence[Cell], rules: Rules) -> dict[int, list[str]]:
    """Up to eight spellings per column: six variants or winners, then mixed countries."""
    countries = [cell.index for cell in cells if is_country_name(cell.name)]
    forms = with_winner(spellings).filter("winner IS NOT NULL").select("column", "spelling", F.lit(0).alias("part"))
    by_country = Window.partitionBy("column", "canonical")
    aliases = (
        spellings.filter(F.col("column").isin(countries))
        .withColumn("canonical", F.expr(country_of("spelling", rules)))
        .filter("canonical IS NOT NULL")
        .withColumn("forms", F.count(F.lit(1)).over(by_country))
        .filter("forms > 1")
        .select("column", "spelling", F.lit(1).alias("part"))
    )
    place = F.row_number().over(Window.partitionBy("column", "part").orderBy("spelling"))
    rows = forms.unionByName(aliases).withColumn("place", place).filter("place <= 14").collect()
    found: dict[int, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.part, r.place)):
        shown = found.setdefault(row.column, [])
        if row.spelling not in shown and len(shown) < (6 if row.part == 0 else 8):
            shown.append(row.spelling)
    return found
