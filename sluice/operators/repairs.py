"""Repair strategies as DataFrame transforms, and the plans that choose them.

A cell repair replaces one column and says which cells it changes; all of them
fuse into one projection. A row repair drops rows. ``apply`` runs both kinds in
the fixed order and counts what each changed in one extra scan of the repaired
columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sluice.functions import fixed
from sluice.functions.cells import (
    CURRENCY_AND_SPACE,
    PLAIN_NUMBER,
    Cell,
    cells_of,
    country_of,
    fold,
    strip,
    with_facts,
    without_facts,
)
from sluice.functions.dates import iso
from sluice.functions.names import is_country_name, is_key_name
from sluice.functions.sqltext import double, mapping, pattern, quoted, text
from sluice.operators.inspection import Inspection
from sluice.operators.issues import Issue
from sluice.operators.quantiles import Numbers, exact_quantiles
from sluice.operators.rows import drop_copies, keep_first, may_broadcast
from sluice.operators.spellings import whole_spellings, with_winner
from sluice.rules import DEFAULT_RULES, Rules
from sluice.workspace import short_methods, written

REPAIR_SCHEMA = """
    id string, issue_id string, column string, strategy string, description string, disposition string,
    applied boolean, rows_affected bigint, target_type string
"""


@dataclass
class Repair:
    strategy: str
    column: str | None = None
    disposition: str = "auto"
    issue_id: str | None = None
    target_type: str | None = None
    description: str = ""
    id: str = ""
    applied: bool = False
    rows_affected: int = 0


DESCRIPTIONS = {
    "trim_whitespace": "Remove white space around {column}.",
    "replace_sentinels": "Empty the cells of {column} that hold a word for no value.",
    "coerce_numeric": "Store {column} as numbers; what does not read as one becomes empty.",
    "normalize_country": "Give every country alias in {column} its one name.",
    "canonicalize_case": "Give every value of {column} its most common spelling.",
    "coerce_dates": "Write {column} as yyyy-MM-dd; what is not a date becomes empty.",
    "coerce_booleans": "Store {column} as true or false.",
    "drop_exact_duplicates": "Keep the first of each set of identical rows.",
    "absolute_value": "Drop the sign of {column}; confirm that no refunds are lost.",
    "impute_median": "Fill {column} with its median; this invents values.",
    "drop_incomplete_rows": "Drop the rows without {column}.",
    "drop_outlier_rows": "Drop the rows whose {column} is far from the rest.",
    "dedupe_key": "Keep the first row of each {column}.",
}

# -- planning ---------------------------------------------------------------------------

_AUTO = {
    "whitespace": "trim_whitespace",
    "sentinel_values": "replace_sentinels",
    "numeric_format": "coerce_numeric",
    "non_numeric": "coerce_numeric",
    "inconsistent_categories": "canonicalize_case",
    "invalid_datetime": "coerce_dates",
    "date_format": "coerce_dates",
    "exact_duplicates": "drop_exact_duplicates",
}


def _once(planned: Sequence[Repair]) -> list[Repair]:
    """First of each (strategy, column), described."""
    unique: dict[tuple, Repair] = {}
    for repair in planned:
        text = DESCRIPTIONS[repair.strategy].format(column=repair.column)
        unique.setdefault((repair.strategy, repair.column), replace(repair, description=text))
    return list(unique.values())


def plan_auto(inspection: Inspection, issues: Sequence[Issue]) -> list[Repair]:
    """Repairs that invent nothing, for the issues of the raw table."""
    planned = []
    for issue in issues:
        strategy = _AUTO.get(issue.issue_type)
        if issue.issue_type == "inconsistent_categories" and is_country_name(issue.column):
            planned.append(Repair("normalize_country", issue.column, issue_id=issue.id))
        if strategy:
            target = inspection.types[issue.column] if strategy == "coerce_numeric" else None
            planned.append(Repair(strategy, issue.column, issue_id=issue.id, target_type=target))
    for cell in inspection.cells:
        if inspection.types[cell.name] == "boolean":
            planned.append(Repair("coerce_booleans", cell.name))
    return numbered(_once(planned))


def plan_review(inspection: Inspection, residual: Sequence[Issue]) -> list[Repair]:
    """Repairs for what is left, which a person has to approve (or is only told of)."""
    planned = []
    for issue in residual:
        name, serious = issue.column, issue.severity in ("high", "critical")
        inferred = inspection.types.get(name)
        numeric = inferred in ("integer", "float")
        if issue.issue_type == "negative_values" and serious:
            planned.append(Repair("absolute_value", name, "review", issue.id))
        elif issue.issue_type == "duplicate_key":
            planned.append(Repair("dedupe_key", name, "review", issue.id))
        elif issue.issue_type == "outliers" and serious:
            planned.append(Repair("drop_outlier_rows", name, "review", issue.id))
        elif issue.issue_type == "missing_values" and serious:
            if numeric or inspection.roles[name] in ("money", "quantity", "key"):
                planned.append(Repair("drop_incomplete_rows", name, "review", issue.id, inferred))
        elif issue.issue_type == "missing_values" and numeric and not is_key_name(name):
            if round(inspection.counts[name].blank / inspection.rows, 4) <= 0.2:
                planned.append(Repair("impute_median", name, "suggested", issue.id))
    return _once(planned)


def numbered(repairs: Sequence[Repair]) -> list[Repair]:
    return [replace(repair, id=f"R{number:03d}") for number, repair in enumerate(repairs, start=1)]


# -- cell repairs: SQL of (new value, changed?) -------------------------------------------

Rewrite = tuple[str, str]


def _trim(cell: Cell, _: DataFrame, repair: Repair) -> Rewrite:
    if cell.kind != "text":
        return quoted(cell.name), "false"
    value = f"CASE WHEN {cell.ref('blank')} THEN {quoted(cell.name)} ELSE {cell.ref('bare')} END"
    return value, cell.flag_sql("padded")


def _empty_sentinels(cell: Cell, _: DataFrame, repair: Repair) -> Rewrite:
    word = cell.flag_sql("sentinel")
    return f"CASE WHEN NOT {word} THEN {quoted(cell.name)} END", word


def _to_number(cell: Cell, facts: DataFrame, repair: Repair, whole: bool | None = None) -> Rewrite:
    x, bare = cell.number_sql, cell.ref("bare")
    rewritten = f"{cell.present_sql} AND ({x} IS NULL OR NOT {bare} RLIKE {pattern(PLAIN_NUMBER)})"
    if repair.target_type != "integer" or not whole:
        return x, rewritten
    # Digits beyond a double's precision are read straight from the text.
    digits = f"try_cast(translate({bare}, {text(CURRENCY_AND_SPACE)}, '') AS BIGINT)"
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce({digits}, CAST({x} AS BIGINT)) END", rewritten


def _to_country(cell: Cell, _: DataFrame, repair: Repair) -> Rewrite:
    raw, bare = quoted(cell.name), cell.ref("bare")
    if cell.kind != "text":
        return raw, "false"
    value = f"coalesce({country_of(bare, cell.rules)}, {bare})"
    return (
        f"CASE WHEN {cell.present_sql} THEN {value} ELSE {raw} END",
        f"{cell.present_sql} AND {value} != {raw}",
    )


def _to_day(cell: Cell, _: DataFrame, repair: Repair) -> Rewrite:
    if cell.kind == "time" and not cell.rules.truncate_time:
        return quoted(cell.name), "false"
    value = f"CASE WHEN {cell.present_sql} THEN {iso(cell.day_sql)} END"
    return value, f"{cell.flag_sql('not_day')} OR {cell.flag_sql('not_iso')}"


def _to_bool(cell: Cell, facts: DataFrame, repair: Repair, all_read: bool | None = None) -> Rewrite:
    truth = cell.truth_sql
    if cell.kind == "bool":
        return truth, "false"
    if all_read:
        return truth, f"{truth} IS NOT NULL"
    word = f"initcap(CAST({truth} AS STRING))"
    value = f"CASE WHEN {cell.present_sql} THEN coalesce({word}, {cell.text_sql}) END"
    return value, f"{truth} IS NOT NULL"


def _question(cell: Cell, repair: Repair) -> str | None:
    """What has to be known of the whole column before its new type is settled."""
    x = cell.number_sql
    if repair.strategy == "coerce_numeric" and repair.target_type == "integer":
        return f"bool_and({x} = rint({x}) AND abs({x}) < {double(2.0**63)})"
    if repair.strategy == "coerce_booleans" and cell.kind != "bool":
        return f"bool_and({cell.truth_sql} IS NOT NULL OR NOT {cell.present_sql})"
    return None


def _without_sign(cell: Cell, _: DataFrame, repair: Repair) -> Rewrite:
    return f"abs({cell.number_sql})", cell.flag_sql("negative")


def _quantiles(facts: DataFrame, cell: Cell, shares: Sequence[float]) -> list[float] | None:
    """Quantiles of a column as it is now; None without numbers."""
    x = cell.number
    row = facts.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).first()
    numbers = {cell.name: Numbers(x, row.n, row.low, row.high)}
    return exact_quantiles(facts, numbers, shares, cell.rules.quantile_rows_per_task).get(cell.name)


def _with_median(cell: Cell, facts: DataFrame, repair: Repair) -> Rewrite:
    middle = _quantiles(facts, cell, [0.5])
    if middle is None:
        return quoted(cell.name), "false"
    return f"coalesce({cell.number_sql}, {double(middle[0])})", f"{cell.number_sql} IS NULL"


CellRepair = Callable[..., Rewrite]
CELL_REPAIRS: dict[str, CellRepair] = {
    "trim_whitespace": _trim,
    "replace_sentinels": _empty_sentinels,
    "coerce_numeric": _to_number,
    "normalize_country": _to_country,
    "coerce_dates": _to_day,
    "coerce_booleans": _to_bool,
    "absolute_value": _without_sign,
    "impute_median": _with_median,
}


def known_answers(inspection: Inspection) -> dict[tuple[str, str], bool]:
    """Answers to the questions of ``_question`` that an inspection of the raw table holds; cell repairs
    that come earlier in the fixed order do not change them."""
    found = {}
    for cell in inspection.cells:
        counts = inspection.counts[cell.name]
        far = max(abs(counts.low or 0.0), abs(counts.high or 0.0))
        found["coerce_numeric", cell.name] = not counts.inexact and far < 2.0**63
        found["coerce_booleans", cell.name] = counts.truths == counts.present
    return found


def repair_cells(
    df: DataFrame, repairs: Sequence[Repair], rules: Rules = DEFAULT_RULES, changed: Sequence[str] = (),
    answers: dict[tuple[str, str], bool] | None = None,
) -> DataFrame:
    """Several columns rewritten in one projection, at most one repair each.

    ``changed`` names a flag column to add for each repair; ``answers`` are those of ``known_answers``.
    """
    cells = {cell.name: cell for cell in cells_of(df, rules=rules)}
    pairs = [(repair, flag) for repair, flag in zip(repairs, changed or [None] * len(repairs)) if repair.column in cells]
    facts = with_facts(df, [cells[repair.column] for repair, _ in pairs])
    asked = {repair.column: _question(cells[repair.column], repair) for repair, _ in pairs}
    known = {r.column: answers[r.strategy, r.column] for r, _ in pairs if asked[r.column] and (r.strategy, r.column) in (answers or {})}
    asked = {column: sql for column, sql in asked.items() if sql and column not in known}
    if asked:
        known |= dict(zip(asked, facts.selectExpr(*[f"coalesce({sql}, true)" for sql in asked.values()]).first()))
    made = {}
    for repair, name in pairs:
        extra = (known[repair.column],) if repair.column in known else ()
        value, flag = CELL_REPAIRS[repair.strategy](cells[repair.column], facts, repair, *extra)
        made[repair.column] = f"{value} AS {quoted(repair.column)}"
        if name:
            made[name] = f"{flag} AS {name}"
    kept = [made.pop(name, quoted(name)) for name in df.columns]
    return facts.selectExpr(*kept, *made.values())


# Spellings of one column that are written into the projection itself; longer lists are joined.
_LITERAL_SPELLINGS = 64


def canonicalize_case(
    df: DataFrame, repairs: Sequence[Repair], rules: Rules = DEFAULT_RULES, changed: Sequence[str] = (),
    counted: DataFrame | None = None,
) -> DataFrame:
    """Losing spellings of columns replaced by their winner.

    ``counted`` holds the spellings as ``(column, folded, spelling, n)`` where they are known, else they are
    counted on ``df`` now.
    """
    flags = dict(zip([repair.column for repair in repairs], changed))
    cells = [cell for cell in cells_of(df, rules=rules) if cell.kind == "text" and cell.name in {r.column for r in repairs}]
    if not cells:
        return df
    counted = whole_spellings(df, cells) if counted is None else counted.filter(F.col("column").isin([c.index for c in cells]))
    losers = with_winner(counted).filter("spelling <> winner").select("column", "spelling", "winner")
    most = len(cells) * _LITERAL_SPELLINGS
    few = losers.limit(most + 1).collect()
    if len(few) > most:
        losers = written(losers, "spellings")
    for cell in cells:
        raw = quoted(cell.name)
        running = df.withColumn("__bare", F.expr(strip(raw)))
        if len(few) <= most:
            lookup = {row.spelling: row.winner for row in few if row["column"] == cell.index}
            if not lookup:
                continue
            to = f"try_element_at({mapping(lookup)}, __bare)"
        else:
            lookup = losers.filter(F.col("column") == cell.index).selectExpr("spelling AS __from", "winner AS __to")
            lookup = F.broadcast(lookup) if may_broadcast(lookup, rules) else lookup
            running, to = running.join(lookup, F.col("__bare") == F.col("__from"), "left"), "__to"
        value = f"CASE WHEN __bare != '' THEN coalesce({to}, __bare) ELSE {raw} END AS {raw}"
        kept = [value if name == cell.name else quoted(name) for name in df.columns]
        flag = [f"{to} IS NOT NULL AS {flags[cell.name]}"] if cell.name in flags else []
        df = running.selectExpr(*kept, *flag)
    return df


def _waves(repairs: Sequence[Repair]) -> list[list[Repair]]:
    """Cell repairs in as few projections as their order per column allows."""
    waves: list[list[Repair]] = []
    depth: dict[str | None, int] = {}
    for repair in repairs:
        place = depth.get(repair.column, 0)
        depth[repair.column] = place + 1
        while len(waves) <= place:
            waves.append([])
        waves[place].append(repair)
    return waves


# -- row repairs --------------------------------------------------------------------------


def drop_incomplete(df: DataFrame, repair: Repair, rules: Rules = DEFAULT_RULES) -> DataFrame:
    (cell,) = cells_of(df, [repair.column], rules)
    numeric = repair.target_type in ("integer", "float") or cell.kind == "number"
    facts = with_facts(df, [cell])
    return without_facts(facts.filter(cell.number.isNotNull() if numeric else cell.present))


def drop_outliers(
    df: DataFrame, repair: Repair, rules: Rules = DEFAULT_RULES, fence: float | None = None
) -> DataFrame:
    """Rows outside ``fence`` (1.5 by default) interquartile ranges go; rows without a number stay."""
    width = rules.outlier_drop_fence if fence is None else fence
    (cell,) = cells_of(df, [repair.column], rules)
    facts = with_facts(df, [cell])
    if facts.filter(cell.number.isNotNull()).limit(8).count() < 8:
        return df
    q1, q3 = _quantiles(facts, cell, [0.25, 0.75])
    if q1 == q3:
        return df
    low, high = q1 - width * (q3 - q1), q3 + width * (q3 - q1)
    return without_facts(facts.filter(cell.number.isNull() | cell.number.between(low, high)))


RowRepair = Callable[[DataFrame, Repair, Rules, int], DataFrame]
ROW_REPAIRS: dict[str, RowRepair] = {
    "drop_exact_duplicates": lambda df, repair, rules, rows: drop_copies(df, rules, rows),
    "drop_incomplete_rows": lambda df, repair, rules, rows: drop_incomplete(df, repair, rules),
    "drop_outlier_rows": lambda df, repair, rules, rows: drop_outliers(df, repair, rules),
    "dedupe_key": lambda df, repair, rules, rows: keep_first(df, repair.column, rules, rows),
}


# -- running a plan -----------------------------------------------------------------------


def chosen(repairs: Sequence[Repair], include_review: bool) -> list[Repair]:
    """What may run, in the fixed order; a suggestion never does."""
    allowed = ("auto", "review") if include_review else ("auto",)
    return sorted(
        (repair for repair in repairs if repair.disposition in allowed),
        key=lambda repair: fixed.STRATEGY_ORDER.index(repair.strategy),
    )


def apply(
    df: DataFrame,
    repairs: Sequence[Repair],
    include_review: bool = False,
    rules: Rules = DEFAULT_RULES,
    rows: int | None = None,
    count: bool = True,
    write: bool = False,
    inspected: Inspection | None = None,
    target: str | None = None,
) -> tuple[DataFrame, list[Repair]]:
    """The repaired table and the plan with ``applied`` and ``rows_affected`` filled in.

    Cell changes are flagged beside the rows and summed while these are written, or else in one aggregate that
    reads only the repaired columns; dropped rows are counted while the others are written. ``rows``
    is the size of ``df`` where it is known; ``write`` asks for a written result, at ``target``
    if a path is named. ``inspected`` is an open inspection of ``df``, which saves asking again.
    """
    with short_methods(df.sparkSession):
        return _apply(df, repairs, include_review, rules, rows, count, write, inspected, target)


def _apply(
    df: DataFrame, repairs: Sequence[Repair], include_review: bool, rules: Rules, rows: int | None, count: bool,
    write: bool, inspected: Inspection | None, target: str | None,
) -> tuple[DataFrame, list[Repair]]:
    rows = df.count() if rows is None else rows
    affected: dict[tuple[str, str | None], int] = {}
    running, pending, on_disk = df, [], False
    plan = chosen(repairs, include_review)
    last = next((r for r in reversed(plan)), None)
    for repair in plan:
        affected[repair.strategy, repair.column] = 0
        if repair.strategy not in ROW_REPAIRS:
            pending.append(repair)
            continue
        if pending:
            # several row repairs, or a large one several times, will read these cells
            on_disk = include_review or rows > rules.broadcast_rows
            running = _rewrite(running, pending, rules, affected if count else None, inspected, "cells" if on_disk else None)
            pending = []
        smaller = ROW_REPAIRS[repair.strategy](running, repair, rules, rows)
        if smaller is not running:
            running, on_disk = smaller, False
            if count or write:
                seen = Observation()  # counted in the tasks that write
                counted = smaller.observe(seen, F.count(F.lit(1)).alias("left"))
                running, on_disk = written(counted, "rows", target if repair is last else None), True
                left = seen.get["left"]
                affected[repair.strategy, repair.column] = rows - left
                rows = left
                inspected = None
    if pending:
        running = _rewrite(running, pending, rules, affected if count else None, inspected, "repaired" if write else None, target)
        on_disk = write
    if write and not on_disk:
        running = written(running, "repaired", target)
    done = [
        replace(r, applied=(r.strategy, r.column) in affected, rows_affected=affected.get((r.strategy, r.column), 0))
        for r in repairs
    ]
    return running, done


def _rewrite(
    df: DataFrame, repairs: Sequence[Repair], rules: Rules, affected: dict[tuple[str, str | None], int] | None,
    inspected: Inspection | None = None, label: str | None = None, target: str | None = None,
) -> DataFrame:
    """All cell repairs of one stretch, and how many cells each changed; written if there is a ``label``."""
    running, flags = df, {}
    answers = known_answers(inspected) if inspected else None
    renamed = [r.column for r in repairs if r.strategy == "normalize_country"]
    for wave in _waves(repairs):
        plain = [repair for repair in wave if repair.strategy in CELL_REPAIRS]
        names = [f"__changed_{repair.strategy}_{df.columns.index(repair.column)}" for repair in plain]
        if plain:
            running = repair_cells(running, plain, rules, names, answers)
        cased = [repair for repair in wave if repair.strategy == "canonicalize_case"]
        if cased:
            more = [f"__changed_case_{df.columns.index(repair.column)}" for repair in cased]
            running = canonicalize_case(running, cased, rules, more, _counted_spellings(inspected, cased, renamed) if inspected else None)
            names, plain = names + more, plain + cased
        flags |= {name: (r.strategy, r.column) for name, r in zip(names, plain) if name in running.columns}
    changes = [F.expr(f"count_if(coalesce({name}, false))").alias(name) for name in flags] if affected is not None else []
    totals: dict[str, int] = {}
    if label:
        seen = Observation()  # counted in the tasks that write
        counted = running.observe(seen, *changes) if changes else running
        running = written(counted.select(*map(quoted, df.columns)), label, target)
        totals = seen.get if changes else totals
    elif changes:
        totals = running.agg(*changes).first().asDict()
    if changes:
        affected |= {key: totals[name] for name, key in flags.items()}
    return running.select(*map(quoted, df.columns))


def _counted_spellings(inspected: Inspection, repairs: Sequence[Repair], renamed: Sequence[str]) -> DataFrame | None:
    """Spellings of the columns as they are after aliases of countries got their one name; None if not all are known."""
    known = {cell.name for cell in inspected.category_cells}
    if any(repair.column not in known for repair in repairs):
        return None
    by_country = [inspected.cell(name).index for name in renamed]
    name = F.when(F.col("column").isin(by_country), F.expr(country_of("spelling", inspected.rules)))
    now = inspected.category_spellings.withColumn("spelling", F.coalesce(name, "spelling"))
    now = now.groupBy("column", "spelling").agg(F.sum("n").alias("n"))
    return now.select("column", F.expr(fold("spelling")).alias("folded"), "spelling", "n")


def repair_rows(repairs: Sequence[Repair]) -> list[dict]:
    return [asdict(repair) for repair in repairs]


