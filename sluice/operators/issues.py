"""The thirteen detectors: which rows each flags, and how serious that is."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.cells import ORD, Cell, country_of
from sluice.functions.names import is_country_name
from sluice.functions.severity import severity
from sluice.functions.sqltext import quoted, text
from sluice.operators import rows, spellings
from sluice.operators.inspection import Inspection
from sluice.operators.spellings import category_examples

ISSUE_SCHEMA = """
    id string, column string, severity string, issue_type string, description string,
    row_count bigint, positions array<bigint>,
    evidence struct<tail_ratio: double, extra_rows: bigint, tokens: array<string>, examples: array<string>,
                    unit_scale: boolean, low: double, high: double, groups: bigint>
"""
POSITIONS = 40
WITH_EXAMPLES = ("numeric_format", "non_numeric", "negative_values")


@dataclass
class Issue:
    column: str | None
    severity: str
    issue_type: str
    row_count: int
    description: str
    id: str = ""
    positions: list[int] = field(default_factory=list)
    evidence: dict = field(default_factory=dict)


FLAGS = {
    "missing_values": "blank",
    "sentinel_values": "sentinel",
    "numeric_format": "decorated",
    "non_numeric": "not_number",
    "negative_values": "negative",
    "invalid_email": "not_email",
    "invalid_datetime": "not_day",
    "date_format": "not_iso",
    "whitespace": "padded",
}


def flag_sql(inspection: Inspection, cell: Cell, issue_type: str) -> str:
    """SQL test for the cells of a column that a cell-level detector flags."""
    return inspection.outlier_sql(cell) if issue_type == "outliers" else cell.flag_sql(FLAGS[issue_type])


def _cell_issues(inspection: Inspection, cell: Cell) -> list[Issue]:
    name, counts = cell.name, inspection.counts[cell.name]
    role, inferred = inspection.roles[name], inspection.types[name]
    found: list[Issue] = []

    def add(issue_type: str, count: int, level: str | None, text: str, **evidence) -> None:
        if count and level:
            found.append(Issue(name, level, issue_type, count, f"{count} cells of {name} {text}", evidence=evidence))

    def share(count: int) -> float:
        return count / max(inspection.rows, 1)

    bands = inspection.rules.missing_bands.get(role, inspection.rules.missing_bands["default"])
    add("missing_values", counts.blank, severity(share(counts.blank), bands), "hold nothing.")
    add(
        "sentinel_values",
        counts.sentinel,
        severity(share(counts.sentinel), inspection.rules.sentinel_bands),
        "hold a word that stands for no value.",
    )
    if inferred in ("integer", "float"):
        unread = counts.present - counts.numbers
        add("numeric_format", counts.decorated, "medium", "carry a currency sign or commas.")
        add("non_numeric", unread, severity(share(unread), inspection.rules.non_numeric_bands), "do not read as a number.")
        level = "high" if role in ("money", "quantity") else "medium"
        add("negative_values", counts.negative, level, "are below zero.")
        spread = inspection.outliers[name]
        add(
            "outliers",
            spread.outliers,
            "high" if spread.unit_scale else "medium",
            "lie far outside the usual range.",
            unit_scale=spread.unit_scale,
            low=None if spread.low is None else round(spread.low, 4),
            high=None if spread.high is None else round(spread.high, 4),
        )
    if inferred == "email" or role == "email":
        wrong = counts.present - counts.emails
        add("invalid_email", wrong, severity(share(wrong), inspection.rules.email_bands), "are not e-mail addresses.")
    if inferred == "datetime" or role == "date":
        wrong = counts.present - counts.days
        add("invalid_datetime", wrong, severity(share(wrong), inspection.rules.date_bands), "do not read as a date.")
        add("date_format", counts.not_iso, "low", "are dates not written as yyyy-MM-dd.")
    if category := inspection.categories.get(name):
        variants = category["variants"] or category["mixed"]
        if inspection.rules.always_normalise_country:
            variants = variants or category["aliases"]
        if variants:
            text = f"{name} spells one value in several ways."
            found.append(Issue(name, "medium", "inconsistent_categories", category["rows"], text))
    add("whitespace", counts.padded, "low", "start or end with white space.")
    return found


def _copies_issue(inspection: Inspection) -> list[Issue]:
    flagged, extra = inspection.copies
    if not extra:
        return []
    level = "critical" if extra / max(inspection.rows, 1) > 0.25 else "high"
    text = f"{extra} rows repeat an earlier row in every column."
    return [Issue(None, level, "exact_duplicates", flagged, text, evidence={"extra_rows": extra})]


def _key_issue(inspection: Inspection, key: Cell) -> list[Issue]:
    flagged, groups = inspection.key_conflicts(key)
    if not groups:
        return []
    level = "critical" if flagged / max(inspection.rows, 1) > 0.2 else "high"
    text = f"{flagged} rows share a {key.name} with a row that differs elsewhere."
    return [Issue(key.name, level, "duplicate_key", flagged, text, evidence={"groups": groups})]


def detect(inspection: Inspection, evidence: bool = True) -> list[Issue]:
    """All issues of a table, table-wide first, then column by column.

    ``evidence`` adds sentinel words, spellings and, for tables with row
    positions, the first flagged positions, examples and the tail ratio.
    """
    inspection.measure()
    if inspection.rows == 0:
        return []
    issues = _copies_issue(inspection)
    keys = {key.index for key in inspection.keys}
    for cell in inspection.cells:
        issues += _cell_issues(inspection, cell)
        if cell.index in keys:
            issues += _key_issue(inspection, cell)
    for number, issue in enumerate(issues, start=1):
        issue.id = f"Q{number:03d}"
    if evidence and issues:
        _add_words(inspection, issues)
        if inspection.ordered:
            _add_positions(inspection, issues)
    return issues


def _add_words(inspection: Inspection, issues: Sequence[Issue]) -> None:
    by_type = {(issue.column, issue.issue_type): issue for issue in issues}
    marked = [cell for cell in inspection.cells if (cell.name, "sentinel_values") in by_type]
    if marked:
        words = inspection.sentinel_words(marked)
        for cell in marked:
            by_type[cell.name, "sentinel_values"].evidence["tokens"] = words.get(cell.index, [])[:8]
    mixed = [cell for cell in inspection.category_cells if (cell.name, "inconsistent_categories") in by_type]
    if mixed:
        wanted = inspection.category_spellings.filter(F.col("column").isin([cell.index for cell in mixed]))
        shown = category_examples(wanted, mixed, inspection.rules)
        for cell in mixed:
            by_type[cell.name, "inconsistent_categories"].evidence["examples"] = shown.get(cell.index, [])


def flagged_rows(inspection: Inspection, issues: Sequence[Issue]) -> DataFrame:
    """``(label, _ord, value)``: every row each issue flags; ``label`` is its place in the list."""
    flags, frames = {}, []
    for label, issue in enumerate(issues):
        if issue.issue_type == "exact_duplicates":
            f1, f2 = rows.fingerprint(inspection.cells)
            marked = inspection.df.select(ORD, f1.alias("f1"), f2.alias("f2"))
            twice = inspection.groups.groupBy("f1", "f2").agg(F.sum("n").alias("n")).filter("n > 1")
            found = marked.join(twice, ["f1", "f2"], "left_semi")
            frames.append(found.select(F.lit(label).alias("label"), ORD, F.lit(None).cast("string").alias("value")))
            continue
        cell = inspection.cell(issue.column)
        if issue.issue_type == "duplicate_key":
            frames.append(_conflicting(inspection, cell, label))
        elif issue.issue_type == "inconsistent_categories":
            frames.append(_misspelled(inspection, cell, label))
        else:
            flags[label] = (flag_sql(inspection, cell, issue.issue_type), cell.text_sql)
    if flags:
        frames.append(rows.mark(inspection.facts([inspection.cell(issues[i].column) for i in flags]), flags))
    if not frames:
        return inspection.df.sparkSession.createDataFrame([], f"label int, {ORD} bigint, value string")
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _conflicting(inspection: Inspection, key: Cell, label: int) -> DataFrame:
    repeated = rows.repeated_keys(inspection.groups, key)
    bad = rows.conflict_tokens(repeated).filter("variants > 1").select(F.col("token").alias("bad"))
    bad_keys = repeated.join(bad, F.col("token").eqNullSafe(F.col("bad")), "left_semi")
    entries = inspection.keep(bad_keys.select(*rows.digest_of(F.col("key")), F.col("rows").alias("n")))
    values = inspection.df.select(ORD, rows.comparable(key).alias("value"))
    hits = rows.listed(values, F.col("value"), entries, inspection.rows)
    return hits.select(F.lit(label).alias("label"), ORD, F.col("value").cast("string").alias("value"))


def _misspelled(inspection: Inspection, cell: Cell, label: int) -> DataFrame:
    losers = (
        spellings.with_winner(inspection.category_spellings.filter(F.col("column") == cell.index))
        .filter("spelling <> winner")
        .select(*rows.digest_of(F.col("spelling")), "n")
    )
    alias = "false"
    if is_country_name(cell.name) or inspection.rules.alias_rows_everywhere:
        canonical = country_of(cell.ref("bare"), inspection.rules)
        alias = f"{cell.present_sql} AND coalesce({canonical} != {cell.ref('bare')}, false)"
    values = inspection.facts([cell]).select(ORD, cell.text.alias("value"), cell.bare.alias("bare"), F.expr(alias).alias("alias"))
    spelled = rows.listed(values.filter("NOT alias"), F.col("bare"), inspection.keep(losers), inspection.rows)
    hits = values.filter("alias").unionByName(spelled)
    return hits.select(F.lit(label).alias("label"), ORD, F.left("value", F.lit(80)).alias("value"))


def _add_positions(inspection: Inspection, issues: Sequence[Issue]) -> None:
    marked = inspection.keep(flagged_rows(inspection, issues))
    tails: dict[int, float] = {}
    first = rows.first_rows(marked, POSITIONS, inspection.extent, tails).collect()
    for label, tail in tails.items():
        issues[label].evidence["tail_ratio"] = tail
    for row in sorted(first, key=lambda r: (r.label, r.place)):
        issue = issues[row.label]
        issue.positions.append(row[ORD])
        if issue.issue_type in WITH_EXAMPLES and row.place <= 5:
            issue.evidence.setdefault("examples", []).append(row.value[:60])


def issue_rows(issues: Sequence[Issue]) -> list[dict]:
    return [asdict(issue) for issue in issues]


def issues_frame(inspection: Inspection, issues: Sequence[Issue]) -> DataFrame:
    return inspection.df.sparkSession.createDataFrame(issue_rows(issues), ISSUE_SCHEMA)


def violations(
    inspection: Inspection, issue_types: Sequence[str], columns: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Drill-down: ``keep`` columns, ``column``, ``issue_type`` and ``value`` of each flagged cell."""
    marks = []
    for name in columns:
        cell = inspection.cell(name)
        for issue_type in issue_types:
            found = f"struct({text(name)} AS column, '{issue_type}' AS issue_type, {cell.text_sql} AS value)"
            marks.append(f"CASE WHEN {flag_sql(inspection, cell, issue_type)} THEN {found} END")
    facts = inspection.facts([inspection.cell(name) for name in columns])
    kept = [quoted(name) for name in keep]
    long = facts.selectExpr(*kept, f"explode(array({', '.join(marks)})) AS v").filter("v IS NOT NULL")
    return long.select(*kept, "v.*")
