"""Exact quantiles without ever holding a large column in one task.

``percentile`` keeps every distinct value of a column in one reducer. Here the
interval known to hold a wanted rank is cut into equal blocks, one scan counts
the rows per block (a few thousand small groups, combined before the shuffle),
and only the block holding the rank stays in play, shrunk to its smallest and
largest value. Evenly spread values lose a factor of 4096 per scan, so 10^12 rows
need three; what is left, at most ``rows_per_task``, is ordered in one buffer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.sqltext import double

_BLOCKS = 4096
_BRACKETS_PER_JOB = 48


@dataclass
class Numbers:
    """A numeric expression with the count and range of its non-null values."""

    value: Column | int  # or the label under which the values stand, grouped, in a frame of their own
    rows: int
    low: float | None
    high: float | None


@dataclass
class _Target:
    """One wanted rank; its value lies in [low, high], as ``rows`` values do."""

    column: str
    rank: int
    rows: int
    low: float
    high: float
    below: int = 0

    @property
    def bracket(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high


def _by_bracket(targets: Sequence[_Target]) -> list[list[_Target]]:
    groups: dict[tuple, list[_Target]] = {}
    for target in targets:
        groups.setdefault(target.bracket, []).append(target)
    return list(groups.values())


def _in_play(
    df: DataFrame, numbers: Mapping[str, Numbers], brackets: Sequence[list[_Target]], block: bool, grouped: DataFrame | None
) -> DataFrame:
    """``(label, x, n[, block])`` of the values inside a bracket; ``label`` is its place in the list.

    The brackets of a column do not overlap, so a value is in one of them at most.
    """
    by_column: dict[str, list[tuple[int, _Target]]] = {}
    for label, (first, *_) in enumerate(brackets):
        by_column.setdefault(first.column, []).append((label, first))
    values, structs = [], []
    counted: dict[str, list[str]] = {"label": [], "block": []}
    for place, (name, members) in enumerate(by_column.items()):
        value = numbers[name].value
        before = isinstance(value, int)
        x, of_column = ("x", f"column = {value} AND ") if before else (f"__x{place}", "")
        labels, blocks = (counted["label"], counted["block"]) if before else ([], [])
        for label, bracket in members:
            inside = f"WHEN {of_column}{x} BETWEEN {double(bracket.low)} AND {double(bracket.high)} THEN"
            width = max(bracket.high / _BLOCKS - bracket.low / _BLOCKS, math.ulp(0.0))  # tiny ranges have few values
            labels.append(f"{inside} {label}")
            offset = f"floor(({x} - {double(bracket.low)}) / {double(width)})"
            blocks.append(f"{inside} CAST(least({offset}, {_BLOCKS - 1}) AS INT)")
        if not before:
            values.append(value.alias(x))
            fields = f"CASE {' '.join(labels)} END AS label, {x} AS x, 1L AS n"
            fields += f", CASE {' '.join(blocks)} END AS block" if block else ""
            structs.append(f"struct({fields})")
    frames = []
    if structs:
        frames.append(df.select(*values).selectExpr(f"explode(array({', '.join(structs)})) AS v").selectExpr("v.*"))
    if counted["label"]:
        fields = [f"CASE {' '.join(cases)} END AS {what}" for what, cases in counted.items() if block or what == "label"]
        frames.append(grouped.selectExpr("x", "n", *fields))
    whole = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return whole.filter("label IS NOT NULL")


def _narrow(
    df: DataFrame, numbers: Mapping[str, Numbers], brackets: Sequence[list[_Target]], grouped: DataFrame | None
) -> None:
    counted = (
        _in_play(df, numbers, brackets, True, grouped)
        .groupBy("label", "block")
        .agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        .collect()
    )
    blocks: dict[int, list] = {}
    for row in sorted(counted, key=lambda r: (r.label, r.low)):
        blocks.setdefault(row.label, []).append(row)
    for label, members in enumerate(brackets):
        for target in members:
            below = target.below
            for row in blocks[label]:
                if target.rank < below + row.n:
                    target.low, target.high, target.rows, target.below = row.low, row.high, row.n, below
                    break
                below += row.n


def _settle(
    df: DataFrame, numbers: Mapping[str, Numbers], brackets: Sequence[list[_Target]], grouped: DataFrame | None
) -> None:
    """Order the values left in each bracket, which are few, and take the wanted ranks."""
    wanted = ", ".join(
        f"{label}, array({', '.join(str(t.rank - t.below) for t in members)})" for label, members in enumerate(brackets)
    )
    inside = _in_play(df, numbers, brackets, False, grouped).selectExpr("label", "explode(array_repeat(x, CAST(n AS INT))) AS x")
    values = inside.groupBy("label").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    picked = values.selectExpr("label", f"transform(element_at(map({wanted}), label), r -> get(xs, r)) AS found")
    for row in picked.collect():
        for target, x in zip(brackets[row.label], row.found):
            target.low = target.high = x


def exact_quantiles(
    df: DataFrame, numbers: Mapping[str, Numbers], shares: Sequence[float], rows_per_task: int,
    grouped: DataFrame | None = None,
) -> dict[str, list[float]]:
    """Linear-interpolation quantiles of each numeric expression; empty columns are left out.

    ``grouped`` holds, as ``(column, x, n)``, values that were counted before: those of numbers named by a label.
    """
    targets: dict[tuple[str, int], _Target] = {}
    for name, column in numbers.items():
        for share in shares if column.rows else ():
            position = share * (column.rows - 1)
            for rank in {math.floor(position), math.ceil(position)}:
                targets[name, rank] = _Target(name, rank, column.rows, float(column.low), float(column.high))

    for too_many, step in ((rows_per_task, _narrow), (0, _settle)):
        while brackets := _by_bracket(
            [t for t in targets.values() if t.low != t.high and t.rows > too_many]
        ):
            for start in range(0, len(brackets), _BRACKETS_PER_JOB):
                step(df, numbers, brackets[start : start + _BRACKETS_PER_JOB], grouped)

    answer = {}
    for name, column in numbers.items():
        if not column.rows:
            continue
        answer[name] = []
        for share in shares:
            position = share * (column.rows - 1)
            low, high = targets[name, math.floor(position)].low, targets[name, math.ceil(position)].low
            answer[name].append(low + (high - low) * (position - math.floor(position)))
    return answer


def approximate_quantiles(
    df: DataFrame, numbers: Mapping[str, Numbers], shares: Sequence[float]
) -> dict[str, list[float]]:
    """One-pass sketch quantiles, for callers that chose approximate rules."""
    filled = {name: column for name, column in numbers.items() if column.rows}
    if not filled:
        return {}
    sketches = [F.approx_percentile(column.value, list(shares), 10_000).alias(n) for n, column in filled.items()]
    row = df.agg(*sketches).first()
    return {name: [float(value) for value in row[name]] for name in filled}
