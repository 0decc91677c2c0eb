"""Names by a user's own alias table, joined rather than written into the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.cells import fold, quoted, strip
from sluice.operators.rows import may_broadcast
from sluice.rules import DEFAULT_RULES, Rules
from sluice.workspace import written


def alias_lookup(aliases: DataFrame) -> DataFrame:
    """``(alias, name)`` with folded aliases, one name each; of several names for one the first in order."""
    folded = F.expr(fold(strip("alias")))
    rows = aliases.select(folded.alias("alias"), F.expr(strip("name")).alias("name")).filter("alias <> '' AND name <> ''")
    return rows.groupBy("alias").agg(F.min("name").alias("name"))


def alias_version(lookup: DataFrame) -> str:
    """The same for the same aliases and names, in whatever order they come."""
    row = lookup.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("alias", "name").cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}-{int(row.h or 0) % (1 << 64):016x}"


def named_by(df: DataFrame, column: str, lookup: DataFrame, rules: Rules = DEFAULT_RULES, changed: str | None = None) -> DataFrame:
    """``column`` with every known alias replaced by its name, whatever its case and the space around it.

    ``lookup`` is what ``alias_lookup`` gives; it is broadcast if its rows and bytes are within the rules, and joined
    otherwise. ``changed`` names a flag column to add.
    """
    lookup = written(lookup.select(F.col("alias").alias("__alias"), F.col("name").alias("__name")), "aliases")
    lookup = F.broadcast(lookup) if may_broadcast(lookup, rules) else lookup
    raw = F.col(quoted(column))
    joined = df.join(lookup, F.expr(fold(strip(quoted(column)))) == F.col("__alias"), "left")
    kept = [F.coalesce("__name", raw).alias(column) if name == column else F.col(quoted(name)) for name in df.columns]
    flag = [F.coalesce(F.col("__name") != raw, F.lit(False)).alias(changed)] if changed else []
    return joined.select(*kept, *flag)
