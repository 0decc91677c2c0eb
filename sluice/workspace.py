"""Where intermediate tables are written: the checkpoint folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sluice.errors import GateError

_SETTING = "spark.checkpoint.dir"
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_COMPILED_BYTES = 8000  # the JVM interprets a longer method, however often it runs


def workspace(spark: SparkSession) -> str:
    """The shared folder of this session; a scratch one only in local mode."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise GateError(f"set {_SETTING} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sluice-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` written out and read back: short lineage that outlives executors.

    Into a folder of its own, or over what an earlier try left at ``path``.
    """
    mode = "overwrite" if path else "error"
    path = path or f"{workspace(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scanned(df: DataFrame) -> bool:
    """Whether reading ``df`` again only reads files again: nothing but columns of one scan, under any name."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1:
        expressions = node.expressions()
        plain = all(_is_column(expressions.apply(i)) for i in range(expressions.size()))
        if node.nodeName() != "Project" or not plain:
            return False
        node = node.children().head()
    return node.children().isEmpty()


def _is_column(expression) -> bool:
    if expression.nodeName() == "Alias":
        expression = expression.child()
    return expression.children().isEmpty()


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Rows of many rules go through code that Spark cuts into pieces, where in one piece the JVM would interpret it.

    The session's own limit is back in place afterwards, and a smaller one is left alone.
    """
    before = spark.conf.get(_METHOD_LIMIT)
    if int(before) <= _COMPILED_BYTES:
        yield
        return
    spark.conf.set(_METHOD_LIMIT, str(_COMPILED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_METHOD_LIMIT, before)
