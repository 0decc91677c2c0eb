"""Published tables, staged extracts and the append-only records about them.

Rows are written first, under a path made from the run or review id. All records of a run, the one
that makes its table visible among them, follow as one file of a log, so a job that is lost half way
leaves nothing a reader would find and can simply run again. ``compact`` puts the log together.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import GateError
from sluice.functions.cells import ORD, data_columns, quoted
from sluice.operators.causes import CAUSE_SCHEMA
from sluice.operators.issues import ISSUE_SCHEMA
from sluice.operators.profile import PROFILE_SCHEMA
from sluice.operators.repairs import REPAIR_SCHEMA
from sluice.operators.sketches import SCHEMA as SKETCH_SCHEMA
from sluice.sources.shape import SCHEMA_REPORT

_CHECK = "array<struct<name: string, passed: boolean, detail: string>>"
_COLUMNS = "array<struct<name: string, inferred_type: string, role: string>>"
SCHEMAS = {
    "datasets": f"""id string, path string, display_name string, source_kind string, source_location string,
        row_count bigint, column_count bigint, quality_score bigint, run_id string, columns {_COLUMNS},
        created_at timestamp""",
    "runs": f"""run_id string, parent_run_id string, status string, decision string, display_name string,
        source_kind string, source_location string, rows_before bigint, rows_after bigint,
        score_before bigint, score_after bigint, checks {_CHECK}, dataset_id string, review_id string,
        preview_before array<map<string, string>>, preview_after array<map<string, string>>,
        created_at timestamp""",
    "review_events": """id string, run_id string, status string, staged_path string, dataset_id string,
        created_at timestamp""",
    "issues": f"run_id string, stage string, {ISSUE_SCHEMA}",
    "causes": f"run_id string, {CAUSE_SCHEMA}",
    "repairs": f"run_id string, {REPAIR_SCHEMA}",
    "columns": f"run_id string, {SCHEMA_REPORT}",
    "profiles": f"run_id string, {PROFILE_SCHEMA}",
}


def new_id() -> str:
    return uuid.uuid4().hex[:12]


def now() -> datetime:
    return datetime.now(timezone.utc)


class Store:
    """A folder on shared storage with ``published``, ``staging`` and the log of ``records``.

    A row of the log has a kind, the key it was written under, the time, and one struct per kind.
    What is written under a key again replaces what it said before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- the log --------------------------------------------------------------------------
    def _folder(self, path: str):
        """Hadoop's view of a path: the file system and the path."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _remove(self, path: str) -> None:
        system, at = self._folder(path)
        system.delete(at, True)

    def _generation(self) -> int | None:
        """The newest part of the log that is whole; None before the first record."""
        system, at = self._folder(f"{self.root}/records")
        if not system.exists(at):
            return None
        found = [int(s.getPath().getName()[4:]) for s in system.listStatus(at) if s.getPath().getName().startswith("gen-")]
        whole = [n for n in found if not n or system.exists(self._folder(f"{self.root}/records/gen-{n}/compacted/_SUCCESS")[1])]
        return max(whole, default=None)

    def _log(self, *kinds: str) -> DataFrame | None:
        newest = self._generation()
        if newest is None:
            return None
        schema = "kind string, key string, at timestamp" + "".join(f", {kind} struct<{_fields(kind)}>" for kind in kinds)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/records/gen-{newest}")
        if newest:  # a key may have been written again since it was compacted
            last = rows.groupBy("key").agg(F.max("at").alias("at"))
            rows = rows.join(last, ["key", "at"], "left_semi")
        return rows.filter(F.col("kind").isin(*kinds))

    def records(self, kind: str) -> DataFrame:
        """All records of a kind so far."""
        rows = self._log(kind)
        return self.spark.createDataFrame([], SCHEMAS[kind]) if rows is None else rows.select(f"{kind}.*")

    def record(self, key: str, rows: Mapping[str, Sequence[dict]]) -> None:
        """Records of several kinds under one key, as one file."""
        at, kinds = now(), [kind for kind, found in rows.items() if found]
        if not kinds:
            return
        schema = "kind string, key string, at timestamp" + "".join(f", {kind} struct<{_fields(kind)}>" for kind in kinds)
        whole = [{"kind": kind, "key": key, "at": at, kind: row} for kind in kinds for row in rows[kind]]
        df = self.spark.createDataFrame(whole, schema).coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.root}/records/gen-{self._generation() or 0}/log/{key}")

    def compact(self) -> int:
        """The log so far as one sorted table; returns how many records it has. Not while runs are recorded."""
        newest = self._generation()
        if newest is None:
            return 0
        rows = self._log(*SCHEMAS).sort("kind", "at", "key")
        rows.write.mode("overwrite").parquet(f"{self.root}/records/gen-{newest + 1}/compacted")
        self._remove(f"{self.root}/records/gen-{newest}")
        return self._log(*SCHEMAS).count()

    def of_run(self, run_id: str) -> tuple[dict | None, dict | None]:
        """The dataset and the first event of the review that a run led to before, if it did."""
        rows = self._log("datasets", "review_events")
        if rows is None:
            return None, None
        mine = (F.col("datasets.id") == run_id) | ((F.col("review_events.run_id") == run_id) & (F.col("review_events.status") == "pending"))
        found = {row.kind: row[row.kind].asDict(recursive=True) for row in rows.filter(mine).collect()}
        return found.get("datasets"), found.get("review_events")

    # -- published tables -----------------------------------------------------------------
    def published(self, dataset_id: str) -> str:
        return f"{self.root}/published/{dataset_id}"

    def write_rows(self, df: DataFrame, path: str) -> None:
        """Rows of a table that no record points to yet."""
        rows = df.select(*map(quoted, data_columns(df)), *([ORD] if ORD in df.columns else []))
        rows.write.mode("overwrite").parquet(path)

    def drop_rows(self, dataset_id: str) -> None:
        """Rows that were written for a run which then failed."""
        self._remove(self.published(dataset_id))

    def dataset(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(self._dataset(dataset_id).path)

    def dataset_schema(self, dataset_id: str) -> list[dict]:
        return [column.asDict() for column in self._dataset(dataset_id).columns]

    def _dataset(self, dataset_id: str):
        row = self.records("datasets").filter(F.col("id") == dataset_id).first()
        if row is None:
            raise GateError(f"no dataset {dataset_id!r}")
        return row

    # -- sketches -------------------------------------------------------------------------
    def write_sketches(self, sketches: DataFrame, run_id: str) -> None:
        """The column sketches of a run's extract, a few kilobytes a column."""
        sketches.write.mode("overwrite").parquet(f"{self.root}/sketches/{run_id}")

    def sketches(self, *run_ids: str) -> DataFrame:
        """The sketches of the extracts of several runs, below each other."""
        return self.spark.read.schema(SKETCH_SCHEMA).parquet(*[f"{self.root}/sketches/{run_id}" for run_id in run_ids])

    # -- reviews --------------------------------------------------------------------------
    def hold(self, df: DataFrame, run_id: str) -> dict:
        """The extract as it came, for a person to decide on; the event that says so."""
        path = f"{self.root}/staging/r{run_id}"
        df.write.mode("overwrite").parquet(path)
        return self.event(f"r{run_id}", run_id, "pending", path)

    def event(self, review_id: str, run_id: str, status: str, path: str, dataset_id: str | None = None) -> dict:
        event = {"id": review_id, "run_id": run_id, "status": status, "staged_path": path}
        return event | {"dataset_id": dataset_id, "created_at": now()}

    def review(self, review_id: str):
        """Latest event of a review, which must be pending."""
        event = (
            self.records("review_events").filter(F.col("id") == review_id).orderBy(F.desc("created_at")).first()
        )
        if event is None:
            raise GateError(f"no review {review_id!r}")
        if event.status != "pending":
            raise GateError(f"review {review_id} is already {event.status}")
        return event

    def staged(self, review_id: str) -> DataFrame:
        return self.spark.read.parquet(self.review(review_id).staged_path)

    def discard(self, review_id: str) -> None:
        """Reject a review and empty its staging area."""
        event = self.review(review_id)
        schema = self.spark.read.parquet(event.staged_path).schema
        self.record(f"{review_id}-rejected", {"review_events": [self.event(review_id, event.run_id, "rejected", event.staged_path)]})
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(event.staged_path)


def _fields(kind: str) -> str:
    """The schema of a kind as the fields of a struct."""
    return T._parse_datatype_string(SCHEMAS[kind]).simpleString()[len("struct<") : -1]


def files_mark(spark: SparkSession, location: str) -> tuple[int, int]:
    """How many Parquet files a location has, and a hash of their names, sizes and times: it changes when they do."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(location)
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)
