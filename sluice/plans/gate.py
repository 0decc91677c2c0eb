"""The write-audit-publish gate: inspect, repair what is safe, publish or hold."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.errors import GateError
from sluice.functions.cells import ORD
from sluice.operators import ask as questions
from sluice.operators import history
from sluice.operators.aliases import alias_lookup, alias_version, named_by
from sluice.operators.causes import Cause, explain
from sluice.operators.inspection import Inspection
from sluice.operators.issues import Issue, detect, issue_rows
from sluice.operators.profile import profile_rows
from sluice.operators.repairs import Repair, apply, numbered, plan_auto, plan_review, repair_rows
from sluice.operators.sketches import merged, sketch, sketched_profile
from sluice.operators.validation import Validation, score_of, validate
from sluice.plans.store import Store, files_mark, new_id, now
from sluice.rules import DEFAULT_RULES, Rules
from sluice.sources.positions import with_positions
from sluice.sources.readers import Source, read, require_rows
from sluice.sources.shape import renamed, schema_report
from sluice.workspace import written


@dataclass
class Audit:
    """What an inspection and the safe repairs found; ``repaired`` is written out."""

    rows_before: int
    rows_after: int
    profile: list[dict]
    issues: list[Issue]
    causes: list[Cause]
    repairs: list[Repair]
    residual: list[Issue]
    validation: Validation
    schema: list[dict]
    repaired: DataFrame


@dataclass
class Outcome:
    """The answer to a run, an approval or a rejection."""

    run_id: str
    status: str
    decision: str
    dataset_id: str | None = None
    review_id: str | None = None
    audit: Audit | None = None
    validation: Validation | None = None
    repairs: list[Repair] = field(default_factory=list)
    rows_after: int = 0


def audit(df: DataFrame, rules: Rules = DEFAULT_RULES, detail: bool = True, target: str | None = None) -> Audit:
    """Profile, detect, explain, repair, look again and decide; nothing is published.

    ``detail=False`` leaves out the parts of the profile and the evidence that no
    decision depends on. Repaired rows are written once, at ``target`` if a path is named.
    """
    with Inspection(df, rules) as before:
        before.measure()
        profile = profile_rows(before, detail)
        issues = detect(before, evidence=detail)
        planned = plan_auto(before, issues)
        rows_before = before.rows
        repaired, applied = df, planned
        if planned:
            repaired, applied = apply(
                before.df, planned, rules=rules, rows=before.rows, count=detail, write=True, inspected=before, target=target
            )
    if planned:
        with Inspection(repaired, rules, extent=rows_before, spread=False) as after:
            residual = detect(after, evidence=detail)
            review = plan_review(after, residual)
            rows_after, schema = after.rows, after.schema
    else:  # nothing was changed, so nothing has to be measured again
        residual, rows_after, schema = issues, rows_before, before.schema
        review = plan_review(before, residual)
    validation = validate(rows_before, rows_after, len(schema), residual, score_of(issues), rules)
    return Audit(
        rows_before,
        rows_after,
        profile,
        issues,
        explain(issues),
        numbered([*applied, *review]),
        residual,
        validation,
        schema,
        repaired,
    )


class Gate:
    """Runs, reviews and questions over one store."""

    def __init__(self, spark: SparkSession, root: str, rules: Rules = DEFAULT_RULES):
        self.spark, self.rules = spark, rules
        self.store = Store(spark, root)

    # -- runs -----------------------------------------------------------------------------
    def run(self, source: Source, run_id: str | None = None, detail: bool = True) -> Outcome:
        """Read a source and publish it, or hold it for review.

        A Parquet source is read several times; if its files change before the rows are published, the run ends.
        """
        parquet = source.kind.lower().strip() == "parquet"
        df = read(self.spark, source)
        mark = files_mark(self.spark, source.location) if parquet else None
        return self._run(df, source, run_id, detail, mark)

    def run_table(
        self, df: DataFrame, source: Source, run_id: str | None = None, detail: bool = True,
        aliases: Mapping[str, str] | None = None,
    ) -> Outcome:
        """The same for a DataFrame that is already there; a column ``_ord`` of it is the row position.

        ``aliases``: for columns (by their safe names), the version of an alias table of ``save_aliases``.
        """
        return self._run(df, source, run_id, detail, aliases=aliases)

    def save_aliases(self, aliases: DataFrame) -> str:
        """Keep a table ``(alias, name)`` in the store; returns its version."""
        lookup = written(alias_lookup(aliases), "lookup")
        version = alias_version(lookup)
        lookup.write.mode("overwrite").parquet(f"{self.store.root}/aliases/{version}")
        return version

    def _named(self, df: DataFrame, aliases: Mapping[str, str] | None) -> tuple[DataFrame, list[Repair]]:
        """``df`` with the names of alias tables, and what that changed: the run's record has the version."""
        done = []
        for column, version in (aliases or {}).items():
            lookup = self.spark.read.parquet(f"{self.store.root}/aliases/{version}")
            marked = written(named_by(df, column, lookup, self.rules, "__changed"), "named")
            text = f"Give the aliases in {column} their names by alias table {version}."
            df, n = marked.drop("__changed"), marked.agg(F.count_if("__changed")).first()[0]
            done.append(Repair("alias_table", column, description=text, applied=True, rows_affected=n))
        return df, done

    def _run(
        self, df: DataFrame, source: Source, run_id: str | None, detail: bool, mark: tuple[int, int] | None = None,
        aliases: Mapping[str, str] | None = None,
    ) -> Outcome:
        extract, run_id = require_rows(with_positions(df)), run_id or new_id()
        df, named = self._named(renamed(extract), aliases)
        dataset, event = self.store.of_run(run_id)  # what the run led to before, if it is repeated
        path, published = self.store.published(run_id), dataset is not None
        found = audit(df, self.rules, detail, target=None if published else path)
        changed = any(repair.applied for repair in found.repairs)
        found.repairs = numbered([*named, *found.repairs])
        outcome = Outcome(run_id, "fail", "rollback", audit=found, validation=found.validation)
        outcome.repairs, outcome.rows_after = found.repairs, found.rows_after
        if found.validation.passed:
            outcome.status, outcome.decision, outcome.dataset_id = "pass", "store", run_id
            if not published and not changed:
                self.store.write_rows(df, path)
            dataset = dataset or self._facts(source, found, run_id)
        else:
            event = event or self.store.hold(df, run_id)
            outcome.review_id, dataset = event["id"], None
        if mark and files_mark(self.spark, source.location) != mark:
            raise GateError(f"the files of {source.location} changed during the run")
        if self.rules.approximate:
            self.store.write_sketches(sketch(df, self.rules), run_id)
        columns = schema_report(extract, found.rows_before if detail else None, examples=detail)
        self._record(df, source, found, outcome, dataset=dataset, event=None if dataset else event, columns=columns)
        if changed and not found.validation.passed and not published:
            self.store.drop_rows(run_id)  # what was repaired has been looked at, and nothing points to it
        return outcome

    def _facts(self, source: Source, found: Audit, run_id: str) -> dict:
        return {
            "id": run_id,
            "path": self.store.published(run_id),
            "run_id": run_id,
            "display_name": source.display_name,
            "source_kind": source.kind,
            "source_location": source.location,
            "row_count": found.rows_after,
            "column_count": len(found.schema),
            "quality_score": found.validation.score_after,
            "columns": found.schema,
            "created_at": now(),
        }

    def _record(
        self, df: DataFrame, source: Source, found: Audit, outcome: Outcome, parent: str | None = None,
        dataset: dict | None = None, event: dict | None = None, columns: list[dict] | None = None,
    ) -> None:
        """All about a run in one file: it is listed, and its table found, once everything is there."""
        run_id = outcome.run_id
        tag = {"run_id": run_id}
        stages = [("before", found.issues), ("after", found.residual)]
        run = {
            "run_id": run_id,
            "parent_run_id": parent,
            "status": outcome.status,
            "decision": outcome.decision,
            "display_name": source.display_name,
            "source_kind": source.kind,
            "source_location": source.location,
            "rows_before": found.rows_before,
            "rows_after": found.rows_after,
            "score_before": found.validation.score_before,
            "score_after": found.validation.score_after,
            "checks": [asdict(check) for check in found.validation.checks],
            "dataset_id": outcome.dataset_id,
            "review_id": outcome.review_id,
            "preview_before": _preview(df),
            "preview_after": _preview(found.repaired),
            "created_at": now(),
        }
        records = {
            "columns": [tag | row for row in columns or []],
            "profiles": [tag | row for row in found.profile],
            "issues": [tag | {"stage": stage} | row for stage, rows in stages for row in issue_rows(rows)],
            "causes": [tag | asdict(cause) for cause in found.causes],
            "repairs": [tag | row for row in repair_rows(found.repairs)],
            "runs": [run],
            "datasets": [dataset] if dataset else [],
            "review_events": [event] if event else [],
        }
        self.store.record(run_id, records)

    # -- reviews --------------------------------------------------------------------------
    def approve(self, review_id: str) -> Outcome:
        """Run the reviewed repairs too; publish if the result passes, else leave all as it is."""
        event = self.store.review(review_id)
        run = self.store.records("runs").filter(F.col("run_id") == event.run_id).first()
        rows = self.store.records("repairs").filter(F.col("run_id") == event.run_id).orderBy("id").collect()
        fields = list(Repair.__dataclass_fields__)
        plan = [Repair(**{name: row[name] for name in fields}) for row in rows if row.strategy != "alias_table"]  # staged rows have it
        staged = self.store.staged(review_id)
        run_id = f"a{event.run_id}"
        path = self.store.published(run_id)
        repaired, applied = apply(
            staged, plan, include_review=True, rules=self.rules, rows=run.rows_before, write=True, target=path
        )
        with Inspection(repaired, self.rules, extent=run.rows_before, spread=False) as after:
            residual = detect(after)
            profile = profile_rows(after)
            rows_after, schema = after.rows, after.schema
        decision = validate(run.rows_before, rows_after, len(schema), residual, run.score_before, self.rules)
        outcome = Outcome(run_id, "fail", "rollback", None, review_id, None, decision, applied, rows_after)
        if not decision.passed:
            self.store.drop_rows(run_id)
            return outcome
        source = Source(run.source_kind, run.source_location, name=run.display_name)
        issues = self._issues(event.run_id)
        found = Audit(
            run.rows_before, rows_after, profile, issues, explain(issues), applied, residual, decision, schema, repaired
        )
        outcome.status, outcome.decision, outcome.audit = "pass", "store", found
        outcome.dataset_id = run_id
        done = self.store.event(review_id, event.run_id, "approved", event.staged_path, run_id)
        self._record(staged, source, found, outcome, event.run_id, self._facts(source, found, run_id), done)
        return outcome

    def _issues(self, run_id: str) -> list[Issue]:
        rows = self.store.records("issues").filter((F.col("run_id") == run_id) & (F.col("stage") == "before"))
        found = []
        for row in rows.orderBy("id").collect():
            values = row.asDict(recursive=True)
            values["evidence"] = {k: v for k, v in (values["evidence"] or {}).items() if v is not None}
            found.append(Issue(**{name: values[name] for name in Issue.__dataclass_fields__}))
        return found

    def reject(self, review_id: str) -> Outcome:
        event = self.store.review(review_id)
        self.store.discard(review_id)
        return Outcome(event.run_id, "rejected", "rollback", review_id=review_id)

    # -- questions ------------------------------------------------------------------------
    def ask(self, dataset_id: str | None = None, mentioned: str | None = None, **question) -> DataFrame:
        """One of the fixed questions, of a dataset by id, by mentioned name, or the newest."""
        if dataset_id is None:
            chosen = history.choose_dataset(self.store.records("datasets"), mentioned).first()
            if chosen is None:
                raise GateError("nothing is published yet")
            dataset_id = chosen.id
        table, schema = self.store.dataset(dataset_id), self.store.dataset_schema(dataset_id)
        return questions.ask(table, schema=schema, **question)

    def sketched_profile(self, *run_ids: str) -> DataFrame:
        """One approximate profile of the extracts of several runs under approximate rules, without reading them."""
        return sketched_profile(merged(self.store.sketches(*run_ids)))

    def preview(self, dataset_id: str, limit: int = 20) -> DataFrame:
        return questions.preview(self.store.dataset(dataset_id), limit)


def _preview(df: DataFrame, size: int = 8, near: int = 1000) -> list[dict[str, str]]:
    """The first rows; looked for among the first positions before all rows are ordered."""
    found = questions.short_preview(df.filter(F.col(ORD) < near), size).collect()
    if len(found) < size:
        found = questions.short_preview(df, size).collect()
    return [row.asDict() for row in found]
