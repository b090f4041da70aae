"""The whole run of a dataset: land, profile, stage, build marts, check, watch row counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from tidemill.functions.names import quoted
from tidemill.operators import checks as data_checks
from tidemill.operators import monitoring
from tidemill.operators.checks import Check
from tidemill.operators.profiling import profile_tables
from tidemill.operators.relationships import infer_relationships
from tidemill.plans.staging import staging_select
from tidemill.sinks.documents import save_profile_document
from tidemill.sinks.landing import Dataset, land_dataset, remove_old_versions, save_table
from tidemill.sinks.models import save_view
from tidemill.session import stage

# A mart is built from the tables and views of the layers before it, by name.
Mart = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass
class Plan:
    """What to build: staging views as SQL, marts as functions, and the checks on any of them.

    A raw table that no staging view is declared for gets ``stg_<table>``, a plain rename.
    ``{raw}`` and ``{staging}`` in the SQL stand for the databases. ``state`` is the folder that
    keeps row counts from run to run. ``document`` is the folder of the profile document, if one is wanted.
    Once a run is done, versions of its tables from before the last one are removed.
    """

    dataset: Dataset
    staging: Mapping[str, str] = field(default_factory=dict)
    marts: Mapping[str, Mart] = field(default_factory=dict)
    checks: Sequence[Check] = ()
    state: str | None = None
    document: str | None = None


@dataclass
class Report:
    landed: dict[str, int]
    profile: DataFrame
    relationships: DataFrame
    checks: DataFrame
    counts: DataFrame
    drift: DataFrame | None
    examples: dict[str, list[Row]]

    @property
    def passed(self) -> bool:
        return self.checks.where("status <> 'pass'").isEmpty()


def operate(spark: SparkSession, plan: Plan, run_id: str) -> Report:
    """Run all of it. ``run_id`` sorts after those of earlier runs, a timestamp for instance."""
    layers = plan.dataset.layers.create(spark)
    landed = land_dataset(spark, plan.dataset)
    tables = {t: spark.table(f"{quoted(layers.raw)}.{quoted(t)}") for t in landed}
    profile = stage(profile_tables(tables), "profile")

    views = {f"stg_{t}": staging_select(tables[t].columns, f"{layers.raw}.{t}") for t in landed}
    for name, sql in {**views, **plan.staging}.items():
        save_view(spark, layers.staging, name, sql.format(raw=quoted(layers.raw), staging=quoted(layers.staging)))
        tables[name] = spark.table(f"{quoted(layers.staging)}.{quoted(name)}")
    for name, build in plan.marts.items():
        save_table(build(tables), layers.marts, name)
        tables[name] = spark.table(f"{quoted(layers.marts)}.{quoted(name)}")

    report = stage(data_checks.run_checks(spark, plan.checks, tables), "checks")
    failed = {r["name"] for r in report.where("status = 'fail'").select("name").collect()}
    examples = {c.name: data_checks.failing_rows(c, tables, limit=5).collect() for c in plan.checks if c.name in failed}

    counts = stage(monitoring.rowcount_snapshot(spark, layers.databases), "counts")
    drift = None
    if plan.state:
        previous = monitoring.previous_snapshot(spark, plan.state, run_id)
        drift = None if previous is None else monitoring.rowcount_drift(previous, counts)
        monitoring.save_snapshot(counts, plan.state, run_id)
    relationships = infer_relationships(profile)
    if plan.document:
        save_profile_document(profile, relationships, plan.document)
    for db, names in ((layers.raw, landed), (layers.marts, plan.marts)):
        for name in names:
            remove_old_versions(spark, db, name)
    return Report(landed, profile, relationships, report, counts, drift, examples)
