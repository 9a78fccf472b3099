"""Catalog of datasets, profiles, splits and audits, kept as append-only Parquet tables.

Nothing is updated in place: every run adds rows with a time, and reading takes the latest. The
tables hold one row per dataset or run, so they stay small whatever the size of the data.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.features import FeaturePipeline, Step, fit_features
from tablewright.operators.leakage import FittedOn, audit, highest_severity
from tablewright.operators.profile import profile
from tablewright.operators.split import split_files
from tablewright.plans.options import AuditOptions, ProfileOptions
from tablewright.plans.split_plan import SPLIT_NAMES, SplitPlan
from tablewright.sources.tables import format_of, path_exists, path_size, read, schema_report

SCHEMAS = {
    "datasets": "id string, name string, source_uri string, format string, size_bytes bigint, "
    "row_count_estimate bigint, inferred_schema string, version int, parent_dataset_id string, "
    "created_at timestamp_ntz, reader_options map<string,string>",
    "profiles": "id string, dataset_id string, row_count bigint, column_count int, "
    "summary string, created_at timestamp_ntz",
    "split_configs": "id string, dataset_id string, strategy string, params map<string,string>, "
    "row_counts map<string,bigint>, train_dataset_id string, val_dataset_id string, "
    "test_dataset_id string, created_at timestamp_ntz",
    "feature_pipelines": "id string, name string, version int, dataset_id string, split_config_id string, "
    "steps string, folder string, created_at timestamp_ntz",
    "leakage_reports": "id string, split_config_id string, target_column string, "
    "checks array<struct<position:int,check:string,title:string,severity:string,message:string,"
    "columns:array<string>,details:map<string,string>>>, highest_severity string, "
    "created_at timestamp_ntz",
}


class NotFoundError(LookupError):
    """No such dataset, split, profile or report."""


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _reader_options(recorded: dict[str, str] | None) -> dict:
    """Arguments of `read` from what the catalog has recorded."""
    recorded = recorded or {}
    options: dict = {"sep": recorded["sep"]} if "sep" in recorded else {}
    if "multi_line" in recorded:
        options["multi_line"] = recorded["multi_line"] == "true"
    return options


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # Tables

    def table(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(path)

    def _append(self, table: str, /, **values) -> str:
        row = {"id": str(uuid.uuid4()), **values}
        row["created_at"] = _now()
        self._append_rows(table, [row])
        return row["id"]

    def _append_rows(self, name: str, rows: list[dict]) -> None:
        columns = [c.name for c in self.table(name).schema]
        frame = self.spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], SCHEMAS[name])
        frame.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _one(self, df: DataFrame, what: str) -> Row:
        row = df.first()
        if row is None:
            raise NotFoundError(what)
        return row

    # Datasets

    def register(
        self,
        path: str,
        name: str | None = None,
        parent_id: str | None = None,
        sep: str = ",",
        multi_line: bool = False,
    ) -> str:
        """Register a file; whatever is wrong with it shows before anything is written. How it has
        to be read is recorded, and every later step reads it so."""
        dataset_id, now = str(uuid.uuid4()), _now()
        fmt = format_of(path)
        options = {"sep": sep, "multi_line": str(multi_line).lower()} if fmt == "csv" else {}
        row = self._described(
            dataset_id, path, name or path.rsplit("/", 1)[-1], parent_id, now, options, fmt
        )
        self._append_rows("datasets", [row])
        return dataset_id

    def _described(
        self,
        dataset_id: str,
        path: str,
        name: str,
        parent_id: str | None,
        now: datetime,
        options: dict[str, str],
        fmt: str | None,
    ) -> dict:
        df = read(self.spark, path, fmt, **_reader_options(options))
        report = schema_report(df).orderBy("position").collect()  # one row per column
        return {
            "id": dataset_id,
            "name": name,
            "source_uri": path,
            "format": fmt,
            "size_bytes": path_size(self.spark, path),
            "row_count_estimate": report[0]["row_count"] if report else df.count(),
            "inferred_schema": json.dumps(
                {"columns": [
                    {"name": r["name"], "dtype": r["dtype"], "null_count": r["null_count"]}
                    for r in report
                ]}
            ),
            "version": 1,
            "parent_dataset_id": parent_id,
            "created_at": now,
            "reader_options": options,
        }

    def datasets(self) -> DataFrame:
        """Newest first. The row count is that of the latest profile, where there is one."""
        counted = (
            self.table("profiles")
            .groupBy(F.col("dataset_id").alias("id"))
            .agg(F.max_by("row_count", "created_at").alias("profiled"))
        )
        rows = self.table("datasets").join(counted, "id", "left")
        corrected = F.coalesce("profiled", "row_count_estimate")
        return (
            rows.withColumn("row_count_estimate", corrected)
            .drop("profiled")
            .orderBy(F.desc("created_at"))
        )

    def dataset(self, dataset_id: str) -> Row:
        return self._one(self.datasets().filter(F.col("id") == dataset_id), f"dataset {dataset_id}")

    def frame(self, dataset_id: str) -> DataFrame:
        row = self.dataset(dataset_id)
        return read(
            self.spark, row["source_uri"], row["format"], **_reader_options(row["reader_options"])
        )

    def children(self, dataset_id: str) -> DataFrame:
        return self.datasets().filter(F.col("parent_dataset_id") == dataset_id)

    def lineage(self, dataset_id: str) -> DataFrame:
        """Rows (depth, id, name): the dataset and its ancestors, nearest first."""
        known = self.table("datasets").select("id", "name", "parent_dataset_id")
        found, next_id, seen = [], dataset_id, set()
        # One small lookup per generation, of any number of them.
        while next_id is not None and next_id not in seen:
            seen.add(next_id)
            row = known.filter(F.col("id") == next_id).first()
            if row is None:
                break
            found.append((len(found), row["id"], row["name"]))
            next_id = row["parent_dataset_id"]
        return self.spark.createDataFrame(found, "depth int, id string, name string")

    # Profiles

    def profile(self, dataset_id: str, options: ProfileOptions = ProfileOptions()) -> str:
        staged = self.dataset(dataset_id)["format"] == "csv"
        found = profile(self.frame(dataset_id), options, staged)
        return self._append(
            "profiles",
            dataset_id=dataset_id,
            row_count=found.row_count,
            column_count=found.column_count,
            summary=found.to_json(),
        )

    def profiles(self, dataset_id: str) -> DataFrame:
        """All profiles of a dataset, newest first; earlier ones stay."""
        self.dataset(dataset_id)
        rows = self.table("profiles").filter(F.col("dataset_id") == dataset_id)
        return rows.orderBy(F.desc("created_at"))

    def latest_profile(self, dataset_id: str) -> Row:
        return self._one(self.profiles(dataset_id), f"no profile of dataset {dataset_id} yet")

    # Splits

    def split(
        self, dataset_id: str, plan: SplitPlan, path: str, id_columns: list[str] | None = None
    ) -> str:
        """Split a dataset into `path`, register the partitions as its children, record the plan."""
        source = self.dataset(dataset_id)
        folders = split_files(
            self.spark,
            source["source_uri"],
            plan,
            path,
            id_columns,
            source["format"],
            **_reader_options(source["reader_options"]),
        )
        now = _now()
        children = {
            name: self._described(
                str(uuid.uuid4()), folder, f"{source['name']} · {name}", dataset_id, now, {}, "parquet"
            )
            for name, folder in folders.items()
        }
        self._append_rows("datasets", list(children.values()))
        params = {k: str(v) for k, v in plan.params().items() if v is not None}
        return self._append(
            "split_configs",
            dataset_id=dataset_id,
            strategy=plan.strategy,
            params=params,
            row_counts={name: child["row_count_estimate"] for name, child in children.items()},
            **{
                f"{name}_dataset_id": children[name]["id"] if name in children else None
                for name in SPLIT_NAMES
            },
        )

    def splits(self, dataset_id: str) -> DataFrame:
        rows = self.table("split_configs").filter(F.col("dataset_id") == dataset_id)
        return rows.orderBy(F.desc("created_at"))

    def split_config(self, split_id: str) -> Row:
        return self._one(
            self.table("split_configs").filter(F.col("id") == split_id), f"split {split_id}"
        )

    # Feature pipelines

    def fit_features(
        self, dataset_id: str, steps: list[Step], path: str, name: str = "features", split_id: str | None = None
    ) -> str:
        """Fit steps on a dataset and record them as the next version of `name` for a split.

        The dataset should be the train part of the split; then the split needs not be named. What is
        recorded is where the steps really learned from, for the audit to judge.
        """
        self.dataset(dataset_id)
        if split_id is None:
            parts = [F.col(f"{part}_dataset_id") == dataset_id for part in SPLIT_NAMES]
            split = self.table("split_configs").filter(parts[0] | parts[1] | parts[2]).first()
            split_id = split["id"] if split else None
        else:
            self.split_config(split_id)
        fitted = fit_features(self.frame(dataset_id), steps, dataset_id)
        folder = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
        fitted.save_tables(folder)
        last = self.feature_pipelines(split_id).filter(F.col("name") == name).agg(F.max("version")).first()[0]
        return self._append(
            "feature_pipelines",
            name=name,
            version=(last or 0) + 1,
            dataset_id=dataset_id,
            split_config_id=split_id,
            steps=fitted.to_json(),
            folder=folder,
        )

    def feature_pipelines(self, split_id: str | None) -> DataFrame:
        """All versions recorded for a split, newest first; for no split, those that have none."""
        rows = self.table("feature_pipelines").filter(F.col("split_config_id").eqNullSafe(F.lit(split_id)))
        return rows.orderBy(F.desc("created_at"))

    def feature_pipeline(self, pipeline_id: str) -> Row:
        found = self.table("feature_pipelines").filter(F.col("id") == pipeline_id)
        return self._one(found, f"feature pipeline {pipeline_id}")

    def features(self, pipeline_id: str) -> FeaturePipeline:
        row = self.feature_pipeline(pipeline_id)
        return FeaturePipeline.from_json(self.spark, row["steps"], row["folder"])

    def _fitted_steps(self, split_id: str) -> list[FittedOn]:
        """The steps of the latest version of each pipeline of a split."""
        latest: dict[str, Row] = {}
        for row in self.feature_pipelines(split_id).collect():  # one row per version
            if row["name"] not in latest or latest[row["name"]]["version"] < row["version"]:
                latest[row["name"]] = row
        return [
            FittedOn(f"{row['name']} {row['version']}", f"{i} {s['kind']}", tuple(s["step"]["columns"]), s["fitted_on"])
            for row in latest.values()
            for i, s in enumerate(json.loads(row["steps"]))
        ]

    # Audits

    def audit(self, split_id: str, target: str, options: AuditOptions = AuditOptions()) -> str:
        """Audit the files of a split. Time and group columns are those its plan declared; feature
        steps are those of the latest version of each pipeline recorded for the split."""
        config = self.split_config(split_id)
        if not config["train_dataset_id"] or not config["test_dataset_id"]:
            raise ValueError("the split has no train and test; there is nothing to compare")
        report = audit(
            self.frame(config["train_dataset_id"]),
            self.frame(config["test_dataset_id"]),
            target,
            strategy=config["strategy"],
            time_column=config["params"].get("time_column"),
            group_column=config["params"].get("group_column"),
            options=options,
            fitted=self._fitted_steps(split_id),
            train_id=config["train_dataset_id"],
        )
        checks = [tuple(r) for r in report.orderBy("position").collect()]  # seven rows
        return self._append(
            "leakage_reports",
            split_config_id=split_id,
            target_column=target,
            checks=checks,
            highest_severity=highest_severity(report),
        )

    def latest_report(self, split_id: str) -> Row:
        self.split_config(split_id)
        rows = self.table("leakage_reports").filter(F.col("split_config_id") == split_id)
        return self._one(
            rows.orderBy(F.desc("created_at")), f"no report of split {split_id} yet"
        )

    def report(self, report_id: str) -> Row:
        return self._one(
            self.table("leakage_reports").filter(F.col("id") == report_id), f"report {report_id}"
        )
