"""Readers, the schema report and the catalog."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from tablewright import Catalog, InputError, SplitPlan, format_of, profile, read, schema_report
from tablewright.functions.staging import drop_staged, stage, staged_count
from tablewright.sources.catalog import SCHEMAS, NotFoundError, _now

# Ferries: the second has no length.
FERRIES = "hull,route,length,knots,launched\n11,Corfu,95,17.5,1991-04-30\n12,Islay,,14,2011-09-01\n14,Corfu,120,21,2004-02-29\n"


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("a.csv", "csv"),
        ("A.CSV", "csv"),
        ("s3a://b/x.parquet", "parquet"),
        ("x.PQ", "parquet"),
        ("x.xlsx", None),
        ("parquet", None),
    ],
)
def test_format_by_extension(path, expected):
    assert format_of(path) == expected


def test_csv_schema(spark, csv):
    df = read(spark, csv(FERRIES))
    found = [(r["name"], r["dtype"], r["null_count"]) for r in schema_report(df).orderBy("position").collect()]
    assert found == [
        ("hull", "bigint", 0),
        ("route", "string", 0),
        ("length", "bigint", 1),
        ("knots", "double", 0),
        ("launched", "date", 0),
    ]
    assert schema_report(df).first()["row_count"] == 3


def test_csv_types_come_from_every_line(spark, csv):
    lines = "\n".join(["v", *["1"] * 5000, "2.5"])
    assert read(spark, csv(lines)).dtypes == [("v", "double")]


def test_csv_separator_timestamps_and_odd_names(spark, csv):
    df = read(spark, csv('a.b;"c ""d"""\n2024-01-01 10:00:00;x\n'), sep=";")
    assert df.dtypes == [("a.b", "timestamp_ntz"), ('c "d"', "string")]
    assert profile(df).columns().first()["min_text"] == "2024-01-01T10:00:00"


def test_csv_line_breaks_in_fields(spark, csv):
    df = read(spark, csv('a,b\n"one\ntwo",1\n'), multi_line=True)
    assert [tuple(r) for r in df.collect()] == [("one\ntwo", 1)]


def test_header_only(spark, csv):
    df = read(spark, csv("a,b\n"))
    assert df.dtypes == [("a", "string"), ("b", "string")]
    assert [r["row_count"] for r in schema_report(df).collect()] == [0, 0]


def test_null_counts_are_capped(spark):
    df = spark.range(4).select(*[F.lit(None).cast("int").alias(f"c{i}") for i in range(5)])
    found = schema_report(df, max_counted=3).orderBy("position").collect()
    assert [r["null_count"] for r in found] == [4, 4, 4, None, None]
    assert [r["name"] for r in found] == df.columns


@pytest.mark.parametrize(
    ("name", "content", "message"),
    [
        ("x.txt", "a\n1\n", "unsupported"),
        ("x.csv", "", "empty"),
        ("x.parquet", "not parquet at all", "could not read"),
    ],
)
def test_unusable_input(spark, csv, tmp_path, name, content, message):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    with pytest.raises(InputError, match=message):
        catalog.register(csv(content, name))
    assert catalog.datasets().count() == 0


def test_missing_file(spark):
    with pytest.raises(InputError, match="does not exist"):
        read(spark, "/nowhere/x.csv")


def test_row_place_needs_parquet(spark, csv):
    with pytest.raises(InputError, match="Parquet"):
        read(spark, csv(FERRIES), row_id="row")


def trips() -> str:
    """Two hundred crossings by 16 captains, the delay falling over the year."""
    rows = ["trip,captain,delay,sailed,full"]
    rows += [f"{t},c{t * t % 17},{(900 - 4 * t) / 8},2023-{t // 17 + 1:02d}-{t % 17 + 9:02d},{int(t % 3 > 0)}" for t in range(200)]
    return "\n".join(rows) + "\n"


def test_the_whole_cycle(spark, csv, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    first = catalog.register(csv(FERRIES, "ferries.csv"))
    dataset = catalog.register(csv(trips(), "trips.csv"), "trips")
    assert [r["name"] for r in catalog.datasets().collect()] == ["trips", "ferries.csv"]
    row = catalog.dataset(dataset)
    assert (row["format"], row["row_count_estimate"], row["version"]) == ("csv", 200, 1)
    assert row["size_bytes"] > 1000
    assert json.loads(row["inferred_schema"])["columns"][0] == {
        "name": "trip",
        "dtype": "bigint",
        "null_count": 0,
    }

    # Profiles: the latest counts, earlier ones stay, the row count follows the file.
    with pytest.raises(NotFoundError):
        catalog.latest_profile(first)
    catalog.profile(first)
    csv(FERRIES + "15,Skye,61,12,1987-07-08\n", "ferries.csv")
    second_profile = catalog.profile(first)
    assert catalog.profiles(first).count() == 2
    latest = catalog.latest_profile(first)
    assert (latest["id"], latest["row_count"], latest["column_count"]) == (second_profile, 4, 5)
    assert json.loads(latest["summary"])["row_count"] == 4
    assert catalog.dataset(first)["row_count_estimate"] == 4

    # Splits: children with lineage, and an audit that looks at the files.
    plan = SplitPlan("random", group_column="captain")
    by_chance = catalog.split(dataset, plan, str(tmp_path / "random"), ["trip"])
    config = catalog.split_config(by_chance)
    assert config["row_counts"] == {"train": 140, "val": 30, "test": 30}
    assert config["params"]["group_column"] == "captain" and config["params"]["seed"] == "42"
    children = {r["name"]: r for r in catalog.children(dataset).collect()}
    assert set(children) == {"trips · train", "trips · val", "trips · test"}
    train = catalog.frame(config["train_dataset_id"])
    assert train.columns == ["trip", "captain", "delay", "sailed", "full"] and train.count() == 140
    lineage = catalog.lineage(config["test_dataset_id"]).collect()
    assert [(r["depth"], r["name"]) for r in lineage] == [(0, "trips · test"), (1, "trips")]

    by_group = catalog.split(
        dataset, SplitPlan("group", group_column="captain"), str(tmp_path / "group")
    )
    assert [r["id"] for r in catalog.splits(dataset).collect()] == [by_group, by_chance]

    with pytest.raises(NotFoundError):
        catalog.latest_report(by_group)
    for split_id, severity in ((by_chance, "critical"), (by_group, "info")):
        report_id = catalog.audit(split_id, "full")
        report = catalog.latest_report(split_id)
        assert report["id"] == report_id and report == catalog.report(report_id)
        assert (report["target_column"], len(report["checks"])) == ("full", 7)
        found = {c["check"]: c["severity"] for c in report["checks"]}
        assert found["group_leak"] == severity


def test_empty_val_has_no_child(spark, csv, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    dataset = catalog.register(csv(trips(), "trips.csv"))
    split_id = catalog.split(dataset, SplitPlan(train=0.8, val=0.0, test=0.2), str(tmp_path / "s"), ["trip"])
    config = catalog.split_config(split_id)
    assert config["val_dataset_id"] is None and set(config["row_counts"]) == {"train", "test"}


def test_a_split_without_train_cannot_be_audited(spark, csv, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    dataset = catalog.register(csv("g,v\n" + "a,1\n" * 20, "one.csv"))
    split_id = catalog.split(dataset, SplitPlan("group", group_column="g"), str(tmp_path / "s"))
    with pytest.raises(ValueError, match="nothing to compare"):
        catalog.audit(split_id, "v")


def test_unknown_ids(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    for lookup in (catalog.dataset, catalog.split_config, catalog.report, catalog.latest_report):
        with pytest.raises(NotFoundError):
            lookup("nope")


def test_semicolons_all_the_way(spark, csv, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    dataset = catalog.register(csv(trips().replace(",", ";"), "trips.csv"), sep=";")
    assert catalog.frame(dataset).columns == ["trip", "captain", "delay", "sailed", "full"]
    catalog.profile(dataset)
    assert catalog.latest_profile(dataset)["column_count"] == 5
    split_id = catalog.split(dataset, SplitPlan(), str(tmp_path / "s"), ["trip"])
    assert catalog.split_config(split_id)["row_counts"] == {"train": 140, "val": 30, "test": 30}


def test_staged_tables_are_dropped(spark, tmp_path):
    before = staged_count()
    folder = tmp_path / "staging"
    frame = stage(spark.range(10).toDF("n"), str(folder))
    assert frame.count() == 10 and len(list(folder.iterdir())) == 1
    assert drop_staged(spark, before) == 1
    assert list(folder.iterdir()) == [] and staged_count() == before


def test_staging_leaves_no_shuffle_files(spark, tmp_path):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum(f.getName().startswith("shuffle_") for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()))

    before = shuffled()
    frame = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), str(tmp_path / "staging"))
    until = time.time() + 10
    while shuffled() > before and time.time() < until:
        time.sleep(0.1)
    assert shuffled() <= before
    assert sorted(r["count"] for r in frame.collect()) == [142] * 1 + [143] * 6


def test_deep_lineage(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    now = _now()
    rows = [
        {c.split()[0]: None for c in SCHEMAS["datasets"].split(", ")}
        | {"id": str(i), "name": f"v{i}", "parent_dataset_id": str(i - 1) if i else None, "created_at": now}
        for i in range(130)
    ]
    catalog._append_rows("datasets", rows)
    found = catalog.lineage("129").collect()
    assert [(r["depth"], r["name"]) for r in found] == [(d, f"v{129 - d}") for d in range(130)]
