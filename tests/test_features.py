import hashlib
import math
import statistics as st

import pytest

from tablewright import Catalog, SplitPlan
from tablewright.operators.features import (
    FeatureError,
    FeaturePipeline,
    Impute,
    OneHot,
    Ordinal,
    Scale,
    TargetMean,
    category_counts,
    fit_features,
    numbered,
)
from tablewright.sources.catalog import NotFoundError

SCHEMA = "id bigint, x double, n int, c string, y double, extra map<string,int>"
NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(*r, {"a": 1}) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(240):
        x = None if i % 7 == 0 else NAN if i % 11 == 0 else (i * 37 % 101) / 4
        c = None if i % 13 == 0 else "hot" if i % 3 == 0 else f"c{i * 7 % 23}"
        out.append((i, x, None if i % 5 == 0 else i * 17 % 29, c, None if i % 17 == 0 else float(i % 4)))
    return out


@pytest.fixture(scope="module")
def halves(spark, rows):
    return frame(spark, rows[:160]).repartition(3), frame(spark, rows[160:] + [(999, 1e6, 5, "new", 1.0)])


def known(rows, at):
    return [r[at] for r in rows if r[at] is not None and not (isinstance(r[at], float) and math.isnan(r[at]))]


@pytest.mark.parametrize("strategy", ["mean", "median", "mode", "constant"])
def test_imputes_with_what_train_says(halves, rows, strategy):
    train, test = halves
    fitted = fit_features(train, [Impute(("x", "n"), strategy, 3)], "t")
    xs, ns = known(rows[:160], 1), known(rows[:160], 2)
    of = {
        "mean": st.fmean,
        "median": st.median,
        "mode": lambda v: min((-v.count(u), str(u), u) for u in set(v))[2],
        "constant": lambda v: 3,
    }[strategy]
    for r in fitted.transform(test).collect():
        want = (rows[160:] + [(999, 1e6, 5, "new", 1.0)])[r.id - 160 if r.id < 999 else -1]
        missing = want[1] is None or math.isnan(want[1])
        assert r.x == pytest.approx(of(xs) if missing else want[1])
        assert r.n == pytest.approx(of(ns) if want[2] is None else want[2])
    assert set(test.columns) == set(fitted.transform(test).columns)


@pytest.mark.parametrize("method", ["standard", "min_max", "robust"])
def test_scales_with_what_train_says(halves, rows, method):
    train, test = halves
    ns = sorted(known(rows[:160], 2))
    q = st.quantiles(ns, method="inclusive")
    shift, unit = {
        "standard": (st.fmean(ns), st.stdev(ns)),
        "min_max": (ns[0], ns[-1] - ns[0]),
        "robust": (q[1], q[2] - q[0]),
    }[method]
    fitted = fit_features(train, [Scale(("n",), method)])
    for r in fitted.transform(test).collect():
        n = 5 if r.id == 999 else rows[r.id][2]
        assert r.n is None if n is None else r.n == pytest.approx((n - shift) / unit)


def test_constant_and_empty_columns(spark):
    df = frame(spark, [(i, 2.5, None, None, None) for i in range(4)])
    for method in ("standard", "min_max", "robust"):
        got = fit_features(df, [Scale(("x", "n"), method)]).transform(df).collect()
        assert [(r.x, r.n) for r in got] == [(0.0, None)] * 4
    for strategy in ("mean", "median", "mode"):
        got = fit_features(df, [Impute(("x", "n"), strategy)]).transform(df).collect()
        assert [(r.x, r.n) for r in got] == [(2.5, None)] * 4
    steps = [Impute(("x",)), Scale(("n",)), Ordinal(("c",)), TargetMean(("n",), "y", ("id",)), OneHot(("c",))]
    for empty in (df.limit(0), df.filter("id > 9")):
        fitted = fit_features(empty, [s for s in steps if not isinstance(s, OneHot)])
        [*_, last] = fitted.transform(df).collect()
        assert (last.x, last.c, last.n) == (2.5, None, None)


def test_codes_are_places_and_unseen_ones_have_one(halves, rows):
    train, test = halves
    fitted = fit_features(train, [Ordinal(("c", "n"))])
    cs = sorted(set(known(rows[:160], 3)))
    ns = sorted(map(str, set(known(rows[:160], 2))))
    for r in fitted.transform(test).collect():
        c, n = ("new", 5) if r.id == 999 else (rows[r.id][3], rows[r.id][2])
        assert r.c == (None if c is None else cs.index(c) if c in cs else -1)
        assert r.n == (None if n is None else ns.index(str(n)) if str(n) in ns else -1)


def test_many_categories_are_numbered_in_ranges(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 3001 as string) c", "'k' || (id % 7) d")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = numbered(category_counts(df, ("c", "d"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    for i, names in ((0, sorted(str(k) for k in range(3001))), (1, [f"k{k}" for k in range(7)])):
        assert {r.category: r.code for r in got if r["column"] == i} == {n: k for k, n in enumerate(names)}


def test_one_hot_keeps_the_frequent_and_counts_the_rest(halves, rows):
    train, test = halves
    fitted = fit_features(train, [OneHot(("c",), limit=3)])
    cs = known(rows[:160], 3)
    top = sorted(set(cs), key=lambda c: (-cs.count(c), c))[:3]
    out = fitted.transform(test)
    assert out.columns == ["id", "x", "n", "y", "extra", *[f"c={c}" for c in top], "c=*"]
    for r in out.collect():
        c = "new" if r.id == 999 else rows[r.id][3]
        assert [r[f"c={k}"] for k in top] == [int(c == k) for k in top]
        assert r["c=*"] == int(c is not None and c not in top)
    with pytest.raises(FeatureError):
        fitted.transform(test.withColumn("c=*", test.id))


def fold(i, folds=5, seed=42):
    return int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:13], 16) % folds


@pytest.mark.parametrize("hot", [1000, 4, 1])
def test_no_row_sees_its_own_target(monkeypatch, halves, rows, hot):
    monkeypatch.setattr("tablewright.operators.features.HOT", hot)
    train, test = halves
    fitted = fit_features(train, [TargetMean(("c",), "y", ("id",), smoothing=2.0)])

    def mean(c, without=None):
        taught = [r for r in rows[:160] if r[4] is not None and fold(r[0]) != without]
        prior = st.fmean(r[4] for r in taught)
        own = [r[4] for r in taught if r[3] == c]
        return (sum(own) + 2 * prior) / (len(own) + 2)

    got = {r.id: r.c for r in fitted.transform(train, training=True).collect()}
    assert got == {r[0]: pytest.approx(mean(r[3], fold(r[0]))) for r in rows[:160]}
    got = {r.id: r.c for r in fitted.transform(test).collect()}
    assert got == {**{r[0]: pytest.approx(mean(r[3])) for r in rows[160:]}, 999: pytest.approx(mean("new"))}


def test_steps_build_on_each_other_and_come_back(spark, halves, tmp_path):
    train, test = halves
    steps = [
        Impute(("x",), "median"), Scale(("x",)), Impute(("c",), "constant", "none"), TargetMean(("c",), "y", ("id",)),
        Ordinal(("n",)), Scale(("c",), "min_max"),
    ]
    fitted = fit_features(train, steps, "train-id")
    fitted.save_tables(str(tmp_path / "p"))
    again = FeaturePipeline.from_json(spark, fitted.to_json(), str(tmp_path / "p"))
    assert again == fitted and {s.fitted_on for s in again.steps} == {"train-id"}
    for part, training in ((train, True), (test, False)):
        one, other = (p.transform(part, training).drop("extra").collect() for p in (fitted, again))
        assert sorted(one) == sorted(other) and len(one) == part.count()
    scaled = [r.x for r in fitted.transform(train, True).collect()]
    assert st.fmean(scaled) == pytest.approx(0, abs=1e-9) and st.stdev(scaled) == pytest.approx(1)


def test_steps_that_do_not_fit(halves):
    train, _ = halves
    for step in (
        Impute(("nope",)), Impute(("c",)), Impute(("x",), "best"), Scale(("c",)), Scale(("x",), "odd"),
        TargetMean(("c",), "c", ("id",)), TargetMean(("c",), "y", ("id",), folds=1), TargetMean(("c",), "y", ("who",)),
    ):
        with pytest.raises(FeatureError):
            fit_features(train, [step])


def test_the_catalog_records_versions_and_the_audit_reads_them(spark, tmp_path):
    rows = [(i, float(i % 10), f"k{i % 3}", i % 2) for i in range(200)]
    spark.createDataFrame(rows, "id bigint, x double, k string, y int").write.parquet(str(tmp_path / "d.parquet"))
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    dataset = catalog.register(str(tmp_path / "d.parquet"))
    split = catalog.split(dataset, SplitPlan(), str(tmp_path / "s"), ["id"])
    train = catalog.split_config(split)["train_dataset_id"]
    steps, folder = [Scale(("x",)), Ordinal(("k",))], str(tmp_path / "f")

    def check():
        report = catalog.report(catalog.audit(split, "y"))
        return next(c for c in report["checks"] if c["check"] == "pipeline_contamination")

    assert (check()["severity"], check()["details"]) == ("info", {})
    catalog.fit_features(dataset, steps, folder)  # of no split: none of this audit's business
    assert check()["severity"] == "info" and catalog.feature_pipelines(None).count() == 1
    catalog.fit_features(train, steps, folder, "a")
    catalog.fit_features(dataset, [Scale(("x",))], folder, "b", split)
    found = check()
    assert (found["severity"], found["columns"]) == ("critical", ["x"])
    assert found["details"] == {"b 1: 0 Scale": f"fitted on {dataset}"}
    catalog.fit_features(train, [Scale(("x",))], folder, "b")
    assert check()["severity"] == "info"
    versions = [(r["name"], r["version"]) for r in catalog.feature_pipelines(split).collect()]
    assert versions == [("b", 2), ("b", 1), ("a", 1)]
    with pytest.raises(NotFoundError):
        catalog.features("nope")
    with pytest.raises(NotFoundError):
        catalog.fit_features(train, steps, folder, "a", "nope")
