import random
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline


def build(spark, folder):
    """Documents of which it is known what each stage has to do with them."""
    rng = random.Random(21)
    words = ["".join(rng.choices("aeioudnrst", k=rng.randrange(3, 9))) for _ in range(1500)]
    filler = lambda n: " ".join(rng.choices(words, k=n))
    docs, labels = [], []

    def add(text, fate, toxic=0):
        docs.append((len(docs), text, "en", f"s{len(docs) % 3}", len(text or ""), fate))
        labels.append((len(docs) - 1, 1, toxic))
        return len(docs) - 1

    for i in range(150):
        add(filler(60), "keep")
    for i in range(60):
        tokens = filler(60).split()
        tokens[i % 60] = "vexgrub"
        add(" ".join(tokens), "toxic", 1)
    items = [filler(30) for _ in range(10)]
    for item in items:
        add(f"{filler(40)} {item} {filler(40)}", "benchmark")
    for i in range(20):
        tokens = filler(120).split()
        add(" ".join(tokens), "keep")
        add(" ".join(tokens), "copy")
        tokens[60] = "another"
        add(" ".join(tokens), "copy")
    for _ in range(10):
        add(f"{filler(30)} password = abcdef12345 {filler(30)}", "secret")
    add(None, "keep")
    add("", "copy")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fate string"
    frame = spark.createDataFrame(docs, schema)
    frame.drop("fate").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: (d[5], d[1]) for d in docs}


def test_stages_take_effect(spark, tmp_path):
    folder = str(Path(tmp_path) / "tables")
    fates = build(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, gone = docs.columns, set()
    expected = {"toxicity": "toxic", "near_copies": "copy", "decontamination": "benchmark", "secrets": None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        gone |= {i for i, (fate, _) in fates.items() if fate == expected[name]}
        if name == "toxicity":  # a learned score: all toxic ones go, of the others one in twenty at most
            assert not left & gone
            assert len(left) >= 0.95 * (len(fates) - len(gone))
            docs = spark.read.parquet(f"{folder}/documents.parquet").filter(~F.col("doc_id").isin(*gone))
        else:
            assert left == set(fates) - gone, name
    for r in docs.collect():
        fate, text = fates[r.doc_id]
        assert r.n_chars == len(r.text or "")
        assert r.text == (text.replace("password = abcdef12345", "[secret]") if fate == "secret" else text)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {"replica", "shuffle_key"} < set(mixed.columns)
    assert {r.doc_id for r in mixed.collect()} <= set(fates) - gone


def test_empty_corpus(spark, tmp_path):
    folder = str(tmp_path / "tables")
    build(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
