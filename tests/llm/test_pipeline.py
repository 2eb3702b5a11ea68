"""Every stage of the pipeline alone, on nulls, empty texts, repeated rows and clashing columns, and all of them in a row."""

import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words, bad = [f"w{i}" for i in range(200)], ["vile", "nasty", "foul"]
    rows, labels = [], []
    for i in range(240):
        text = rng.choices(words, k=40) + (rng.choices(bad, k=3) if i % 6 == 0 else [])
        rows.append((i, " ".join(text), "en", "s", 0))
        if i < 180:
            labels.append((i, 1, int(i % 6 == 0)))
    for i in range(240, 300):  # junk of other words
        rows.append((i, " ".join(rng.choices([f"j{k}" for k in range(50)], k=40)), "en", "s", 0))
        labels.append((i, 0, 0))
    rows += [(400, rows[1][1], "en", "s", 0), (401, rows[1][1] + " more", None, None, None), (402, None, None, None, None), (403, "", None, None, 0), (None, rows[2][1], None, None, None), (7, rows[7][1], "en", "s", 0)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_keep_the_columns_and_handle_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = docs.count()
    found = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        found[name] = [tuple(r) for r in out.collect()]
        assert stage(spark, docs.limit(0), folder).count() == 0
    toxic = {i for i in range(240) if i % 6 == 0}
    assert {r[0] for r in found["toxicity"]} == ({r["doc_id"] for r in docs.collect()} - toxic)
    kept = {r[0] for r in found["quality"]}
    assert len(kept & set(range(240))) > 200 and len(kept & set(range(240, 300))) < 15
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id > 399").collect()}
    after = {r[0]: r for r in found["line_dedup"]}
    assert len(found["line_dedup"]) == n and after[400][1] == "" and after[400][4] == 0 and after[402][1] is None and texts[403] == after[403][1]
    near = [r[0] for r in found["near_dedup"]]
    assert 400 not in near and 401 not in near and {1, 402, 403, None} <= set(near) and near.count(7) == 2
    pieces = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_the_run_is_its_stages(spark, folder):
    out = pipeline.run(spark, folder)
    tokens = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert not tokens.keys() & {i for i in range(240) if i % 6 == 0}
    # copies lose their lines to the first document; what is left of them is the end token
    assert tokens[1] > 40 and tokens[400] == 1
    places = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 1024 for r in places)
