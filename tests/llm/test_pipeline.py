import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.saved(stage(spark, docs, DATA))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        assert 0 < out.count() <= n
        n, docs = out.count(), out
    assert docs.where(~F.col("round_trip")).count() == 0
    assert docs.where(F.col("text").rlike(r"@mail\d\.example\.com")).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LEAK = "which heath lies between the amber grove and the northern ridge of the old prairie"


def tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", F.lit(-1)).withColumn("gone", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")  # without labels nothing is rejected
    spark.createDataFrame([(1, LEAK), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows_through_all_stages(spark, tmp_path):
    words = "birch cedar delta ember fjord heath inlet jetty knoll ledge marsh ocean"
    long = " ".join(f"{w}{k}" for k in range(9000) for w in ("quarry", "slope"))
    texts = {0: None, 1: "", 2: " \t", 3: words, 4: words, 5: words + " ridge", 6: f"so {LEAK}, they ask", 7: long, 8: long + f" {LEAK}", 9: "Mail ann@quarry.org today", 10: "é" * 40}
    rows = [(k, x, None, "s", len(x or "")) for k, x in texts.items()]
    rows += [rows[9], rows[9], (None, words, None, None, None), (None, f"also {LEAK}", None, None, None), (None, None, None, None, None)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path / "t", rows))
    assert sorted(out.columns) == sorted([*SCHEMA.replace(",", "").split()[::2], "gone", "n_tokens", "token_ids", "round_trip"])
    got = out.collect()
    # of the equal texts 3 and 4 and the near one 5 the smallest id stays, of repeated rows one; leaks go with and without an id; rows without id are no copies
    assert sorted((r["doc_id"] for r in got), key=str) == [0, 1, 10, 2, 3, 7, 9, None, None]
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(r["round_trip"] in (None, True) and r["gone"] == "x" and r["n_tokens"] == len(r["token_ids"] or []) for r in got)
    assert by[0]["text"] is None and by[0]["token_ids"] is None and by[1]["token_ids"] == [] and by[7]["text"] == long
    assert "ann@quarry.org" not in by[9]["text"] and by[9]["n_chars"] == len(by[9]["text"])


def test_no_rows_through_all_stages(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "t", [])).count() == 0
