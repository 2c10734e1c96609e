"""The pipeline's stages on a small table, and its own guarantees."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, make, prose, tmp_path):
    passage = prose(50, 80)
    rows = [(i, prose(1000 + i, 120)) for i in range(40)]
    rows += [(100, prose(7, 150)), (101, prose(7, 150)), (102, passage + " " + prose(8, 60)), (103, prose(9, 60) + " " + passage), (104, "junk | " * 80), (105, None), (106, "short")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 3:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    whole = {r[0] for r in rows}
    assert kept[0] == whole - {104, 105, 106} and kept[1] == kept[0] - {101} and kept[2] == kept[1] == kept[3]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == kept[3] and out[103].n_tokens == 60 and out[102].n_tokens == 140


def test_empty_corpus(spark, make, tmp_path):
    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_survive(spark, make, prose):
    docs = make([(i, prose(i, 60)) for i in range(5)]).withColumns({"kept": F.lit(1), "fp": F.lit(2), "label": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns[-3:] == ["kept", "fp", "label"]
    assert docs.count() == 5
