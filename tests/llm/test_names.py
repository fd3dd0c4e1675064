from pyspark.sql import functions as F

import corpus_pipeline as pipeline


def test_quality_and_line_stages_take_clashing_names(spark, messy, tmp_path):
    docs = messy[0].withColumns({"n_removed": F.lit(9), "N_Lines": F.lit(1), "_score": F.lit("s")})
    spark.createDataFrame([(i, 1, 0) for i in range(0, 90, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for stage in (pipeline.classify, pipeline.line_dedup):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = out.collect()
        assert rows and {(r["score"], r["n_removed"], r["N_Lines"], r["_score"]) for r in rows if r["doc_id"] is not None} == {(0.5, 9, 1, "s")}
        narrow = stage(spark, plain, str(tmp_path)).collect()
        assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str((r["doc_id"], r["text"])) for r in narrow)
