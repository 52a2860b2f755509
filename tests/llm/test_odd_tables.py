"""The pipeline, and operators with clashing columns, on odd and empty tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from postlake.llm import ctw, periodic, vector_dedup


def run_on(spark, tmp_path, docs, name):
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    return corpus_pipeline.run(spark, f"{tmp_path}/{name}")


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, odd, none):
    rows, df = odd
    got = run_on(spark, tmp_path, df, "odd").collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows} and all(r.n_pieces == len(r.ids) for r in got)
    assert run_on(spark, tmp_path, none, "none").collect() == []


def test_clashing_columns(spark, odd, clashing):
    keyed = lambda df: sorted(map(repr, df.collect()))
    assert keyed(periodic.periodic_runs(clashing)) == keyed(periodic.periodic_runs(odd[1]))
    own = lambda df: df.select("doc_id", "held_out", "n_tokens", "n_known", F.round("score", 6).alias("score"))
    assert keyed(own(ctw.score_texts(clashing))) == keyed(own(ctw.score_texts(odd[1])))
    vectors = spark.createDataFrame([(k, k % 2, [1.0, float(k % 3), 0.5]) for k in range(20)], "vec_id long, label int, embedding array<double>")
    names = [c for c in ("uid", "key", "cell", "node", "component", "src", "dst", "_salt", "pass", "tile", "n_links", "kept") if c not in vectors.columns]
    more = vectors.withColumns({c: F.lit(1) for c in names})
    assert keyed(vector_dedup.label_near_vectors(more)) == keyed(vector_dedup.label_near_vectors(vectors))
