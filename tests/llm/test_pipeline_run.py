"""The whole pipeline on odd, empty and given tables."""

import os

import corpus_pipeline
from growthpanel.llm import simhash
from growthpanel.llm.shared import shared_folder


def stored(spark):
    """Files that shelves and stages left in the shared folder."""
    root = shared_folder(spark).removeprefix("file:")
    return {os.path.join(d, f) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet")}


def tables(spark, folder, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_leaves_only_its_result(spark, folder):
    before = stored(spark)
    out = corpus_pipeline.run(spark, folder)
    kept = stored(spark) - before
    assert out.count() > 0 and {os.path.basename(p) for p in kept} == {os.path.basename(p) for p in out.inputFiles()}


def test_run_on_odd_and_empty_tables(spark, folder, odd, empty, tmp_path):
    given = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = given.unionByName(odd.withColumn("lang", odd.source), allowMissingColumns=True)
    pieces = corpus_pipeline.run(spark, tables(spark, folder, mixed, tmp_path / "odd"))
    lengths = {r.sequence_id: r.n for r in pieces.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert lengths and all(0 < n <= 4096 for n in lengths.values())
    assert corpus_pipeline.run(spark, tables(spark, folder, empty, tmp_path / "empty")).count() == 0


def test_one_row_of_each_group_stays(spark, folder, odd):
    for docs in (spark.read.parquet(f"{folder}/documents.parquet"), odd):
        kept = simhash.drop_near_copies(docs)
        assert kept.columns == docs.columns
        groups = {r.component_id for r in simhash.simhash_components(docs).collect()}
        assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)
    nameless = odd.where("doc_id IS NULL")
    assert simhash.drop_near_copies(nameless.unionByName(nameless)).count() == 1
    assert simhash.drop_near_copies(odd.limit(0)).count() == 0
