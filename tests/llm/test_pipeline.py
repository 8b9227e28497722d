import pytest

from .helpers import FOLDER, odd_documents

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_each_stage_acts_on_what_the_one_before_kept(spark, tmp_path):
    from sedimenta.llm import mixing, near_dedup, pii, quality_classifier

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    before = docs
    outs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / str(i)))
        outs.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 4:
            assert outs[-1].columns == docs.columns
        before = outs[-1]
    good, single, clean, mixed, packed = outs
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == ids(quality_classifier.classify(docs, labels).where("kept"))
    assert ids(single) == ids(near_dedup.near_duplicates(good).where("kept"))
    assert ids(clean) == ids(single) and clean.where("text LIKE '%@mail%.example.com%'").count() == 0
    texts = {r.doc_id: r.text for r in single.collect()}
    spans = {r.doc_id: r.spans for r in pii.find(single).collect()}
    assert all(r.text == pii.redacted(texts[r.doc_id], spans[r.doc_id]) and r.n_chars == len(r.text) for r in clean.collect())
    copies = {r.doc_id: r.copies for r in mixing.systematic_mix(clean).collect()}
    got = ids(mixed)
    assert {i: got.count(i) for i in copies} == copies
    words = sum(len(r.text.split()) for r in mixed.collect())
    assert packed.agg({"size": "sum"}).first()[0] == words and set(ids(packed)) == set(got)


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() > 0 and "bin_id" in got.columns and corpus_pipeline.ORACLE_SQL is None


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and columns with the names of results."""
    docs = odd_documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        now = spark.read.parquet(str(tmp_path / f"out{i}"))
        if i < 4:
            assert now.columns == docs.columns
    sizes = {r.doc_id: r.n for r in now.groupBy("doc_id").agg({"size": "sum"}).withColumnRenamed("sum(size)", "n").collect()}
    assert sizes.get(6, 0) % 30_000 == 0 and now.count() > 0
