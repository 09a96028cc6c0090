"""The pipeline's stages against their operators, and the queries that SQL can express."""

import pytest
from oracle import compare, connect

import corpus_pipeline
from fairway.llm import bpe, common, mixing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    assert compare(spark, db, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == ""


def test_stages_keep_the_columns_and_each_takes_effect(spark):
    docs = common.table(spark, SF, "documents")
    columns, first = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    sizes = [len(first)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = common.fresh_path(spark, f"stage{k}")
        before = docs
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        sizes.append(docs.count())
        if k == 0:
            scores = quality.score(before, quality.fit(before, common.table(spark, SF, "labels")))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in scores.collect() if r.quality_score >= quality.THRESHOLD}
        if k == len(corpus_pipeline.STAGES) - 1:
            codec = bpe.Codec(bpe.load(bpe.default_path()))
            want = sorted((r.doc_id, len(codec.encode(r.text or ""))) for r in before.collect())
            assert sorted((r.doc_id, r.n_tokens) for r in docs.collect()) == want
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls, empty and long texts, repeats and extra columns with the operators' own names pass through every stage."""
    given = common.table(spark, SF, "documents").limit(40)
    kinds = given.schema
    long = "w1 w2 w3 w4 w5 w6 " * 3000
    odd = [(9001, None, "en", "src0", 0), (9002, "", None, "src0", 0), (9003, long, "en", None, len(long)), (None, "no id here", "en", "src1", 10), (9004, "same text here", "en", "src1", 14), (9004, "same text here", "en", "src1", 14), (9005, "same text here", "en", "src1", 14)]
    names = {"doc_id": 0, "text": 1, "lang": 2, "source": 3, "n_chars": 4}
    extra = spark.createDataFrame([tuple(r[names[f.name]] for f in kinds) for r in odd], kinds)
    docs = given.unionByName(extra)
    for name in ("score", "component_id", "fp", "spans_", "node"):
        docs = docs.withColumn(name, docs.doc_id + 1)
    for table in (docs, docs.limit(0)):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = common.fresh_path(spark, f"odd{k}")
            stage(spark, now, SF).write.parquet(path)
            after = spark.read.parquet(path)
            ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
            assert after.count() <= now.count() * (mixing.EPOCHS if stage is corpus_pipeline.mixing_stage else 1) and ids(after) <= ids(now)
            if stage is corpus_pipeline.quality_stage:
                assert not {9001, 9002} & ids(after)  # texts without words are not good
            if stage is corpus_pipeline.encoding_stage:
                assert after.count() == now.count() == after.select("doc_id", "lang", "source", "ids_sha256", "epoch").distinct().count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == table.columns
            now = after
