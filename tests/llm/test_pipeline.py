import duckdb

import corpus_pipeline
from dayfold.llm import queries
from tests.conftest import DATA


def test_stages(spark):
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == first.columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] and sizes[-1] > 0.5 * sizes[0]
    pieces = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_oracles(spark):
    from tools.check import differences

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        assert differences(queries.QUERIES[name](spark, DATA).toPandas(), db.execute(sql).df()) is None, name


def test_stages_on_awkward_rows(spark, awkward):
    """Nulls, repeated rows, a very long text and extra columns with clashing names through all five stages."""
    from pyspark.sql import functions as F

    from tests.llm.conftest import SCHEMA, rows_of

    plain = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(None if i is None else i + 10 ** 6, t) for i, t in awkward]
    odd = spark.createDataFrame(rows_of(rows), SCHEMA)
    extra = [c for c in odd.columns if c not in plain.columns]
    docs = first = plain.select(*plain.columns, *[F.lit(None).cast(odd.schema[c].dataType).alias(c) for c in extra]).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == first.columns, name
    kept = docs.collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and all(r.text is not None for r in kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert pieces[pieces.start == 0].shape[0] == len(kept)
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
