"""Pipeline stages over documents whose further columns have the names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

NAMES = ("predicted", "Score", "p_toxic", "fp", "component_id", "__hits", "__GONE", "__d", "__t", "__n_lines", "__n_gone", "c0", "c1", "d", "t", "p")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_names_may_clash(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    more = docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in NAMES})
    want, got = stage(spark, docs, sf_dir), stage(spark, more, sf_dir)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == more.columns
        assert got.where(" or ".join(f"not `{n}` <=> concat('{n}', doc_id)" for n in NAMES)).isEmpty()
        got = got.select(*docs.columns)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want)
