import pytest

import corpus_pipeline
from checks import compare
from tests.llm.helpers import awkward, frame
from usagelens.llm import oracles, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_against_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = compare.connect(FOLDER).execute(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canonical(got) == compare.canonical(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_query_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_stages_keep_the_columns(spark):
    docs = frame(spark, awkward(), clashing=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).where("lossless").count() == docs.count()
