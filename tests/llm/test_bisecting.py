import numpy as np
import pytest
from test_subjects import WORDS, _corpus

from ledgerloom.llm import bisecting as B, subjects as S
from ledgerloom.runtime import Scratch


def _vectors(n=900, dims=12):
    rng = np.random.default_rng(4)
    centres = B._unit(rng.normal(0, 1, (20, dims)))
    return B._unit(centres[np.minimum(rng.integers(0, 20, n), rng.integers(0, 20, n))] + rng.normal(0, 0.1, (n, dims)))


def _table(spark, v, ids=None):
    ids = range(len(v)) if ids is None else ids
    return spark.createDataFrame([(int(i), x.tobytes()) for i, x in zip(ids, B.whole(v))], "id bigint, v binary")


@pytest.mark.parametrize("local", [1, 60, 10_000])
def test_leaves_of_a_table_are_those_of_all_its_vectors(spark, monkeypatch, local):
    v = _vectors()
    want = B.bisected(v, 24)
    monkeypatch.setattr(B, "LOCAL", local)
    got = B.centres(_table(spark, v).repartition(5), v.shape[1], 24, Scratch(spark))
    assert len(want) == 24 and np.array_equal(got, want)


def test_copies_few_and_no_vectors(spark, monkeypatch):
    v = _vectors(60)
    monkeypatch.setattr(B, "LOCAL", 1)
    scratch = Scratch(spark)
    assert len(B.centres(_table(spark, v[:0]), 12, 5, scratch)) == 0
    assert len(B.centres(_table(spark, v[:1]), 12, 5, scratch)) == 1
    assert len(B.centres(_table(spark, np.repeat(v[:1], 9, axis=0)), 12, 5, scratch)) == 1
    # repeated rows, ids included
    twice = np.concatenate([v, v])
    got = B.centres(_table(spark, twice, [*range(60), *range(60)]), 12, 9, scratch)
    assert np.array_equal(got, B.bisected(twice, 9))


def test_subjects_rest_on_all_documents(spark):
    docs, _, labels = _corpus()
    d, marks = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject string, by string")
    areas = spark.createDataFrame([(a,) for a in WORDS], "subject string")
    got = [sorted(map(tuple, S.subject_shares(x, marks, areas, leaves=24, sample=n).collect())) for x, n in ((d, None), (d.repartition(3), 1))]
    assert got[0] == got[1] and got[0]
