"""Batches of texts that go to Python: bounded in bytes, a kept text once, NULL as it was."""

import numpy as np
import pyarrow as pa
import pytest

from tagtrack.llm import arrays as A
from tagtrack.llm import quality as Q

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield spark.conf
    spark.conf.unset(LIMIT) if before is None else spark.conf.set(LIMIT, before)


def test_batches_of_long_texts_are_bounded(spark, unset):
    texts = [None if i % 50 == 0 else "" if i % 50 == 1 else f"{i} " * 10_000 for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)

    def sizes(column):
        return [pa.array([column.nbytes] * len(column)), pa.array([len(x) for x in column.to_pylist()], pa.int64())]

    for keep in (True, False):
        rows = A.with_columns(docs, "text", sizes, "batch bigint, n bigint", keep).collect()
        assert max(r.batch for r in rows) <= 4 << 20
        assert sorted((r.id, r.n) for r in rows) == [(i, len(t or "")) for i, t in enumerate(texts)]
        if keep:
            assert sorted(r.id for r in rows if r.text is None) == list(range(0, 400, 50))
            assert all(r.text == texts[r.id] for r in rows)


def test_the_classifier_bounds_its_batches_and_keeps_a_smaller_limit(spark, unset):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    sample = spark.createDataFrame([(1, True, False)], "doc_id long, good boolean, held boolean")
    Q.fit(docs, sample)
    assert int(unset.get(LIMIT)) <= 4 << 20
    unset.set(LIMIT, "1k")
    Q.fit(docs, sample)
    assert unset.get(LIMIT) == "1k"


def test_hashes_are_the_same_whatever_the_runs_of_rows(monkeypatch):
    texts = pa.array(["one two  three", "", "É" * 500 + " x", "two three"] * 5)
    made = []
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(A, "CHUNK_BYTES", size)
        made.append(np.concatenate([A.token_hashes(data, starts, A.PLAIN)[0] for _, data, starts in A.chunks(texts)]).tolist())
    assert made[0] == made[1] == made[2]
