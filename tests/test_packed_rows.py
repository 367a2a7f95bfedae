import numpy as np
import pyarrow as pa
import pytest

from docloom.operators import packed_rows
from docloom.operators.packed_rows import gradients, moments, pack
from tests.test_joint_logistic import frame, table


def test_moments_and_sums_are_those_of_the_dense_table(spark):
    x, truth = table(90, 12, 4)
    x[7] = 0
    x[:, 4] = 0.1
    packed = pack(frame(spark, x, truth))
    known = moments(packed, 12, 4)
    assert known.n == 90 and known.supports.tolist() == truth.sum(axis=0).tolist()
    np.testing.assert_allclose(known.mean, x.mean(axis=0))
    np.testing.assert_allclose(known.variance, x.var(axis=0, ddof=1), atol=1e-20)
    assert known.variance[3] == 0 and known.variance[4] == 0
    rng = np.random.default_rng(3)
    weights, intercepts = rng.normal(size=(12, 2)), rng.normal(size=2)
    loss, gradient = gradients(packed, known, weights, intercepts, [1, 3])
    packed.unpersist()
    logits = x @ weights + intercepts
    errors = 1 / (1 + np.exp(-logits)) - truth[:, [1, 3]]
    np.testing.assert_allclose(loss, (np.logaddexp(0, logits) - truth[:, [1, 3]] * logits).sum(axis=0))
    np.testing.assert_allclose(gradient, np.vstack([x.T @ errors, errors.sum(axis=0)]), atol=1e-12)


def test_a_worker_takes_a_bounded_number_of_values_and_rows_come_back(monkeypatch):
    monkeypatch.setattr(packed_rows, "VALUES", 7)
    sizes = [3, 0, 4, 9, 1, 6, 2, 0]
    at = [list(range(i, i + n)) for i, n in enumerate(sizes)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(at, pa.list_(pa.int32())), pa.array([[v / 2 for v in row] for row in at], pa.list_(pa.float64())), pa.array([[i, 1 - i % 2] for i in range(8)], pa.list_(pa.int32()))],
        names=["indices", "values", "truth"],
    )
    # Slices of a batch keep their offsets.
    parts = list(packed_rows._packed(iter([batch.slice(1), batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [2, 1, 2, 2]
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    got = list(packed_rows._unpacked(iter([whole.slice(1)]), 2))
    assert all(len(rows.at) <= 7 or rows.n == 1 for rows, _ in got)
    assert [a for rows, _ in got for a in rows.at] == [a for row in at[2:] for a in row]
    assert [v for rows, _ in got for v in rows.values] == [a / 2 for row in at[2:] for a in row]
    assert [t.tolist() for _, truth in got for t in truth] == [[i, 1 - i % 2] for i in range(2, 8)]


def test_a_row_without_labels_is_an_error(spark):
    df = frame(spark, *table(5, 12, 2)).selectExpr("features", "if(rand() >= 0, null, truth) as truth")
    with pytest.raises(Exception, match="no labels"):
        pack(df).count()


def test_passes_leave_no_shuffle_files(spark):
    packed = pack(frame(spark, *table(60, 12, 4)))
    known = moments(packed, 12, 4)
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    for _ in range(4):
        gradients(packed, known, np.zeros((12, 4)), np.zeros(4), range(4))
    # Those of one pass may be on their way out.
    assert disk.getAllFiles().size() < before + 10
    packed.unpersist()
    assert spark.conf.get(packed_rows._CLEANUP, None) is None
