import numpy as np
import pyarrow as pa

from emberlog.llm import runtime as R


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.value or default


class Session:
    """A session with another checkpoint folder."""

    def __init__(self, spark, value):
        self.conf, self.sparkContext = Conf(value), spark.sparkContext


def test_shared_folder(spark, tmp_path):
    assert R.shared_dir(Session(spark, "hdfs://host/x")) == "hdfs://host/x"
    assert R.shared_dir(Session(spark, f"file://{tmp_path}")) == f"file://{tmp_path}"
    assert R.shared_dir(Session(spark, str(tmp_path))) == f"file://{tmp_path}"
    own = R.shared_dir(Session(spark, None))
    assert own.startswith("file:///") and R.shared_dir(Session(spark, None)) == own
    assert R.fresh_path(spark, "a") != R.fresh_path(spark, "a")


def test_written_tables_are_read_back(spark):
    df = R.materialize(spark.createDataFrame([(1, None), (2, "x")], "a long, b string"), "t")
    assert sorted(df.collect()) == [(1, None), (2, "x")] and df.inputFiles()


def test_batches_are_bounded_by_bytes(spark):
    R.ship(spark)
    rows = spark.range(0, 300, numPartitions=1).selectExpr("repeat('x', 200000) AS t")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    found = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert max(found) <= R.BATCH_BYTES + 400_000 and sum(found) >= 300 * 200_000


def test_release_is_safe():
    held = np.ones(1 << 22)
    R.release()
    assert held.sum() == 1 << 22
    assert list(R.streamed(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]
    assert R.grouped(lambda t: t + 1)(1) == 2 and R.paired(lambda a, b: a + b)(1, 2) == 3
