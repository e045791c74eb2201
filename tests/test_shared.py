import pytest

from emberlog import shared
from emberlog.errors import InvalidRootPath


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.value or default


class Context:
    def __init__(self, master):
        self.master, self.applicationId = master, f"app-{master}"


class Session:
    def __init__(self, master, value=None):
        self.conf, self.sparkContext = Conf(value), Context(master)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,3000]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(InvalidRootPath):
        shared.shared_dir(Session(master))
    assert shared.shared_dir(Session(master, "hdfs://h/x")) == "hdfs://h/x"


def test_one_machine_gets_a_folder_of_its_own():
    s = Session("local[2]")
    assert shared.shared_dir(s).startswith("file:///") and shared.shared_dir(s) == shared.shared_dir(s)
    assert shared.fresh_path(s, "t") != shared.fresh_path(s, "t")


def test_written_tables_and_clean_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    df = spark.range(1000).repartition(7)
    one, many = shared.materialize(df, "one", 1000), shared.materialize(df, "many")
    assert len(one.inputFiles()) == 1 and len(many.inputFiles()) == 7
    assert sorted(r[0] for r in one.collect()) == sorted(r[0] for r in many.collect()) == list(range(1000))
    (tmp_path / "emberlog" / "another-application").mkdir()
    shared.clean_up(spark)
    assert [p.name for p in (tmp_path / "emberlog").iterdir()] == ["another-application"]
