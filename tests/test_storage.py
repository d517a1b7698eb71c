import pytest

from trussline import storage


class Session:
    """What :func:`storage.shared_dir` asks of a session."""

    def __init__(self, master, path=None):
        self.conf, self.sparkContext = self, self
        self.master, self.applicationId, self.path = master, "one", path

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.path or default


def test_the_folder_is_the_setting_of_the_session():
    assert storage.shared_dir(Session("yarn", "s3a://bucket/shared/")) == "s3a://bucket/shared"


def test_only_one_process_gets_a_folder_of_its_own():
    assert storage.shared_dir(Session("local[4]")).startswith("file:///") and storage.shared_dir(Session("local[4]")) == storage.shared_dir(Session("local"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(Session(master))


def test_stored_tables_can_be_dropped(spark):
    table = storage.stored(spark.range(5), "five")
    path = table.inputFiles()[0]
    assert table.count() == 5
    storage.drop_stored(table)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
