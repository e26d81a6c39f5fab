import pytest

from textloom.functions.shared_store import shared_dir


class Session:
    """What shared_dir() asks of a session."""

    def __init__(self, **settings):
        self.settings, self.conf, self.sparkContext, self.applicationId = settings, self, self, "app-test"

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)


def test_shared_dir():
    assert shared_dir(Session(spark_checkpoint_dir="hdfs://c/x/", spark_master="yarn")) == "hdfs://c/x"
    own = shared_dir(Session(spark_master="local[4]"))
    assert own.startswith("file:///") and shared_dir(Session(spark_master="local[4]")) == own
    with pytest.raises(ValueError):
        shared_dir(Session(spark_master="spark://host:7077"))
