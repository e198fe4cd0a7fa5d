"""checkpoint_dir: the cluster's setting, else a folder of the shared warehouse
(stand-in session objects, no Spark needed)."""

import pytest

from marketml.session import checkpoint_dir


class _SC:
    def __init__(self, master, current=None):
        self.master, self._dir = master, current

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, d):
        self._dir = d


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        if key == "spark.sql.warehouse.dir":
            return "hdfs:///warehouse"
        return self.value if key == "spark.checkpoint.dir" else default


class _Spark:
    def __init__(self, master, current=None, conf=None):
        self.sparkContext = _SC(master, current)
        self.conf = _Conf(conf)


def test_existing_dir_is_used():
    assert checkpoint_dir(_Spark("yarn", current="hdfs:///ckpt/app")) == "hdfs:///ckpt/app"


def test_conf_dir_is_applied():
    s = _Spark("yarn", conf="s3a://bucket/ckpt")
    assert checkpoint_dir(s) == "s3a://bucket/ckpt"
    assert s.sparkContext.getCheckpointDir() == "s3a://bucket/ckpt"


@pytest.mark.parametrize("master", ["yarn", "local[2]"])
def test_without_setting_the_warehouse_is_used(master):
    assert checkpoint_dir(_Spark(master)) == "hdfs:///warehouse/_checkpoints"
