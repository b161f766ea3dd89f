from __future__ import annotations

import pytest

from chartmill.session import CLUSTER_SETTINGS, shared_dir, sizing_settings


def test_local_masters_get_a_partition_per_core():
    assert sizing_settings("local[6]") == {"spark.sql.shuffle.partitions": "6"}
    assert sizing_settings("local[2,4]") == {"spark.sql.shuffle.partitions": "2"}
    assert sizing_settings("local[*]") == {}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host"])
def test_other_masters_get_cluster_settings(master):
    assert sizing_settings(master) == CLUSTER_SETTINGS


def test_session(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


class FakeSession:
    """A session on some master without a shared folder, unless the application set one."""

    def __init__(self, master, folder=None):
        self.values = {}
        self.folder = folder
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, key, default):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value

    def getCheckpointDir(self):
        return self.folder


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession("yarn"))
    assert shared_dir(FakeSession("yarn", "hdfs:/checkpoints/1")) == "hdfs:/checkpoints/1"
    local = FakeSession("local[2]")
    assert shared_dir(local) == shared_dir(local)
