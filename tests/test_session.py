"""Checkpoint folder rules: read it from the session; invent one only in local mode."""

import pytest

from quarry.session import ensure_checkpoint_dir


class _SC:
    def __init__(self, master, current=None):
        self.master, self.current, self.set_to = master, current, None

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.set_to = self.current = path


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Spark:
    def __init__(self, master, conf=None, current=None):
        self.sparkContext = _SC(master, current)
        self.conf = _Conf(conf or {})


def test_cluster_without_checkpoint_dir_refuses():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Spark("yarn"))


def test_configured_dir_is_used():
    s = _Spark("yarn", {"spark.checkpoint.dir": "hdfs://nn/shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs://nn/shared/ckpt"
    assert s.sparkContext.set_to == "hdfs://nn/shared/ckpt"


def test_existing_dir_wins_and_local_gets_scratch():
    s = _Spark("yarn", current="s3a://bucket/ckpt")
    assert ensure_checkpoint_dir(s) == "s3a://bucket/ckpt" and s.sparkContext.set_to is None
    local = _Spark("local[4]")
    path = ensure_checkpoint_dir(local)
    assert path and local.sparkContext.set_to == path
