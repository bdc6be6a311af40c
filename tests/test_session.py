"""The shared work folder: where it comes from, and that a cluster must have one."""

import pytest

from windlass import session


class _Context:
    def __init__(self, master, checkpoint=None):
        self.master, self.dir = master, checkpoint

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, master, setting=None):
        self.sparkContext, self.setting = _Context(master), setting
        self.conf = self

    def get(self, key, default=None):
        return self.setting if key == "spark.checkpoint.dir" else default


@pytest.mark.parametrize("base", ["file:///shared/x", "hdfs://nn/ckpt/", "/shared"])
def test_setting_is_used_with_its_scheme(base):
    s = _Session("spark://host:7077", base)
    got = session.shared_dir(s, "a")
    assert got.startswith(base.rstrip("/") + "/windlass/a-") and s.sparkContext.dir == base
    assert session.shared_dir(s, "a") != got


def test_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session("spark://host:7077"), "a")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session("local-cluster[2,1,1024]"), "a")


def test_local_master_gets_a_private_folder():
    s = _Session("local[4]")
    got = session.shared_dir(s, "a")
    assert got.startswith("file:///") and got.startswith(s.sparkContext.dir)
    assert session.shared_dir(s, "b").startswith(s.sparkContext.dir)


def test_configure_fails_on_a_required_key():
    class Conf(_Session):
        def set(self, key, value):
            raise ValueError(key)
    with pytest.raises(ValueError):
        session.configure(Conf("local[1]"))
