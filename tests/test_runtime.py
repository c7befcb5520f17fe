"""The shared folder: read from the session, required on clusters, made only on one machine."""

from types import SimpleNamespace

import pytest

from lexmill import runtime


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def session(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


def test_setting_is_read():
    assert runtime.shared_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_it(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(session(master))


def test_one_machine_makes_its_own():
    made = session("local[4]")
    found = runtime.shared_dir(made)
    assert found.startswith("file://") and runtime.shared_dir(made) == found
