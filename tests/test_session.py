from types import SimpleNamespace

import pytest

from lexmill.session import shared_dir


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[4]")).startswith("/tmp/")
