from types import SimpleNamespace
from unittest.mock import Mock

import pytest

from mailverdict.session import CHECKPOINT_CONF, shared_dir


def session(in_conf=None, in_context=None, name="app", master="local[*]"):
    context = SimpleNamespace(
        getConf=lambda: {CHECKPOINT_CONF: in_context} if in_context else {}, applicationId=name, master=master
    )
    return SimpleNamespace(conf=Mock(get=lambda key, default: in_conf), sparkContext=context)


def test_the_cluster_names_the_shared_folder(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get(CHECKPOINT_CONF).rstrip("/") + "/x-")
    assert shared_dir(session("s3a://b/c/"), "x").startswith("s3a://b/c/x-")
    assert shared_dir(session(None, "/shared"), "x").startswith("/shared/x-")
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


def test_one_own_folder_per_application_where_none_is_named():
    first, second = shared_dir(session(), "x"), shared_dir(session(), "y")
    assert first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    assert shared_dir(session(name="other"), "x").rsplit("/", 1)[0] != first.rsplit("/", 1)[0]


@pytest.mark.parametrize("master", ["yarn", "k8s://x", "spark://h:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match=CHECKPOINT_CONF):
        shared_dir(session(master=master), "x")
    assert shared_dir(session(None, "/shared", master=master), "x").startswith("/shared/x-")
