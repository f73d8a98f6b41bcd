from types import SimpleNamespace

import pytest

from lakelens.session import checkpoint_root, drop_path, scratch_dir


def _session(master, root=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: root)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(_session(master))


def test_the_set_folder_is_used():
    assert checkpoint_root(_session("yarn", "hdfs:///shared/x/")) == "hdfs:///shared/x"


def test_only_own_scratch_folders_are_dropped(spark, scratch):
    from lakelens.session import path_exists
    mine = scratch_dir(spark, "drop")
    spark.range(3).write.parquet(mine)
    drop_path(spark, mine)
    assert not path_exists(spark, mine)
    other = f"{scratch}/not-mine"
    spark.range(3).write.parquet(other)
    with pytest.raises(ValueError):
        drop_path(spark, other)
    assert path_exists(spark, other)
