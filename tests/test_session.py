import os

import pytest

from kerbside.session import materialise, shared_folder, working_tables


def test_working_tables_are_removed(spark):
    with working_tables() as outer:
        with working_tables() as inner:
            kept, gone = materialise(spark.range(5), "kept"), materialise(spark.range(5), "gone")
            inner.append(kept)
        assert kept.count() == 5 and not os.path.exists(gone._scratch.removeprefix("file:"))
        last = materialise(spark.range(3), "last")
        outer.append(last)
    assert not os.path.exists(kept._scratch.removeprefix("file:"))
    assert last.count() == 3 and last._scratch.startswith(shared_folder(spark))


def test_clusters_keep_their_folder(spark):
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda key, default: default)
    with pytest.raises(RuntimeError):
        shared_folder(Session())
