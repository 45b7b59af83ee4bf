"""Intermediate tables have an owner that removes them."""

import os

import pytest

from stationlens import session


def tables(folder):
    return sorted(d for d in os.listdir(folder)) if os.path.isdir(folder) else []


def test_scope_removes_what_was_written_inside(spark):
    with session.scope(spark) as folder:
        outer = session.written(spark.range(3), "outer")
        with session.scope(spark) as inner:
            assert inner.startswith(folder + "/")
            assert session.written(spark.range(5), "inner").count() == 5
            assert len(tables(inner)) == 1
        assert tables(inner) == [] and outer.count() == 3
    assert not os.path.exists(folder)


def test_scope_ends_after_an_error_too(spark):
    with pytest.raises(ZeroDivisionError):
        with session.scope(spark) as folder:
            session.written(spark.range(3), "lost")
            raise ZeroDivisionError
    assert not os.path.exists(folder)


def test_queries_leave_nothing_behind(spark, sf_dir):
    from stationlens.plans.registry import QUERIES

    with session.scope(spark) as folder:
        assert QUERIES["kmeans_fit"](spark, sf_dir).count() > 0
        assert tables(folder)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("master, local", [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)])
def test_only_a_local_session_may_use_a_temporary_folder(master, local):
    class Context:
        applicationId = f"app-{master}"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    Context.master = master
    if local:
        folder = session.shared_dir(Session())
        assert os.path.isdir(folder)
        os.rmdir(folder)
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(Session())
