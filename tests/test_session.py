import pytest

from tracewake import session


def test_ship_and_checkpoint(spark):
    session.ship(spark)
    df = session.cut(spark.range(5))
    assert df.count() == 5 and "Scan ExistingRDD" in df._jdf.queryExecution().toString() and spark.sparkContext.getCheckpointDir()


def test_broadcast_only_when_small(spark):
    assert session.plan_bytes(spark.range(10)) == 80
    small, large = session.broadcast_if_small(spark.range(10)), session.broadcast_if_small(spark.range(10), 8)
    assert "hint" in small._jdf.queryExecution().logical().toString().lower() and "hint" not in large._jdf.queryExecution().logical().toString().lower()


def test_spread_only_small_scans(spark, monkeypatch):
    one = spark.range(10).coalesce(1)
    assert session.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SPREAD_BYTES", 8)
    assert session.spread(one) is one


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
