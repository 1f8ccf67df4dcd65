"""What the session's settings change, and what they don't."""

import os
from types import SimpleNamespace

import pytest

from lawloom import session


def test_rows_are_the_same_however_they_are_spread(spark, tmp_path):
    spark.range(500).selectExpr("id", "cast(id % 7 as string) as k").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = {}
    try:
        for when in ("never", "always", "auto"):
            spark.conf.set(session.SPREAD, when)
            out = session.spread(df, "k")
            got[when] = sorted(map(tuple, out.collect()))
            assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == (when != "never")
        spark.conf.set(session.SPREAD, "auto")
        many = spark.read.parquet(*[str(tmp_path / "t")] * 4)
        assert session.spread(many, "k") is not None
    finally:
        spark.conf.unset(session.SPREAD)
    assert got["never"] == got["always"] == got["auto"] and len(got["auto"]) == 500


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_root(cluster)
    given = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "/shared/x/"), sparkContext=cluster.sparkContext)
    assert session.shared_root(given) == "/shared/x"


def test_scratch_tables_can_be_freed(spark):
    df = session.written(spark.range(5).toDF("id"), "kept")
    path = next(p for p in session._made if "lawloom-kept-" in p)
    assert df.count() == 5 and os.path.exists(path)
    session.drop_scratch(spark)
    assert not os.path.exists(path) and path not in session._made


def test_long_texts_stay_where_they_are_made(spark):
    from lawloom.plans import shapes

    plan = shapes.RECIPES["amend_bounds"].query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and " AS text#" in plan and " AS text#" not in plan[plan.index("Exchange ") :]
