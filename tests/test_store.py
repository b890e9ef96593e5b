"""Tables by entity: what is read for one of them, and the scale of histograms."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import stats
from strandline.sources import store


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    ids = spark.range(20_000)
    series = ids.select((F.col("id") % 500).alias("op_id"), F.col("id").alias("time"), F.md5(F.col("id").cast("string")).alias("text"))
    static = spark.createDataFrame([(i, i * 2.0) for i in range(500)] + [(None, -1.0)], "op_id bigint, x double")
    store.write({"series": series, "static": static, "none": static.limit(0)}, root, "op_id", shards=16, group_bytes=16 << 10)
    return store.Store(spark, root)


def scan(df):
    """(files, rows) that the scan of a plan without shuffles has read."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return tuple(plan.metrics().apply(m).value() for m in ("numFiles", "numOutputRows"))


def test_one_entity_is_one_file_a_table(kept):
    got = kept.entities([123])
    rows = got["series"].collect()
    assert sorted(r.time for r in rows) == list(range(123, 20_000, 500)) and got["series"].columns == ["op_id", "time", "text"]
    assert len(got["series"].inputFiles()) == 1 == len(got["static"].inputFiles())
    files, read = scan(got["series"])
    assert files == 1 and 40 <= read < 20_000 / 16 * 2, read
    assert [tuple(r) for r in got["static"].collect()] == [(123, 246.0)] and got["none"].collect() == []


def test_several_absent_and_null_keys(kept):
    got = kept.entities([7, 8, None, 10**6], ["static"])
    assert list(got) == ["static"]
    assert sorted((r.x for r in got["static"].collect())) == [-1.0, 14.0, 16.0]
    assert kept.entities([10**6])["series"].count() == 0 and kept.entities([])["series"].count() == 0


def test_whole_tables_and_refused_names(kept, spark, tmp_path):
    assert kept.table("series").count() == 20_000 and kept.table("static").count() == 501 and kept.table("none").columns == ["op_id", "x"]
    d = spark.createDataFrame([(1, 2)], "op_id int, _shard int")
    with pytest.raises(ValueError, match="needs"):
        store.write({"t": d}, str(tmp_path), "op_id")
    with pytest.raises(ValueError, match="several types"):
        store.write({"t": d.select("op_id"), "u": d.select(F.col("op_id").cast("bigint"))}, str(tmp_path), "op_id")


def test_histograms_on_one_scale(spark):
    d = spark.createDataFrame([(10.0, 90.0), (198.0, 20.0)], "a double, b double")
    of = lambda *tops: sorted((r.bin, r.n) for r in stats.histogram(d, "a", 50.0, 600.0, tops=tops).collect())
    assert of() == of("a", "b") == [(0.0, 1), (150.0, 1)]
    assert of("b") == [(0.0, 1)]  # 198 lies over the edge that b sets, which is 100
