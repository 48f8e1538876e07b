import pytest

from tesselar.plans import registry
from tests.parity import connect, same

DIR = "/root/testdata/sf0.001"
CON = connect(DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    same(registry.QUERIES[name](spark, DIR), CON, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_whole_tables(spark):
    n = {t: spark.read.parquet(f"{DIR}/{t}.parquet").count() for t in ("events", "part")}
    rows = {name: registry.QUERIES[name](spark, DIR) for name in ("privacy_gate", "resolve_markers", "mutual_nearest_anchors", "recommended_references")}
    assert rows["privacy_gate"].count() == n["events"] and rows["resolve_markers"].select("seq").distinct().count() == n["part"]
    assert rows["mutual_nearest_anchors"].select("a", "b").distinct().count() == 3
    datasets = spark.read.parquet(f"{DIR}/supplier.parquet").select("s_nationkey").distinct().count()
    assert rows["recommended_references"].select("q").distinct().count() == datasets


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
