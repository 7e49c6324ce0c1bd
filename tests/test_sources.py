"""Catalog metadata, registers and intermediate tables."""

import os

import pytest

from stewardry import session
from stewardry.functions.durations import sla_minutes
from stewardry.operators import lifecycle as lc
from stewardry.plans import registry
from stewardry.plans.queries_subjects import REGISTER
from stewardry.session import materialise, release, scratch, shared_dir
from stewardry.sources.metadata import columns_of, session_properties, session_tables, tables_of
from stewardry.sources.registers import decision_systems, recipient_templates


def test_session_catalog_feeds_the_freshness_job(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS meta_test")
    spark.sql("""CREATE OR REPLACE TEMPORARY VIEW meta_rows AS SELECT 1 AS id, timestamp'2024-01-01 00:00:00' AS _updated_at""")
    spark.sql(f"CREATE TABLE meta_test.t USING parquet LOCATION '{tmp_path}/t' TBLPROPERTIES ('platform.freshness_sla' = '4h') AS SELECT * FROM meta_rows")
    try:
        tables = session_tables(spark, "silver", "meta_test")
        assert set(tables) == {"silver.meta_test.t"}  # the session's temporary views do not belong to it
        props = session_properties(spark, "silver", "meta_test")
        columns = columns_of(spark, tables)
        expected = lc.tables_with_column(columns, "_updated_at")
        row = lc.freshness_metrics(expected, lc.update_times(tables), props).collect()[0]
        assert (row.full_table_name, row.freshness_sla, row.freshness_sla_minutes, row.error) == ("silver.meta_test.t", "4h", 240, None)
        flags = lc.structural_compliance(tables_of(spark, tables), columns).collect()[0]
        assert (flags.has_inserted_at, flags.has_updated_at, flags.has_delete_at) == (False, True, False)
        out = str(tmp_path / "metrics")
        for _ in range(2):
            lc.write_metrics(lc.freshness_metrics(expected, lc.update_times(tables), props), out)
        assert spark.read.parquet(out).count() == 1
    finally:
        spark.sql("DROP TABLE IF EXISTS meta_test.t")


def test_registers(spark, tmp_path):
    systems = {r.id: r for r in decision_systems(spark, REGISTER).collect()}
    assert set(systems) == {"fare-check", "loyalty-tier"} and systems["fare-check"].solely_automated
    path = tmp_path / "phrases.json"
    path.write_text('{"templates": [{"label": "Internal only", "text": "No one outside [company]."}]}')
    assert recipient_templates(spark, str(path)).collect()[0].label == "Internal only"


def test_sla_text_keeps_working_on_columns(spark):
    df = spark.createDataFrame([("2h",)], "v string")
    assert df.select(sla_minutes("v").alias("m")).collect()[0].m == 120


def _folders(spark):
    root = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(root))


def test_scratch_leaves_nothing_but_what_is_kept(spark):
    before = _folders(spark)
    with scratch(spark) as used:
        first = materialise(spark.range(5).toDF("x"), "gone")
        kept = used.keep(materialise(first.filter("x > 2"), "kept"))
        assert len(_folders(spark) - before) == 2
    assert [f.split("-")[0] for f in _folders(spark) - before] == ["kept"] and kept.count() == 2
    release(spark, [kept.scratch_path])
    with pytest.raises(RuntimeError), scratch(spark):
        materialise(spark.range(5).toDF("x"), "gone")
        raise RuntimeError("a failing job")
    assert _folders(spark) == before


def test_queries_leave_no_copies(spark):
    before = _folders(spark)
    with scratch(spark):
        registry.QUERIES["find_subject_copies"](spark, "/root/testdata/sf0.001").count()
        assert _folders(spark) != before
    assert _folders(spark) == before


def test_a_cluster_may_share_a_mounted_folder(spark, monkeypatch):
    """F1 to F24: the scheme of a folder does not tell whether the machines share it; writing there does."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    monkeypatch.setattr(session, "_seen_shared", set(), raising=False)
    before = _folders(spark)
    assert session.materialise(spark.range(7).toDF("x"), "mounted").count() == 7
    left = {f.split("-")[0] for f in _folders(spark) - before}
    assert left == {"mounted"} and session._seen_shared == {shared_dir(spark)}


@pytest.mark.parametrize("name", ["audit_kpis_from_states", "freshness_table", "lineage_cache_untouched", "erasure_requests_pending"])
def test_queries_that_keep_steps_run_on_a_cluster(spark, monkeypatch, name):
    """with a mounted checkpoint folder and another master than a local one."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    monkeypatch.setattr(session, "_seen_shared", set(), raising=False)
    with scratch(spark):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    monkeypatch.setattr(session, "_seen_shared", set(), raising=False)
    monkeypatch.setattr(type(spark.range(1)), "count", lambda self: 3)  # rows of other machines are not there
    with pytest.raises(RuntimeError, match="not shared"):
        shared_dir(spark)
