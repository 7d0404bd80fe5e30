"""Every named query against its DuckDB text, and what the plans must not contain."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from compare import connect, differences

from vitalgrid.plans import registry

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()
QUERIES, CHECKS = registry.QUERIES, registry.CHECKS


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, connection, name):
    assert differences(QUERIES[name](spark, SF_DIR), connection, CHECKS[name]) == []


def test_every_query_is_checked_and_registered():
    """What a trained forest answers has no SQL form; a second query checks what follows from it."""
    without = {"train_triage_forest", "calibrate_isotonic", "score_triage_model", "feature_importances", "training_metrics"}
    assert set(QUERIES) - set(CHECKS) == without and {f"{name}_checks" for name in without} <= set(CHECKS)
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize(
    "name, scanned",
    [
        ("triage_total", 0), ("class_weights", 2), ("latest_run", 4), ("open_events_by_severity", 2), ("duplicate_keys", 2),
    ],
)
def test_scans_read_only_what_they_need(spark, capsys, name, scanned):
    QUERIES[name](spark, SF_DIR).explain("simple")
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", capsys.readouterr().out)
    assert schemas and max(len([c for c in s.split(",") if c]) for s in schemas) <= scanned


@pytest.mark.parametrize("name", ["triage_rules_risk", "vitals_validate", "news2_severity_label", "derive_quality_events", "quality_flags", "assessment_fallback"])
def test_row_local_queries_do_not_sort_or_cross(spark, capsys, name):
    QUERIES[name](spark, SF_DIR).explain("simple")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "Sort [" not in plan and "Python" not in plan


def test_recent_rows_use_a_partial_top_k(spark, capsys):
    QUERIES["recent_events"](spark, SF_DIR).explain("simple")
    assert "TakeOrderedAndProject" in capsys.readouterr().out
