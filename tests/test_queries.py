"""Queries against their SQL on the smallest tables, and the shape of the registry."""

import math
import os

import duckdb
import pytest

from borelake.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["label_coverage", "baseline_cells", "axis_audit_mixed", "axis_overlap", "interpolated", "nearest_match", "pose_on_image", "rotated_cells", "qc_image",
    "isolated_outliers", "threshold_grid", "label_samples", "association", "rank_correlation", "scaled_features", "bearing_windows", "hypothesis_totals",
    "attribute_votes", "manifest_missing", "label_gate", "field_scores", "intake_gate", "sliding_best", "sample_gate", "published_labels", "turned_energy",
    "sample_ranges", "transform_report", "axes_agree"]


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{float(v):.5g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(tuple(r) for r in df.select(columns).collect()) == plain(found.fetchall())


@pytest.mark.parametrize("name", ["axis_audit_up", "axis_audit_mixed", "alignment_gate"])
def test_events_of_few_samples(spark, tmp_path, name):
    """A series of one sample has no steps to count; the step of a series of two spans it whole, and does not when rounded up."""
    con = duckdb.connect()
    rows = [(1, "click", 0.0), (1, "click", 10.0), (1, "click", 20.0), (1, "click", 30.0), (1, "view", 5.0), (1, "view", 15.0006), (2, "click", 7.0)]
    values = ", ".join(f"({k}::BIGINT, make_timestamp({round(s * 1e6)}), {u}::BIGINT, '{t}', 1.0::DOUBLE)" for k, (u, t, s) in enumerate(rows))
    con.execute(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    found = con.execute(registry.SQL[name])
    columns = [c[0] for c in found.description]
    assert plain(tuple(r) for r in df.select(columns).collect()) == plain(found.fetchall())


def test_registry():
    assert set(registry.SQL) <= set(registry.QUERIES)
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_label_objects_makes_no_other_labels(spark, monkeypatch):
    """Objects need candidates alone: no table of all labels with their confidence."""
    from borelake.operators import labels

    monkeypatch.setattr(labels, "with_confidence", None)
    assert registry.QUERIES["label_objects"](spark, SF).count() > 0
