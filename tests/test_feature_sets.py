"""Feature sets joined on the panel key beside the same sets in one plan."""

from __future__ import annotations

from weekcast.plans import features


def test_temporal_set_is_built_per_date(spark, panel, monkeypatch):
    """Not per row of the panel, so that no exchange on the panel key holds its columns; the result is the same."""
    seen, plain = [], features.temporal_features
    monkeypatch.setattr(features, "temporal_features", lambda df, *args: seen.append(df) or plain(df, *args))
    panel = panel.unionByName(panel.limit(1).selectExpr("'late' store", "product", "year", "week + 60 AS week", "date(NULL) AS week_date", "quantity"))
    got = features.all_features_parallel(panel)
    assert seen[0].columns == ["week_date"] and seen[0].count() == 21
    want = plain(panel)
    assert got.columns[: len(want.columns)] == want.columns
    key = ["store", "product", "year", "week"]
    assert got.select(want.columns).orderBy(key).collect() == want.orderBy(key).collect()
