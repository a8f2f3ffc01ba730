"""Driver contract: entry() smoke run and stable schema."""

import __spark_entry__ as entry_mod


def test_entry_runs_on_smallest_scale(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["keyword", "count", "size", "band", "color", "label", "caption", "first_seen", "last_seen"]


def test_entry_schema_is_stable(spark):
    assert entry_mod.entry(spark).schema == entry_mod.entry(spark).schema
