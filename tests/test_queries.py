"""Every registered query resolves, and a sample runs on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def test_registry():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 130


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_entry_and_sample(spark):
    assert entry(spark).columns == ["query_id", "seq", "score", "source", "doc_name", "kind"]
    for name in ("occurrences", "entry_rollup", "page_variants", "snapshot_diff", "rank_fusion"):
        assert queries()[name](spark, FOLDER).count() > 0
