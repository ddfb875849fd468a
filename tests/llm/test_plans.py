"""What the joins of operators may send whole to the driver and to every task."""

import pytest

from corpus_audit.llm import simhash


@pytest.mark.parametrize("cells", [0, 1_000_000])
def test_exploded_cells_are_not_broadcast(spark, monkeypatch, cells):
    """Spark sizes them like the nodes they were exploded from."""
    plans, stored = {}, simhash.stored

    def planned(df, label):
        plans[label] = df._jdf.queryExecution().sparkPlan().toString()
        return stored(df, label)

    monkeypatch.setattr(simhash, "stored", planned)
    monkeypatch.setattr(simhash, "BROADCAST_CELLS", cells, raising=False)
    nodes = spark.range(3000).selectExpr("id % 1000 AS node").distinct()
    found = simhash.links(nodes).count()
    assert found > 500
    assert ("SortMergeJoin" in plans["cells"]) == (cells == 0)
    assert "BuildLeft" not in plans["cells"]
