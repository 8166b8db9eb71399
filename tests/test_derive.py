from __future__ import annotations

from loomgraph.sources import derive


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    """The pairs of parts are dealt to as many tasks as the lines need, whatever the session's number of partitions."""
    rows = sorted(map(tuple, derive.Graph(spark, "/root/testdata/sf0.001").relations().collect()))
    monkeypatch.setattr(derive, "LINES", 500)
    g = derive.Graph(spark, "/root/testdata/sf0.001")
    tasks = 1 + g.table("lineitem").count() // 500
    found = g.relations()
    assert tasks > 10 and found.rdd.getNumPartitions() == tasks
    assert sorted(map(tuple, found.collect())) == rows
