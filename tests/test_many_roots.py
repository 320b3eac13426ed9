"""More start nodes than the driver takes, over few edges: none is lost."""

from tracewell.operators import closure


def test_no_root_is_lost(spark, monkeypatch):
    monkeypatch.setattr(closure, "SMALL_EDGES", 4)
    edges = spark.createDataFrame([("n0", "n1"), ("n1", "n2")], "src string, dst string")
    roots = spark.createDataFrame([(f"n{i}",) for i in range(9)] + [("n0",)], "node string")
    assert {(r.node, r.distance) for r in closure.reach(edges, roots, "down").collect()} == {(f"n{i}", 0) for i in range(9)}
    got = [tuple(r) for r in closure.reach_pairs(edges, roots, "down").collect()]
    assert sorted(got) == sorted([(f"n{i}", f"n{i}", 0) for i in range(9)] + [("n0", "n1", 1), ("n0", "n2", 2), ("n1", "n2", 1)])
