"""Steps of the connected components write no more files than their edges need."""

from churnlake.llm import common


def test_few_edges_take_few_tasks(spark, monkeypatch):
    written, write = [], common.stage

    def counted(*a):
        out = write(*a)
        written.append(len(out.inputFiles()))
        return out
    monkeypatch.setattr(common, "stage", counted)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(i, i + 1 if i % 20 else 3_000) for i in range(1_000)] + [(5_000, 5_001)], "a long, b long")
        got = {r.node: r.component for r in common.connected_components(spark, edges).collect()}
        assert len(written) > 2 and max(written[1:]) <= common.LEAST_TASKS
        monkeypatch.setattr(common, "EDGES_A_TASK", 1)  # many edges are not brought together
        written.clear()
        assert {r.node: r.component for r in common.connected_components(spark, edges).collect()} == got
        assert max(written[1:]) > common.LEAST_TASKS
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = {5_000: 5_000, 5_001: 5_000}
    parent = {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x
    for i in range(1_000):
        a, b = sorted((top(i), top(i + 1 if i % 20 else 3_000)))
        parent[b] = a
    want |= {x: top(x) for x in [*range(1_001), 3_000]}
    assert got == want
