"""Components: how large the plans of a round are, and which nodes they connect."""

from collections import Counter

from vitrine.llm import shared


def test_a_round_reads_its_edges_at_few_places(spark, monkeypatch):
    """A driver holds the whole plan; 18 and more scans of one small table took it beyond its memory in the pipeline."""
    plans = []

    def told(df, cut=shared.cut):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
        return cut(df)

    monkeypatch.setattr(shared, "cut", told)
    for n, most in ((40, 4), (900, 9)):
        lines = [(m, m + 1) for m in range(1, n) if m % 30] + [(5000, m) for m in range(5001, 5001 + 2 * n)]
        found = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(lines, "a long, b long")).collect()}
        assert found == {x: 5000 if x >= 5000 else (x - 1) // 30 * 30 + 1 for pair in lines for x in pair}
        assert 0 < max(plans) <= most, Counter(plans)
        plans.clear()
