"""Approximate lookups settle repeated keys alike, whatever the size of the table."""

import pytest

from quillgrid.operators import lookup as L


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("size", [256, 257, 600])
def test_ties_go_to_the_largest_values(spark, size, forward):
    table = [(float(i // 3), (i * 7) % 11) for i in range(size)]
    facts = [(i, i / 2 - 1) for i in range(2 * size // 3 + 6)]
    out = L.as_of_join(spark.createDataFrame(facts, "id long, x double"), "x", spark.createDataFrame(table, "k double, v long").repartition(5), "k", ["v"], forward)
    best = {}
    for k, v in table:
        best[k] = max(best.get(k, v), v)

    def near(x):
        keys = [k for k in best if (k >= x if forward else k <= x)]
        return best[min(keys) if forward else max(keys)] if keys else None

    assert {r["id"]: r["v"] for r in out.collect()} == {i: near(x) for i, x in facts}
