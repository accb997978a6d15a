"""Numbering and running figures without a key, on a table that Spark cuts at samples and coalesces."""

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import aggregates, arrays, ranking

ROWS = 3_000_000


@pytest.fixture(scope="module")
def wide(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # a third of the rows share one value
    x = F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_000)))
    yield spark.range(ROWS).select("id", x.alias("x"), F.lit(1).alias("one"), F.repeat(F.lit("p"), 64).alias("payload"))
    for k, v in before.items():
        spark.conf.set(k, v)


def test_positions_are_gapless_and_ordered(wide):
    got = arrays.numbered(wide, [F.col("x"), F.col("id")])
    sums = got.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()
    assert tuple(sums) == (ROWS, ROWS, 1, ROWS)
    twelve = got.where("pos <= 12").orderBy("pos").select("x", "id").collect()
    assert twelve == wide.select("x", "id").orderBy("x", "id").limit(12).collect()


def test_running_totals_reach_the_sum(wide):
    got = ranking.running_total_over_all(wide, "one", ["x", "id"]).agg(F.count("*"), F.count_distinct("running"), F.max("running")).first()
    assert tuple(got) == (ROWS, ROWS, ROWS)


def test_ranks_and_percentiles_over_all(wide):
    ranks = ranking.rank_over_all(wide, "x", ascending=True)
    top = wide.agg(F.max("x")).first()[0]
    n_top, n = wide.where(F.col("x") == top).count(), ranks.count()
    assert n == ROWS and ranks.agg(F.max("rank")).first()[0] == ROWS - n_top + 1
    assert aggregates.PERCENTILE_EXC(wide, "x", 0.2).first()[0] == 7.0
