"""Running values over ranges against plain windows, with groups that span many ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxledger.operators.lineage import Scan


@pytest.mark.parametrize("by", [("g",), ("g", "h"), ()])
def test_scan_is_the_window(spark, by):
    rng = random.Random(4)
    groups = ["hot"] * 6 + ["a", None, "b"]
    rows = [(rng.choice(groups), rng.randrange(2), i, rng.choice([None, "x", "y", "z"]), rng.randrange(5)) for i in rng.sample(range(3000), 2000)]
    table = spark.createDataFrame(rows, "g string, h int, o int, v string, n int").repartition(7)
    scan = Scan(table, by, [-F.col("o")]).add(number="k", lags={"was": F.col("v")}, sums={"s": F.col("n")})
    new = ~F.coalesce(F.col("was") == F.col("v"), F.lit(False))
    got = scan.add(sums={"runs": new.cast("int")}, fills={"filled": F.col("v"), "start": F.when(new, F.col("k"))}).done()
    w = Window.partitionBy(*by).orderBy(F.desc("o"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    want = table.withColumns({"k": F.row_number().over(w), "was": F.lag("v").over(w), "s": F.sum("n").over(so_far)})
    want = want.withColumns({"runs": F.sum(new.cast("int")).over(so_far), "filled": F.last("v", ignorenulls=True).over(so_far), "start": F.last(F.when(new, F.col("k")), ignorenulls=True).over(so_far)})
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, (tuple(r) for r in want.collect())))
    assert Scan(table.limit(0), by, [F.col("o")]).add(number="k", fills={"f": F.col("v")}).done().count() == 0


def test_no_group_is_one_task_s(spark):
    rows = spark.range(20_000).selectExpr("'hot' as g", "id as o")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join so small ranges
    try:
        assert Scan(rows, ("g",), [F.col("o")]).rows.select("_range").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
