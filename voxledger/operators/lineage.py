"""Cutting lineage, and numbering rows without one task for all of them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder that the session names; a session on one machine may name none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def looked_up(rows: DataFrame, key: str, own: str, table: DataFrame, of: str) -> DataFrame:
    """``rows`` left joined with ``table`` where ``key`` is its ``of``. Rows without a key go by the hash of their ``own``
    value, so they aren't all in one task."""
    spread = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(own).cast("string"))) == F.xxhash64(F.col(of).cast("string"))
    return rows.join(table, spread & (F.col(key) == F.col(of)), "left")


class Scan:
    """Running values within groups of rows in an order without ties, however large a group is.

    Rows are dealt into ranges of (group, order) and written once. Each range is worked through by itself; a summary of
    each group's part in a range (its count, sums, last values) says what the ranges before it carry into it. There are
    as many summaries as ranges, or groups. ``order`` ascends: negate what shall descend.
    """

    def __init__(self, rows: DataFrame, by: tuple[str, ...], order: list[Column]):
        self.by, self.order = by, [f"_o{i}" for i in range(len(order))]
        keyed = rows.withColumns(dict(zip(self.order, order)))
        self.rows = cut(keyed.repartitionByRange(*by, *self.order).withColumn("_range", F.spark_partition_id()))

    def add(self, number: str | None = None, sums: dict[str, Column] | None = None, fills: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> Scan:
        """Add the row's number from 1, running sums with the row itself, last values that are not null, and values of
        the row before; later calls may use what earlier ones added."""
        sums, fills, lags = dict(sums or {}), fills or {}, lags or {}
        if number is not None:
            sums[number] = F.lit(1)
        place = F.struct(*self.order)
        of = {name: F.sum(c) for name, c in sums.items()}
        of |= {name: F.max_by(F.when(c.isNotNull(), F.struct(c.alias("v"))), F.when(c.isNotNull(), place)) for name, c in fills.items()}
        of |= {name: F.max_by(F.struct(c.alias("v")), place) for name, c in lags.items()}
        before = Window.partitionBy(*self.by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        parts = self.rows.groupBy(*self.by, "_range").agg(*(c.alias(f"_of_{name}") for name, c in of.items()))
        carry = parts.select(*self.by, "_range", *((F.sum(f"_of_{n}") if n in sums else F.last(f"_of_{n}", ignorenulls=True)).over(before).alias(f"_c_{n}") for n in of))
        within = Window.partitionBy(*self.by, "_range").orderBy(*self.order)
        so_far = within.rowsBetween(Window.unboundedPreceding, 0)
        own = {name: F.sum(c).over(so_far) for name, c in sums.items()}
        own |= {name: F.last(F.when(c.isNotNull(), F.struct(c.alias("v"))), ignorenulls=True).over(so_far) for name, c in fills.items()}
        own |= {name: F.lag(F.struct(c.alias("v"))).over(within) for name, c in lags.items()}
        joined = self.rows.withColumns({f"_w_{n}": c for n, c in own.items()}).alias("own").join(carry.alias("b"), _same(self.by))
        value = lambda n: F.col(f"own._w_{n}") + F.coalesce(F.col(f"b._c_{n}"), F.lit(0)) if n in sums else F.coalesce(F.col(f"own._w_{n}"), F.col(f"b._c_{n}"))["v"]
        self.rows = joined.select(*(F.col(f"own.`{c}`") for c in self.rows.columns), *(value(n).alias(n) for n in own))
        return self

    def done(self) -> DataFrame:
        return self.rows.drop("_range", *self.order)


def placed(rows: DataFrame, by: tuple[str, ...], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number within ``by``, from 1, in an ascending order without ties."""
    return Scan(rows, by, order).add(number=name).done()


def _same(by: tuple[str, ...]) -> Column:
    out = F.col("own._range") == F.col("b._range")
    for c in by:
        out = out & F.col(f"own.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out
