"""Running sums over a whole table in an order, without gathering it in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gasframe.sources.scratch import written


class Ordered:
    """A table laid out by ranges of ``order`` (columns that name each row once), each with its number in ``$part``.

    Running sums are made in two passes: the sums of each range, of which there are as many as partitions, and, within
    each range, the sums so far, to which those of the ranges before are added.
    """

    def __init__(self, df: DataFrame, *order: str):
        self.order = order
        self.df = written(df.repartitionByRange(*order).withColumn("$part", F.spark_partition_id()), "ordered")

    def before(self, df: DataFrame | None = None, **sums: Column) -> DataFrame:
        """``df`` (the table, or what came from it row by row) with a column for each of ``sums``: the sum over all rows
        before, zero for the first."""
        df = self.df if df is None else df
        names = list(sums)
        totals = df.groupBy("$part").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in sums.items())).orderBy("$part").collect()
        starts = {n: [0, *accumulate(r[n] for r in totals)] for n in names}
        rows = [(r["$part"], *(starts[n][i] for n in names)) for i, r in enumerate(totals)]
        fields = ", ".join(["part int", *(f"`{n}$` bigint" for n in names)])
        first = df.sparkSession.createDataFrame(rows, fields)
        window = Window.partitionBy("`$part`").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        inner = df.withColumns({n: F.coalesce(F.sum(c).over(window), F.lit(0)).cast("bigint") for n, c in sums.items()})
        joined = inner.join(F.broadcast(first), F.col("`$part`") == F.col("part"))
        return joined.withColumns({n: F.col(n) + F.col(f"`{n}$`") for n in names}).drop("part", *(f"{n}$" for n in names))
