"""Prefix sums and exact quantiles over any number of rows.

Rows are range-partitioned by (group, order) and stored; each range adds the
sums of the group's earlier ranges (a table with a row per range and group) to
its own running sums.  The number of ranges is the session's number of shuffle
partitions, so a range's size doesn't grow when partitions grow with the data,
and a group or value with very many rows covers several ranges or is one
pre-aggregated row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def prefix(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column | str], ranges: int | None = None) -> DataFrame:
    """``df`` with, for each name in ``sums``, the running sum ``cum_<name>`` in the given order (the row
    included) and the group's ``total_<name>``.  Null groups are left out."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d = df.withColumns({f"_s_{k}": v if isinstance(v, Column) else F.col(v) for k, v in sums.items()})
    d = stored(d.repartitionByRange(n, *by, *order).withColumn("_c", F.spark_partition_id()), "prefix")
    part = d.groupBy(*by, "_c").agg(*[F.sum(f"_s_{k}").alias(f"_p_{k}") for k in sums])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*by, "_c", *[F.coalesce(F.sum(f"_p_{k}").over(earlier), F.lit(0)).alias(f"_e_{k}") for k in sums],
                       *[F.sum(f"_p_{k}").over(group).alias(f"total_{k}") for k in sums])
    own = Window.partitionBy(*by, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(part, [*by, "_c"]).withColumns({f"cum_{k}": F.col(f"_e_{k}") + F.sum(f"_s_{k}").over(own) for k in sums})
    return out.drop("_c", *[f"_{x}_{k}" for x in "se" for k in sums])


def quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] = ()) -> DataFrame:
    """``by``, ``column`` and ``q``, the exact quantiles with linear interpolation; nulls don't count, and a
    group without values has no row.  Equal values are counted first, so the rows ranked are distinct values."""
    by = list(by)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    g = df.select(*by, F.inline(pairs)).where("v is not null").groupBy(*by, "column", "v").agg(F.count(F.lit(1)).alias("n"))
    p = prefix(g, [*by, "column"], ["v"], {"n": "n"})
    out = []
    for prob in probs:
        place = F.lit(float(prob)) * (F.col("total_n") - 1)
        low, high = F.floor(place), F.ceil(place)
        at = lambda i: F.max(F.when((F.col("cum_n") - F.col("n") <= i) & (i < F.col("cum_n")), F.col("v")))
        where = F.first(place)
        a, b = at(low), at(high)
        out.append(F.when(a == b, a).otherwise((F.ceil(where) - where) * a + (where - F.floor(where)) * b))
    return p.groupBy(*by, "column").agg(F.array(*out).alias("q"))


def quantile_list(df: DataFrame, column: str, probs: list[float]) -> Column:
    """The quantiles of a column as one scalar subquery: an array, null if there are no values."""
    return quantiles(df, [column], probs).agg(F.first("q")).scalar()
