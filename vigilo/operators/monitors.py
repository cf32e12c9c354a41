"""Daily monitors of a scored stream against a reference period.

Distributions are compared by exact histograms: rows become (day, value)
counts first, so what is sorted and joined are distinct values, and a day or a
value with very many rows costs no more than its counts.  Null and NaN values
are left out of a distribution; a day without values has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import prefix, quantiles

#: Bins between the reference's deciles, and the least share that a bin counts with.
BINS = 10
FLOOR = 1e-4


def _values(df: DataFrame, value: str, *keys: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def psi(df: DataFrame, reference: DataFrame, value: str, day: str = "day") -> DataFrame:
    """Per day: rows and the population stability index over the reference's decile bins, a cut in the lower bin."""
    # nine cuts and ten shares: plain numbers, as a subquery would be planned again in each place
    cuts = quantiles(reference, [value], [i / BINS for i in range(1, BINS)]).select("q").first()
    cuts = [F.lit(c).cast("double") for c in (cuts.q if cuts else [None] * (BINS - 1))]
    place = sum(((F.col("v") > cuts[i]).cast("int") for i in range(BINS - 1)), F.lit(0))
    share = F.array(*[F.greatest(F.sum(F.when(F.col("b") == i, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(FLOOR)) for i in range(BINS)])
    base = _values(reference, value).withColumn("b", place).agg(share.alias("r")).first().r
    days = _values(df, value, day).withColumn("b", place).groupBy(day).agg(F.sum("n").alias("n"), share.alias("p")).withColumn("r", F.array(*[F.lit(x).cast("double") for x in base or [None] * BINS]))
    return days.select(day, "n", sum(((F.col("p")[i] - F.col("r")[i]) * F.log(F.col("p")[i] / F.col("r")[i]) for i in range(BINS)), F.lit(0.0)).alias("value"))


def ks(df: DataFrame, reference: DataFrame, value: str, day: str = "day") -> DataFrame:
    """Per day: rows and the two-sample Kolmogorov-Smirnov distance.  Between two values of the day only the reference's
    share grows, so the distance is met at a value of the day or just before one."""
    own = _values(df, value, day)
    ref = own.select("v").distinct().join(_values(reference, value).withColumnRenamed("n", "r"), "v", "full_outer")
    ref = prefix(ref.withColumn("r", F.coalesce("r", F.lit(0).cast("long"))), [], ["v"], {"r": "r"}).select("v", "r", "cum_r", "total_r")
    own = prefix(own, [day], ["v"], {"n": "n"}).join(ref, "v")
    at = F.abs(F.col("cum_n") / F.col("total_n") - F.col("cum_r") / F.col("total_r"))
    before = F.abs((F.col("cum_n") - F.col("n")) / F.col("total_n") - (F.col("cum_r") - F.col("r")) / F.col("total_r"))
    return own.groupBy(day).agg(F.sum("n").alias("n"), F.max(F.greatest(at, before)).alias("value"))


def rates(df: DataFrame, flags: dict[str, Column], day: str = "day", reference: DataFrame | None = None) -> DataFrame:
    """One row per day and flag: rows with the flag known, and the share where it holds (less the reference's share)."""
    base = reference.agg(*[F.avg(c.cast("double")).alias(k) for k, c in flags.items()]).first() if reference is not None else None
    aggs = [F.struct(F.lit(k).alias("monitor"), F.count(c).alias("n"), F.avg(c.cast("double")).alias("value")) for k, c in flags.items()]
    less = F.lit(0.0) if base is None else F.coalesce(*[F.when(F.col("x.monitor") == k, F.lit(base[k]).cast("double")) for k in flags])
    return df.groupBy(day).agg(F.array(*aggs).alias("m")).withColumn("x", F.explode("m")).select(day, F.col("x.monitor").alias("monitor"), F.col("x.n").alias("n"), (F.col("x.value") - less).alias("value"))
