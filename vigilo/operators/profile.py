"""One-scan profiling, lift and drift tables.

Design rules: every table is a grouped aggregate with map-side partial
combine; several group-bys over the same scan are folded into one
``explode``d grouping (Spark's Expand+Aggregate, i.e. GROUPING SETS); global
scalars come from the grouped result itself (a window over the tiny
aggregate) instead of a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import flag
from .ranks import quantile_list, quantiles


def r6(c) -> Column:
    """Round a float output to 6 decimals as ``round(x * 1e6) / 1e6`` in
    double arithmetic — the same rounding SQL engines apply to doubles, so
    results agree bit-for-bit with an external oracle (Spark's decimal
    ``round`` resolves near-half values differently)."""
    x = c if isinstance(c, Column) else F.col(c)
    return F.round(x * F.lit(1e6)) / F.lit(1e6)


def _unpivot_cats(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"),
                               F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs), F.col(label))


def lift_table(df: DataFrame, cols: list[str], label: str = "is_fraud",
               min_support: int = 0) -> DataFrame:
    """count / positives / rate % / lift per value of each column in ``cols``,
    all columns in one scan.  Null values are kept for the global rate and
    dropped from the output (pandas groupby drops null keys)."""
    g = (_unpivot_cats(df, cols, label)
         .groupBy("feature", "value")
         .agg(F.count(F.lit(1)).alias("tx_count"), F.sum(label).cast("bigint").alias("fraud_count")))
    w = Window.partitionBy("feature")
    g = g.withColumn("_global", F.sum("fraud_count").over(w) / F.sum("tx_count").over(w))
    rate = F.col("fraud_count") / F.col("tx_count")
    out = g.where(F.col("value").isNotNull() & (F.col("tx_count") >= min_support))
    return out.select("feature", "value", "tx_count", "fraud_count",
                      r6(rate * 100).alias("fraud_rate"),
                      r6(F.try_divide(rate, F.col("_global"))).alias("lift"))


def lift_pairs(df: DataFrame, pairs: list[tuple[str, str]], label: str = "is_fraud",
               min_support: int = 5000, top: int = 10) -> DataFrame:
    """Lift over column pairs with minimum support, top ``top`` by lift per
    pair (ties broken by the pair values)."""
    arr = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"),
                             F.col(a).cast("string").alias("v1"),
                             F.col(b).cast("string").alias("v2")) for a, b in pairs])
    g = (df.select(F.inline(arr), F.col(label))
           .groupBy("pair", "v1", "v2")
           .agg(F.count(F.lit(1)).alias("tx_count"), F.sum(label).cast("bigint").alias("fraud_count")))
    w = Window.partitionBy("pair")
    g = g.withColumn("_global", F.sum("fraud_count").over(w) / F.sum("tx_count").over(w))
    rate = F.col("fraud_count") / F.col("tx_count")
    g = (g.where(F.col("v1").isNotNull() & F.col("v2").isNotNull()
                 & (F.col("tx_count") >= min_support))
          .withColumn("lift", F.try_divide(rate, F.col("_global"))))
    rk = F.row_number().over(Window.partitionBy("pair").orderBy(
        F.desc("lift"), F.asc("v1"), F.asc("v2")))
    return (g.withColumn("rnk", rk).where(F.col("rnk") <= top)
             .select("pair", "v1", "v2", "tx_count", "fraud_count",
                     r6(rate * 100).alias("fraud_rate"), r6("lift").alias("lift"),
                     F.col("rnk").cast("int").alias("rnk")))


def summary(df: DataFrame, ts: str = "ts", label: str = "is_fraud") -> DataFrame:
    n = F.count(F.lit(1))
    pos = F.sum(label).cast("bigint")
    return df.agg(n.alias("rows"),
                  F.unix_micros(F.min(ts)).alias("min_ts_us"),
                  F.unix_micros(F.max(ts)).alias("max_ts_us"),
                  pos.alias("fraud_count"), (n - pos).alias("legit_count"),
                  r6(pos / n * 100).alias("fraud_rate"))


def schema_audit(df: DataFrame) -> DataFrame:
    """Per column: dtype, nulls, null %, distinct (nulls excluded), role.

    Columns are unpivoted to (column, value), equal pairs are counted, and the
    counts are summed by column, so no row is copied whole."""
    from ..functions.features import column_role_expr
    types = dict(df.dtypes)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    seen = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    names = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    long = seen.groupBy("column").agg(F.sum("n").alias("_n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
                                      F.count("value").alias("unique_count")).withColumn("dtype", names[F.col("column")])
    return long.select("column", "dtype", "missing",
                       r6(F.col("missing") / F.col("_n") * 100).alias("missing_pct"),
                       "unique_count",
                       column_role_expr(F.col("column"), F.col("dtype")).alias("role"))


def imbalance(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    p = F.avg(label)
    return df.agg(p.alias("_p")).select(
        r6((1 - F.col("_p")) * 100).alias("majority_accuracy"),
        r6(F.when(F.col("_p") > 0, (1 - F.col("_p")) / F.col("_p")).otherwise(0.0))
        .alias("imbalance_ratio"))


def rate_by(df: DataFrame, key: Column | str, name: str, label: str = "is_fraud") -> DataFrame:
    return (df.groupBy(F.col(key).alias(name) if isinstance(key, str) else key.alias(name))
              .agg(F.count(F.lit(1)).alias("tx_count"), r6(F.avg(label) * 100).alias("fraud_rate")))


DESCRIBE_PCTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def describe_by(df: DataFrame, col: str, by: str = "is_fraud",
                pcts: list[float] = DESCRIBE_PCTS) -> DataFrame:
    """pandas ``describe`` per group: count, mean, sample std, min, the given
    percentiles (linear interpolation, exact) and max."""
    g = df.groupBy(by).agg(F.count(col).alias("count"), r6(F.avg(col)).alias("mean"),
                           r6(F.stddev_samp(col)).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    g = g.join(quantiles(df, [col], pcts, [by]).withColumnRenamed("q", "_p"), by, "left")
    return g.select(by, "count", "mean", "std", "min",
                    *[r6(F.col("_p")[i]).alias(f"p{int(round(p * 100))}") for i, p in enumerate(pcts)],
                    "max")


def median_by(df: DataFrame, cols: list[str], by: str = "is_fraud") -> DataFrame:
    q = quantiles(df, cols, [0.5], [by])
    return q.groupBy(by).agg(*[r6(F.max(F.when(F.col("column") == c, F.col("q")[0]))).alias(f"median_{c}") for c in cols])


def sign_audit(df: DataFrame, col: str, label: str = "is_fraud") -> DataFrame:
    """Null / negative / zero / positive counts, range, mean, median, seven
    percentiles, and the negative share per label (nulls in the denominator)."""
    c = F.col(col)
    neg_rate = lambda v: r6(F.count_if((c < 0) & (F.col(label) == v)) /
                            F.count_if(F.col(label) == v) * 100)
    g = df.agg(F.count_if(c.isNull()).alias("null_count"), F.count_if(c < 0).alias("negative_count"),
               F.count_if(c == 0).alias("zero_count"), F.count_if(c > 0).alias("positive_count"),
               F.min(c).alias("min"), F.max(c).alias("max"), r6(F.avg(c)).alias("mean"),
               neg_rate(1).alias("neg_rate_fraud"), neg_rate(0).alias("neg_rate_legit"))
    g = g.withColumn("_p", quantile_list(df, col, DESCRIBE_PCTS)).withColumn("median", r6(F.col("_p")[DESCRIBE_PCTS.index(0.5)]))
    return g.select(*[F.col(x).cast("bigint").alias(x) for x in
                      ("null_count", "negative_count", "zero_count", "positive_count")],
                    "min", "max", "mean", "median",
                    *[r6(F.col("_p")[i]).alias(f"p{int(round(p * 100))}") for i, p in enumerate(DESCRIBE_PCTS)],
                    "neg_rate_fraud", "neg_rate_legit")


def lift_by_flag(df: DataFrame, flag_col: str, amount: str = "amount",
                 label: str = "is_fraud") -> DataFrame:
    g = df.groupBy(flag_col).agg(F.count(F.lit(1)).alias("tx_count"),
                                 F.sum(label).cast("bigint").alias("fraud_count"))
    med = quantiles(df, [amount], [0.5], [flag_col])
    g = g.join(med.select(flag_col, r6(F.col("q")[0]).alias("median_amount")), flag_col, "left")
    w = Window.partitionBy()  # over the ≤ 3 grouped rows only
    glob = F.sum("fraud_count").over(w) / F.sum("tx_count").over(w)
    rate = F.col("fraud_count") / F.col("tx_count")
    return g.select(flag_col, "tx_count", "fraud_count", "median_amount",
                    r6(rate * 100).alias("fraud_rate"), r6(F.try_divide(rate, glob)).alias("lift"))


def quantile_edges(df: DataFrame, col: str, q: int) -> Column:
    """Scalar subquery with the distinct quantile edges of ``col`` (pandas
    ``qcut(q, duplicates='drop')`` edges: linear interpolation).  Evaluated
    once and shipped to the tasks as a constant — no join."""
    return quantiles(df, [col], [i / q for i in range(q + 1)]).agg(F.array_sort(F.array_distinct(F.first("q")))).scalar()


def bucket_index(x: Column, edges: Column, q: int) -> Column:
    """Interval index for ``(e_i, e_{i+1}]`` with the lowest edge included:
    the number of inner edges strictly below ``x`` (at most ``q - 1``)."""
    n = F.size(edges)
    terms = [F.when((F.lit(i) < n - 1) & (edges[i] < x), 1).otherwise(0) for i in range(1, q)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def lift_buckets(df: DataFrame, col: str, q: int, label: str = "is_fraud") -> DataFrame:
    """Quantile-bucket lift table (edges as one scalar subquery)."""
    edges = quantile_edges(df, col, q)
    j = df.select(col, label).withColumn("bucket", bucket_index(F.col(col), edges, q))
    g = j.groupBy("bucket").agg(F.count(F.lit(1)).alias("tx_count"),
                                F.sum(label).cast("bigint").alias("fraud_count"))
    w = Window.partitionBy()  # over the ≤ q grouped rows only
    glob = F.sum("fraud_count").over(w) / F.sum("tx_count").over(w)
    rate = F.col("fraud_count") / F.col("tx_count")
    return g.select(F.col("bucket").cast("int").alias("bucket"),
                    r6(edges[F.col("bucket")]).alias("lower"),
                    r6(edges[F.col("bucket") + 1]).alias("upper"),
                    "tx_count", "fraud_count", r6(rate * 100).alias("fraud_rate"),
                    r6(F.try_divide(rate, glob)).alias("lift"))


def rate_minmax(df: DataFrame, cols: list[str], label: str = "is_fraud") -> DataFrame:
    """Per column: highest/lowest category rate and lift (two-level agg)."""
    t = lift_table(df, cols, label)
    return t.groupBy("feature").agg(F.max("fraud_rate").alias("max_rate"),
                                    F.min("fraud_rate").alias("min_rate"),
                                    F.max("lift").alias("max_lift"),
                                    F.min("lift").alias("min_lift"),
                                    F.count(F.lit(1)).alias("n_values"))


def entity_top(df: DataFrame, entities: list[str], label: str = "is_fraud",
               top: int = 5, min_support: int = 20) -> DataFrame:
    """Per entity column: top-``top`` by fraud count and top by fraud rate
    (support ≥ ``min_support``); ties broken by the entity value.  The
    per-entity counts are one grouped pass; the top-k is a per-column
    ``row_number`` over the aggregated table (TakeOrdered per group)."""
    arr = F.array(*[F.struct(F.lit(e).alias("entity_col"),
                             F.col(e).cast("string").alias("entity")) for e in entities])
    g = (df.select(F.inline(arr), F.col(label))
           .groupBy("entity_col", "entity")
           .agg(F.count(F.lit(1)).alias("tx_count"), F.sum(label).cast("bigint").alias("fraud_count")))
    by_count = (g.withColumn("rnk", F.row_number().over(
        Window.partitionBy("entity_col").orderBy(F.desc("fraud_count"), F.asc("entity"))))
        .where(F.col("rnk") <= top).withColumn("ranking", F.lit("fraud_count"))
        .withColumn("fraud_rate", F.lit(None).cast("double")))
    sup = g.where(F.col("tx_count") >= min_support).withColumn(
        "fraud_rate", r6(F.col("fraud_count") / F.col("tx_count") * 100))
    by_rate = (sup.withColumn("rnk", F.row_number().over(
        Window.partitionBy("entity_col").orderBy(F.desc("fraud_rate"), F.asc("entity"))))
        .where(F.col("rnk") <= top).withColumn("ranking", F.lit("fraud_rate")))
    cols = ["entity_col", "ranking", "entity", "tx_count", "fraud_count", "fraud_rate",
            F.col("rnk").cast("int").alias("rnk")]
    return by_count.select(*cols).unionByName(by_rate.select(*cols))


def customer_stats(df: DataFrame, key: str = "sender_account", amount: str = "amount",
                   label: str = "is_fraud") -> DataFrame:
    return df.groupBy(key).agg(r6(F.avg(amount)).alias("amount_mean"),
                               F.max(amount).alias("amount_max"),
                               F.count(amount).alias("amount_count"),
                               F.sum(label).cast("bigint").alias("fraud_sum"),
                               r6(F.avg(label)).alias("fraud_rate"))


def consistency(df: DataFrame, type_col: str = "fraud_type", label: str = "is_fraud") -> DataFrame:
    """Positives with null type, negatives with a type, and value counts
    (null kept as its own group) — one grouped pass."""
    g = df.groupBy(F.col(type_col).alias("value")).agg(
        F.count(F.lit(1)).alias("value_count"),
        F.count_if((F.col(label) == 1) & F.col(type_col).isNull()).alias("_a"),
        F.count_if((F.col(label) == 0) & F.col(type_col).isNotNull()).alias("_b"))
    whole = g.agg(F.struct(F.sum("_a").cast("bigint").alias("a"), F.sum("_b").cast("bigint").alias("b"))).scalar()
    return g.select("value", "value_count", whole["a"].alias("missing_in_positive"), whole["b"].alias("present_in_negative"))


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    g = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("value_count"))
    if normalize:
        g = g.withColumn("share", r6(F.col("value_count") / g.agg(F.sum("value_count")).scalar()))
    return g


def graph_stats(df: DataFrame, src: str = "sender_account", dst: str = "receiver_account",
                device: str = "device_hash") -> DataFrame:
    """Edge / node counts, sender out-degree distribution, device sharing and
    pair repetition — nested aggregates combined as scalar subqueries."""
    deg = df.groupBy(src).agg(F.count(F.lit(1)).alias("deg"))
    q = quantile_list(deg, "deg", [0.5, 0.99])
    dstats = deg.agg(F.struct(r6(F.avg("deg")).alias("degree_avg"), F.max("deg").cast("bigint").alias("degree_max"))).scalar()
    dev = df.groupBy(device).agg(F.count_distinct(src).alias("ns"))
    dshare = dev.agg(r6(F.avg((F.col("ns") > 1).cast("double")) * 100)).scalar()
    pairs = df.groupBy(src, dst).agg(F.count(F.lit(1)).alias("c"))
    prep = pairs.agg(r6(F.avg((F.col("c") > 1).cast("double")) * 100)).scalar()
    base = df.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct(src).alias("senders"),
                  F.count_distinct(dst).alias("receivers"), F.count_distinct(device).alias("devices"))
    out = base.select("*", dstats.alias("_d"), q.alias("_q"), dshare.alias("pct_devices_shared"),
                      prep.alias("pct_pairs_repeated")).select(
        "edges", "senders", "receivers", "devices", "_d.degree_avg", r6(F.col("_q")[0]).alias("degree_p50"),
        r6(F.col("_q")[1]).alias("degree_p99"), "_d.degree_max", "pct_devices_shared",
        "pct_pairs_repeated")
    return out.withColumn(
        "density", F.when((F.col("pct_devices_shared") < 5) & (F.col("pct_pairs_repeated") < 5),
                          "sparse").otherwise("dense"))


def drift_split(gi: DataFrame, ts: str = "ts", label: str = "is_fraud",
                frac: float = 0.8) -> DataFrame:
    """Size, rate and cut-off time before/after the ``frac`` time cut (input
    carries ``global_index`` and ``_total`` from ``order.global_index``)."""
    cut = F.floor(F.col("_total") * F.lit(frac))
    x = gi.select(F.when(F.col("global_index") < cut, "train_inner").otherwise("validation").alias("split"),
                  label,
                  F.when(F.col("global_index") == cut, F.unix_micros(ts)).alias("_c"))
    g = x.groupBy("split").agg(F.count(F.lit(1)).alias("tx_count"),
                               r6(F.avg(label) * 100).alias("fraud_rate"), F.max("_c").alias("_c"))
    w = Window.partitionBy()  # two grouped rows
    return g.select("split", "tx_count", "fraud_rate", F.max("_c").over(w).alias("cutoff_us"))


def flag_audit_splits(df: DataFrame, flags: list[str], names: list[str] | None = None,
                      split: str = "split") -> DataFrame:
    """Flag counts for the whole table and each split in one pass: each row
    is counted under 'all' and under its own split (explode of 2)."""
    names = names or flags
    x = df.select(F.explode(F.array(F.lit("all"), F.col(split))).alias("dataset"), *flags)
    return x.groupBy("dataset").agg(*[F.sum(f).cast("bigint").alias(n) for f, n in zip(flags, names)],
                                    F.count(F.lit(1)).alias("tx_count"))
