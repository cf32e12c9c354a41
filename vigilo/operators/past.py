"""Leakage-safe historical features (the window core).

Two notions of "the past" of a row within its entity:

* ``positional`` — rows before it in the (ts, tie-break) order;
* ``strict``     — rows with a strictly smaller timestamp (tie peers excluded).

Every feature is a window partitioned by the entity key(s).

Large keys.  ``placed`` range-partitions the rows by (entity, time) and stores
them, so every partition (chunk ``_c``) has about the same number of rows and
an entity with very many rows, or a null entity, covers several chunks.
Windows are partitioned by (keys, _c).  At most one entity goes on from a
chunk to the next, so the entities that cover several chunks are known from the
chunks' first and last keys; only those get *carry* rows, which hold the
aggregate of all earlier chunks and stand before the chunk's first row.  Counts,
sums, maxima, minima and variances (as count, mean and second moment) continue
across chunks, and results don't depend on where chunks end.

Where no entity has more than ``HOT_ROWS`` rows, none of this is needed: the rows are shuffled once by entity
(``gathered``), and all windows of the entity work on that.

Several features of one entity share a placement and one shuffle: ``together``
takes their carry rows from the placed rows, and its windows are all partitioned
by (entity, range) at least.  Features of several entities are computed ``beside``
each other from narrow rows and joined by the rows' id.

A rolling window is a running sum too: each row enters at its time and leaves
at its time plus the window's length, so it needs no frame of bounded time and
is split like any other running sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import flag
from ..session import stored

DAY_US = 86_400_000_000
DURATIONS = {"24h": DAY_US, "1d": DAY_US, "7d": 7 * DAY_US, "30d": 30 * DAY_US}

HOT_ROWS = 500_000  # an entity with more rows is split over ranges


def duration_us(w: str | int) -> int:
    return w if isinstance(w, int) else DURATIONS[w]


def placed(df: DataFrame, keys: list[str], ts: str = "ts", chunks: int | None = None, order: list[str] = ()) -> DataFrame:
    """``df`` stored in ranges of (keys, time), with ``_t`` (microseconds), ``_c`` (the range's number) and ``_span``
    (whether the row's entity covers several ranges).  Rows of one entity and time share a range, unless an
    ``order`` beyond the time is given: then they may be split too (for positional functions).

    Pass the result to several functions of the same entity to place the rows once; ``unplaced`` drops the
    columns."""
    keys = list(keys)
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d = df.withColumn("_t", F.unix_micros(F.col(ts)))
    d = stored(d.repartitionByRange(n, *keys, "_t", *order).withColumn("_c", F.spark_partition_id().cast("long")), "placed")
    k = F.struct(*keys)
    ends = d.groupBy("_c").agg(F.min(k).alias("first"), F.max(k).alias("last"))  # a row per range
    a = ends.select(F.col("_c").alias("a"), F.col("last").alias("_k"))
    b = ends.select(F.col("_c").alias("b"), F.col("first").alias("_k2"))
    span = a.join(b, (F.col("a") < F.col("b")) & F.col("_k").eqNullSafe(F.col("_k2"))).select("_k").distinct()
    flag_ = F.broadcast(span.withColumn("_span", F.lit(True)))  # fewer rows than ranges
    return d.join(flag_, k.eqNullSafe(F.col("_k")), "left").drop("_k").withColumn("_span", F.coalesce("_span", F.lit(False)))


def gathered(df: DataFrame, keys: list[str], ts: str = "ts", chunks: int | None = None, order: list[str] = ()) -> DataFrame:
    """``df`` shuffled by ``keys`` with ``_t``, if no entity has more than ``HOT_ROWS`` rows; else (or if ``chunks`` are
    asked for) ``placed``."""
    if chunks is None and df.groupBy(*keys).count().where(F.col("count") > HOT_ROWS).isEmpty():
        return df.withColumn("_t", F.unix_micros(F.col(ts))).repartition(*keys)
    return placed(df, keys, ts, chunks, order)


def unplaced(df: DataFrame) -> DataFrame:
    return df.drop("_t", "_c", "_span")


_KINDS = ("count", "sum", "max", "min", "var")


def running(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, Column | None]],
            ts: str = "ts", order: list[str] = ("transaction_id",), ties: str = "positional",
            include_current: bool = False, chunk_keys: list[str] | None = None,
            chunks: int | None = None) -> DataFrame:
    """Running aggregates over each row's past within ``keys``.

    ``measures`` maps output name → (kind, value column); kinds are
    count / sum / max / min / var (population variance).  Frame: positional
    ``ROWS UNBOUNDED PRECEDING .. -1`` or strict ``RANGE .. -1 µs``
    (``include_current`` ends the positional frame at the current row).
    Empty past: count 0, others null.  ``chunk_keys``, a subset of the keys,
    places the rows if they aren't placed yet.
    """
    return together(df, list(chunk_keys or keys), [(list(keys), measures, ties)], ts, order, include_current, chunks)


def together(df: DataFrame, entity: list[str], groups: list[tuple[list[str], dict[str, tuple[str, Column | None]], str]],
             ts: str = "ts", order: list[str] = ("transaction_id",), include_current: bool = False,
             chunks: int | None = None) -> DataFrame:
    """``running`` for several groups ``(keys, measures, ties)`` of one entity, whose keys all hold the entity's.

    The rows are placed once (unless they are already) and shuffled once; no group's result is computed again
    for another's carry rows.  If all groups are positional, rows of one entity and time may lie in several ranges."""
    for _, measures, ties in groups:
        if ties not in ("positional", "strict"):
            raise ValueError(ties)
        if bad := [kind for kind, _ in measures.values() if kind not in _KINDS]:
            raise ValueError(bad[0])
    ours = "_t" not in df.columns
    split = list(order) if all(ties == "positional" for *_, ties in groups) else []
    d = gathered(df, entity, ts, chunks, split) if ours else df
    ranges = ["_c", "_span"] if "_c" in d.columns else []
    vcols = {f"_v_{out}": F.lit(1).cast("long") if kind == "count" else expr.cast("double") if kind == "var" else expr
             for _, measures, _ in groups for out, (kind, expr) in measures.items()}
    rows = d.withColumns(vcols)
    d = rows.withColumn("_carry", F.lit(0))
    for keys, measures, _ in groups if ranges else ():
        d = d.unionByName(_carry_rows(rows, list(keys), measures), allowMissingColumns=True)
    if ranges and len(groups) > 1:
        d = d.repartition(*entity, "_c")
    outs = {}
    native = F.col("_carry") == 0
    for keys, measures, ties in groups:
        # carry rows of other groups have no values here.  _span depends on the entity; as a key it lets a filter on it
        # pass below the window, so that a later step's carry rows cost only the entities that have some
        w = Window.partitionBy(*keys, *ranges)
        if ties == "positional":
            w = w.orderBy(F.desc("_carry"), "_t", *order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        else:
            w = w.orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
        outs |= {out: _over(out, kind, w, native, bool(ranges)) for out, (kind, _) in measures.items()}
    d = d.withColumns(outs).where(native)
    var = [out for _, measures, _ in groups for out, (kind, _) in measures.items() if kind == "var"]
    d = d.drop("_carry", *vcols.keys(), *[f"_{p}_{o}" for o in var for p in ("cn", "cm", "cq")])
    return unplaced(d) if ours else d


def _over(out: str, kind: str, w, native: Column, carried: bool) -> Column:
    """A measure over the window of a range's rows and carry rows."""
    v = F.col(f"_v_{out}")
    if kind == "count":
        return F.coalesce(F.sum(v).over(w), F.lit(0)).cast("long")
    if kind != "var":
        return getattr(F, kind)(v).over(w)
    vn = F.when(native, v)  # variance: the range's own rows, merged with the carry
    n_b, m_b = F.count(vn).over(w), F.avg(vn).over(w)
    m2_b = F.var_pop(vn).over(w) * n_b
    if not carried:
        return F.when(n_b > 0, F.var_pop(vn).over(w))
    cn, cm, cq = (F.max(F.col(f"_{p}_{out}")).over(w) for p in ("cn", "cm", "cq"))
    n_a = F.coalesce(cn, F.lit(0))
    n = n_a + n_b
    merged = (F.coalesce(cq, F.lit(0.0)) + F.coalesce(m2_b, F.lit(0.0))
              + F.coalesce((m_b - cm) * (m_b - cm) * n_a * n_b / n, F.lit(0.0)))
    return F.when(n > 0, F.greatest(merged / n, F.lit(0.0)))


def beside(df: DataFrame, parts: list[tuple[list[str], Callable[[DataFrame], DataFrame]]],
           ts: str = "ts", order: list[str] = ("transaction_id",), keep: list[str] = ()) -> DataFrame:
    """Features of several entities: ``parts`` are (columns, function) and every function gets the rows with only its
    columns, the time and the order, so no placement stores or shuffles another's columns or results.  What the
    functions add is joined by ``order``, which must be unique and not null; ``keep`` names columns of ``df`` to keep."""
    order = list(order)
    df = df.select(*dict.fromkeys([*order, ts, *keep, *[c for columns, _ in parts for c in columns]]))
    if len(parts) > 1:
        df = stored(df, "beside")  # each placement reads its source twice
    out = df.select(*order, *keep) if keep else None
    for columns, fn in parts:
        narrow = df.select(*dict.fromkeys([*order, ts, *columns]))
        made = fn(narrow)
        made = made.select(*order, *[c for c in made.columns if c not in narrow.columns])
        out = made if out is None else out.join(made, order)
    return out


def _carry_rows(d: DataFrame, keys: list[str], measures) -> DataFrame:
    """A row for each (keys, chunk) of an entity that covers several chunks, with the aggregate of its
    earlier chunks.  The prefix over a key has at most a row per chunk."""
    aggs = [F.min("_t").alias("_least")]
    for out, (kind, _) in measures.items():
        v = F.col(f"_v_{out}")
        if kind == "var":
            aggs += [F.count(v).alias(f"_an_{out}"), F.avg(v).alias(f"_am_{out}"), (F.var_pop(v) * F.count(v)).alias(f"_aq_{out}")]
        else:
            aggs.append((F.sum(v) if kind in ("count", "sum") else getattr(F, kind)(v)).alias(f"_a_{out}"))
    ct = d.where("_span").groupBy(*keys, "_c").agg(*aggs)
    all_ = Window.partitionBy(*keys).orderBy("_c")
    before = all_.rowsBetween(Window.unboundedPreceding, -1)
    cols = [*[F.col(k) for k in keys], F.col("_c"), (F.col("_least") - 1).alias("_t"), F.lit(1).alias("_carry"), F.lit(True).alias("_span"), F.count(F.lit(1)).over(before).alias("_before")]
    for out, (kind, _) in measures.items():
        if kind == "var":
            # moments about the first chunk's mean, so that a large common offset doesn't cancel digits
            n, m, q = (F.col(f"_{p}_{out}") for p in ("an", "am", "aq"))
            ref = F.first(m, ignorenulls=True).over(all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            shift = F.coalesce(m - ref, F.lit(0.0))
            total, s = F.sum(n).over(before), F.sum(n * shift).over(before)
            cols += [F.lit(None).cast("double").alias(f"_v_{out}"), total.alias(f"_cn_{out}"), (ref + s / total).alias(f"_cm_{out}"),
                     (F.sum(F.coalesce(q, F.lit(0.0)) + n * shift * shift).over(before) - s * s / total).alias(f"_cq_{out}")]
        else:
            a = F.col(f"_a_{out}")
            cols.append((F.sum(a) if kind in ("count", "sum") else getattr(F, kind)(a)).over(before).alias(f"_v_{out}"))
    return ct.select(*cols).where("_before > 0").drop("_before")


# ---------------------------------------------------------------------------
# rolling time windows (t - W, t], current row excluded

def rolling_many(df: DataFrame, keys: list[str], windows: dict[str | int, dict[str, tuple[str, Column | None]]],
                 ts: str = "ts", order: list[str] = ("transaction_id",), ties: str = "positional",
                 chunks: int | None = None) -> DataFrame:
    """Count / sum over the entity's earlier rows in ``(t - W, t]``, for several windows at once.

    Every row enters at its time and leaves W later: the running sum of what has
    entered less what has left is the window's.  ``positional`` counts the rows of
    the same time that come earlier in the tie-break order; ``strict`` none.
    Kinds: count, sum (an empty sum is 0)."""
    keys, order = list(keys), list(order)
    strict = ties == "strict"
    measures = [(w, o, k, e) for w, m in windows.items() for o, (k, e) in m.items()]
    vals = {f"_w{i}": F.lit(1).cast("long") if k == "count" else e for i, (_, _, k, e) in enumerate(measures)}
    ones = {f"_n{i}": F.lit(1).cast("long") for i, m in enumerate(measures) if m[2] == "sum"}
    # a nullable value doesn't count in an empty sum's test
    ones = {n: F.when(vals[f"_w{n[2:]}"].isNotNull(), v).otherwise(F.lit(0).cast("long")) for n, v in ones.items()}
    rows = df.withColumns(vals | ones).withColumns({"_at": F.col(ts), "_enters": F.lit(1)})
    events = rows
    for w in windows:
        own = {i for i, m in enumerate(measures) if m[0] == w}
        leave = F.timestamp_micros(F.unix_micros(F.col(ts)) + F.lit(duration_us(w) - int(strict)))
        sign = {c: -F.col(c) if int(c[2:]) in own else (F.col(c) * 0) for c in (*vals, *ones)}
        gone = rows.select(*keys, *order, *[v.alias(c) for c, v in sign.items()], leave.alias("_at"), F.lit(0).alias("_enters"))
        events = events.unionByName(gone, allowMissingColumns=True)
    run = {f"_r{c}": ("sum", F.col(c)) for c in (*vals, *ones)}
    d = running(events, keys, run, ts="_at", order=["_enters", *order], ties=ties, chunks=chunks).where("_enters = 1")
    outs = {}
    for i, (_, out, kind, _) in enumerate(measures):
        total = F.coalesce(F.col(f"_r_w{i}"), F.lit(0))
        outs[out] = total if kind == "count" else F.when(F.coalesce(F.col(f"_r_n{i}"), F.lit(0)) == 0, F.lit(0)).otherwise(total)
    return d.withColumns(outs).drop("_at", "_enters", *vals, *ones, *run)


def rolling(df: DataFrame, keys: list[str], window: str | int, measures: dict[str, tuple[str, Column | None]], **kw) -> DataFrame:
    """``rolling_many`` of one window."""
    return rolling_many(df, keys, {window: measures}, **kw)


# ---------------------------------------------------------------------------
# feature families (names follow the reference's feature names)

def seq_index(df: DataFrame, entity: str, out: str, ties: str = "positional", **kw) -> DataFrame:
    """Rows of the entity before this one (0 on its first row)."""
    return running(df, [entity], {out: ("count", None)}, ties=ties, **kw)


def pair_count(df: DataFrame, entity: str, value: str, out: str, ties: str = "positional",
               **kw) -> DataFrame:
    """Earlier occurrences of the (entity, value) pair."""
    return running(df, [entity, value], {out: ("count", None)}, ties=ties,
                   chunk_keys=[entity], **kw)


def novelty(df: DataFrame, entity: str, value: str, out: str | None = None,
            ties: str = "strict", keep_count: bool = False, **kw) -> DataFrame:
    """``is_new_<value>_for_<entity>`` = pair count is 0."""
    out = out or f"is_new_{value}_for_{entity.split('_')[0]}"
    tmp = f"_pc_{out}"
    d = pair_count(df, entity, value, tmp, ties=ties, **kw)
    d = d.withColumn(out, (F.col(tmp) == 0).cast("int"))
    return d if keep_count else d.drop(tmp)


def pair_counts(df: DataFrame, entity: str, values: dict[str, str], ties: str = "positional", **kw) -> DataFrame:
    """``pair_count`` for several values (name → value column) of one entity at once."""
    return together(df, [entity], [([entity, v], {out: ("count", None)}, ties) for out, v in values.items()], **kw)


def novelties(df: DataFrame, entity: str, values: dict[str, str], ties: str = "strict", **kw) -> DataFrame:
    """``novelty`` for several values (name → value column) of one entity at once."""
    d = pair_counts(df, entity, values, ties, **kw)
    return d.withColumns({out: (F.col(out) == 0).cast("int") for out in values})


def unique_so_far(df: DataFrame, entity: str, value: str, out: str,
                  ties: str = "positional", **kw) -> DataFrame:
    """Distinct values of ``value`` seen before this row for the entity.

    Flag the first (positional) row of each (entity, value), then a running
    sum of the flag — positional ROWS frame, or strict RANGE frame so a
    value first seen at a tie peer is not counted.
    """
    return uniques_so_far(df, entity, {out: value}, ties, **kw)


def uniques_so_far(df: DataFrame, entity: str, values: dict[str, str], ties: str = "positional", **kw) -> DataFrame:
    """``unique_so_far`` for several values (name → value column) of one entity at once."""
    ours = "_t" not in df.columns
    split = list(kw.get("order", ("transaction_id",))) if ties == "positional" else []
    d = gathered(df, [entity], kw.get("ts", "ts"), kw.get("chunks"), split) if ours else df
    d = together(d, [entity], [([entity, v], {f"_first_{out}": ("count", None)}, "positional") for out, v in values.items()], **kw)
    first = {out: (F.col(f"_first_{out}") == 0).cast("long") for out in values}
    d = together(d, [entity], [([entity], {out: ("sum", f) for out, f in first.items()}, ties)], **kw)
    d = d.withColumns({out: F.coalesce(out, F.lit(0)).cast("long") for out in values}).drop(*[f"_first_{out}" for out in values])
    return unplaced(d) if ours else d


def expanding(df: DataFrame, entity: str, value: str, prefix: str,
              stats: tuple[str, ...] = ("sum", "count", "mean", "max", "std"), **kw) -> DataFrame:
    """Expanding statistics of the entity's past values (positional);
    std is the population std (0 when one past row), null with no past."""
    m = {}
    if {"sum", "mean"} & set(stats):
        m[f"{prefix}_sum"] = ("sum", F.col(value))
    m[f"{prefix}_count"] = ("count", None)
    if "max" in stats:
        m[f"{prefix}_max"] = ("max", F.col(value))
    if "std" in stats:
        m["_var"] = ("var", F.col(value))
    d = running(df, [entity], m, ties="positional", **kw)
    extra = {}
    if "mean" in stats:
        extra[f"{prefix}_mean"] = F.col(f"{prefix}_sum") / F.col(f"{prefix}_count")
    if "std" in stats:
        extra[f"{prefix}_std"] = F.sqrt("_var")
    d = d.withColumns(extra).drop("_var")
    drop = [c for c in (f"{prefix}_sum", f"{prefix}_count") if c.rsplit("_", 1)[1] not in stats]
    return d.drop(*drop)


def expanding_median(df: DataFrame, entity: str, value: str, out: str,
                     ts: str = "ts", order: list[str] = ("transaction_id",), chunks: int | None = None) -> DataFrame:
    """Median of the entity's past values, split over ranges like the other statistics."""
    from .order_stats import running_median
    return running_median(df, [entity], value, out, ts, order, chunks)


def deviation(df: DataFrame, value: str, mean: str, std: str | None, median: str | None,
              max_past: str | None, prefix: str, eps: float = 1e-6) -> DataFrame:
    """Z-score, ratio to mean / median, minus-mean and new-max flag
    (a first row has max = -inf, so the flag is 1 there)."""
    x = F.col(value)
    out = {f"{prefix}_ratio_to_mean": x / (F.col(mean) + eps),
           f"{prefix}_minus_mean": x - F.col(mean)}
    if std:
        out[f"{prefix}_zscore"] = (x - F.col(mean)) / (F.col(std) + eps)
    if median:
        out[f"{prefix}_ratio_to_median"] = x / (F.col(median) + eps)
    if max_past:
        out[f"{prefix}_is_new_max"] = F.coalesce(x > F.col(max_past), F.lit(True)).cast("int")
    return df.withColumns(out)


def new_high(df: DataFrame, entity: str, cols: list[str], **kw) -> DataFrame:
    """Score exceeds the entity's own past maximum (1 on a first row)."""
    m = {f"_pm_{c}": ("max", F.col(c)) for c in cols}
    d = running(df, [entity], m, ties="positional", **kw)
    return d.withColumns({f"is_new_high_{c}": F.coalesce(F.col(c) > F.col(f"_pm_{c}"), F.lit(True)).cast("int")
                          for c in cols}).drop(*m.keys())


def past_label_neighbors(df: DataFrame, entity: str, counterparty: str, out: str,
                         label: str = "is_fraud", **kw) -> DataFrame:
    """Distinct counterparties that already had a positive label
    (strictly earlier) when this entity first met them, counted strictly
    before this row."""
    d = running(df, [counterparty], {"_cp_pos": ("sum", F.col(label))}, ties="strict", **kw)
    d = stored(d.withColumn("_cp_bad", flag(F.col("_cp_pos") > 0)), "counterparties")  # the placement reads it twice
    d = gathered(d, [entity], kw.get("ts", "ts"), kw.get("chunks"))
    d = running(d, [entity, counterparty], {"_met": ("count", None)}, ties="positional", **kw)
    d = d.withColumn("_new_bad", ((F.col("_met") == 0) & (F.col("_cp_bad") == 1)).cast("long"))
    d = running(d, [entity], {out: ("sum", F.col("_new_bad"))}, ties="strict", **kw)
    return unplaced(d.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))
                    .drop("_cp_pos", "_cp_bad", "_met", "_new_bad"))


def target_encode(df: DataFrame, entity: str, window: str, out_prefix: str,
                  global_rate: Column, alpha: float = 10.0, label: str = "is_fraud",
                  **kw) -> DataFrame:
    """Past-window positives and count (current row excluded) and the
    smoothed rate (pos + alpha * g) / (n + alpha)."""
    n, p = f"{out_prefix}_count_{window}", f"{out_prefix}_fraud_count_{window}"
    d = rolling(df, [entity], window, {n: ("count", None), p: ("sum", F.col(label))}, **kw)
    return d.withColumn(f"{out_prefix}_te_{window}",
                        (F.col(p) + F.lit(alpha) * global_rate) / (F.col(n) + F.lit(alpha)))


def lifecycle(df: DataFrame, entity: str, prefix: str, ts: str = "ts",
              last_seen: bool = True, **kw) -> DataFrame:
    """Days since the entity was first seen and since its previous row."""
    m = {"_first": ("min", F.col(ts)), }
    if last_seen:
        m["_prev"] = ("max", F.col(ts))
    d = running(df, [entity], m, ts=ts, ties="positional", include_current=False, **kw)
    first = F.coalesce(F.col("_first"), F.col(ts))
    out = {f"{prefix}_days_since_first_seen":
           (F.unix_micros(F.col(ts)) - F.unix_micros(first)) / F.lit(DAY_US)}
    if last_seen:
        out[f"{prefix}_days_since_last_seen"] = (
            (F.unix_micros(F.col(ts)) - F.unix_micros(F.col("_prev"))) / F.lit(DAY_US))
    return d.withColumns(out).drop("_first", "_prev")


def unusual_hour(df: DataFrame, entity: str, hour: str = "hour", prefix: str = "sender",
                 threshold: float = 6.0, **kw) -> DataFrame:
    """Past mean hour, absolute deviation (linear), flag > threshold."""
    d = running(df, [entity], {"_hs": ("sum", F.col(hour)), "_hn": ("count", None)},
                ties="positional", **kw)
    mean = F.col("_hs") / F.col("_hn")
    d = d.withColumn(f"{prefix}_mean_hour_past", mean)
    dev = F.abs(F.col(hour) - F.col(f"{prefix}_mean_hour_past"))
    return (d.withColumn(f"hour_deviation_from_{prefix}_mean", dev)
             .withColumn(f"is_unusual_hour_for_{prefix}", flag(dev > threshold))
             .drop("_hs", "_hn"))
