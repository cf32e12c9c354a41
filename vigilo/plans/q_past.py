"""Registered queries: historical window features (§2.6)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import features as FT
from ..operators import past as P
from ..operators.order import global_index, split_flag, time_blocks
from ..operators.profile import r6
from ..sources.adapters import txn_events, txn_lineitem
from .registry import ev_sql, li_sql, register

S, R = "sender_account", "receiver_account"


def _ev(spark, sf, *cols):
    return txn_events(spark, sf).select("transaction_id", "ts", *cols)


def _li(spark, sf, *cols):
    return txn_lineitem(spark, sf).select("transaction_id", "ts", *cols)


def _by_entity(items):
    """[(entity, column, name)] as {entity: {name: column}}."""
    found = {}
    for e, v, o in items:
        found.setdefault(e, {})[o] = v
    return found


def _beside(d, items, fn):
    """``fn(rows, entity, {name: column})`` of every entity, beside each other."""
    return P.beside(d, [([e, *values.values()], lambda rows, e=e, values=values: fn(rows, e, values)) for e, values in _by_entity(items).items()])


def rn(part, order="ts, transaction_id"):
    return f"(row_number() OVER (PARTITION BY {part} ORDER BY {order}) - 1)"


@register("w_seq_index", ev_sql(f"""
SELECT transaction_id, {rn(S)} AS sender_tx_index, {rn(R)} AS receiver_tx_index FROM txn_events"""))
def q_w_seq_index(spark, sf):
    d = P.beside(_ev(spark, sf, S, R), [([S], lambda rows: P.seq_index(rows, S, "sender_tx_index")), ([R], lambda rows: P.seq_index(rows, R, "receiver_tx_index"))])
    return d.select("transaction_id", "sender_tx_index", "receiver_tx_index")


@register("w_first_flag", ev_sql(f"""
SELECT transaction_id, CAST({rn(S)} = 0 AS INTEGER) AS is_sender_first_tx,
       CAST({rn(R)} = 0 AS INTEGER) AS is_receiver_first_tx FROM txn_events"""))
def q_w_first_flag(spark, sf):
    d = P.beside(_ev(spark, sf, S, R), [([S], lambda rows: P.seq_index(rows, S, "_si")), ([R], lambda rows: P.seq_index(rows, R, "_ri"))])
    return d.select("transaction_id", (F.col("_si") == 0).cast("int").alias("is_sender_first_tx"),
                    (F.col("_ri") == 0).cast("int").alias("is_receiver_first_tx"))


PAIR_VALUES = [(S, R), (S, "location"), (S, "payment_channel"), (R, "payment_channel")]


def _pc_name(e, v):
    return f"{e.split('_')[0]}_{v}_seen_count"


@register("w_pair_count", ev_sql("SELECT transaction_id, " + ", ".join(
    f"{rn(f'{e}, {v}')} AS {_pc_name(e, v)}" for e, v in PAIR_VALUES) + " FROM txn_events"))
def q_w_pair_count(spark, sf):
    d = _ev(spark, sf, S, R, "location", "payment_channel")
    d = _beside(d, [(e, v, _pc_name(e, v)) for e, v in PAIR_VALUES], P.pair_counts)
    return d.select("transaction_id", *[_pc_name(e, v) for e, v in PAIR_VALUES])


LI_PAIRS = [(S, R), (S, "location"), (S, "merchant_category")]


@register("w_pair_count_strict", li_sql("SELECT transaction_id, " + ", ".join(
    f"(rank() OVER (PARTITION BY {e}, {v} ORDER BY ts) - 1) AS {_pc_name(e, v)}"
    for e, v in LI_PAIRS) + " FROM txn_lineitem"))
def q_w_pair_count_strict(spark, sf):
    d = _li(spark, sf, S, R, "location", "merchant_category")
    d = P.pair_counts(d, S, {_pc_name(e, v): v for e, v in LI_PAIRS}, ties="strict")
    return d.select("transaction_id", *[_pc_name(e, v) for e, v in LI_PAIRS])


NOV = [(S, "location"), (S, "payment_channel"), (S, "transaction_type"), (S, "device_used"),
       (R, S)]


def _nov(e, v):
    return f"is_new_{v.split('_')[0] if v == S else v}_for_{e.split('_')[0]}"


@register("w_novelty", li_sql("SELECT transaction_id, " + ", ".join(
    f"CAST(rank() OVER (PARTITION BY {e}, {v} ORDER BY ts) = 1 AS INTEGER) AS {_nov(e, v)}"
    for e, v in NOV) + " FROM txn_lineitem"))
def q_w_novelty(spark, sf):
    d = _li(spark, sf, S, R, "location", "payment_channel", "transaction_type", "device_used")
    d = _beside(d, [(e, v, _nov(e, v)) for e, v in NOV], partial(P.novelties, ties="strict"))
    return d.select("transaction_id", *[_nov(e, v) for e, v in NOV])


@register("w_novelty_positional", ev_sql("SELECT transaction_id, " + ", ".join(
    f"CAST({rn(f'{e}, {v}')} = 0 AS INTEGER) AS {_nov(e, v)}" for e, v in NOV) + " FROM txn_events"))
def q_w_novelty_positional(spark, sf):
    d = _ev(spark, sf, S, R, "location", "payment_channel", "transaction_type", "device_used")
    d = _beside(d, [(e, v, _nov(e, v)) for e, v in NOV], partial(P.novelties, ties="positional"))
    return d.select("transaction_id", *[_nov(e, v) for e, v in NOV])


@register("w_seen_before", li_sql(f"""
SELECT transaction_id, CAST(rank() OVER (PARTITION BY {S}, {R} ORDER BY ts) > 1 AS INTEGER)
       AS sender_receiver_seen_before FROM txn_lineitem"""))
def q_w_seen_before(spark, sf):
    d = P.pair_count(_li(spark, sf, S, R), S, R, "_pc", ties="strict")
    return d.select("transaction_id", (F.col("_pc") > 0).cast("int").alias("sender_receiver_seen_before"))


UNIQ = [(S, R, "sender_unique_receivers"), (S, "location", "sender_unique_locations"),
        (R, S, "receiver_unique_senders")]


def _uniq_sql(frame_kind):
    first = ", ".join(f"CAST({rn(f'{e}, {v}')} = 0 AS INTEGER) AS f_{o}" for e, v, o in UNIQ)
    if frame_kind == "positional":
        outs = ", ".join(
            f"CAST(coalesce(SUM(f_{o}) OVER (PARTITION BY {e} ORDER BY ts, transaction_id "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {o}" for e, v, o in UNIQ)
    else:
        outs = ", ".join(
            f"CAST(coalesce(SUM(f_{o}) OVER (PARTITION BY {e} ORDER BY epoch_us(ts) "
            f"RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {o}" for e, v, o in UNIQ)
    return f"SELECT transaction_id, {outs} FROM (SELECT *, {first} FROM txn_lineitem)"


def _uniq(spark, sf, ties):
    d = _li(spark, sf, S, R, "location")
    d = _beside(d, UNIQ, partial(P.uniques_so_far, ties=ties))
    return d.select("transaction_id", *[o for _, _, o in UNIQ])


@register("w_unique_so_far", li_sql(_uniq_sql("strict")))
def q_w_unique_so_far(spark, sf):
    return _uniq(spark, sf, "strict")


@register("w_unique_so_far_positional", li_sql(_uniq_sql("positional")))
def q_w_unique_so_far_positional(spark, sf):
    return _uniq(spark, sf, "positional")


def _roll_sql(part, w_us, what="COUNT(*)"):
    strict = (f"{what} OVER (PARTITION BY {part} ORDER BY epoch_us(ts) "
              f"RANGE BETWEEN {w_us - 1} PRECEDING AND 1 PRECEDING)")
    tie = (f"{what} OVER (PARTITION BY {part}, ts ORDER BY transaction_id "
           f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return f"(coalesce({strict}, 0) + coalesce({tie}, 0))"


D = P.DAY_US
ROLL = [(S, "24h", "count", "sender_tx_count_past_24h"), (S, "7d", "count", "sender_tx_count_past_7d"),
        (S, "24h", "sum", "sender_amount_sum_past_24h"), (R, "24h", "count", "receiver_tx_count_past_24h"),
        (R, "7d", "count", "receiver_tx_count_past_7d"), ("device_hash", "7d", "count", "device_tx_count_past_7d"),
        ("ip_address", "7d", "count", "ip_tx_count_past_7d")]


def _roll_select(kind, e, w, o):
    expr = _roll_sql(e, P.duration_us(w), "COUNT(*)" if kind == "count" else "SUM(amount)")
    return (f"CAST({expr} AS BIGINT) AS {o}" if kind == "count" else f"round({expr}, 6) AS {o}")


@register("w_rolling", ev_sql("SELECT transaction_id, " + ", ".join(
    _roll_select(k, e, w, o) for e, w, k, o in ROLL) + " FROM txn_events"))
def q_w_rolling(spark, sf):
    d = _ev(spark, sf, S, R, "device_hash", "ip_address", "amount")
    by_key = {}
    for e, w, k, o in ROLL:
        by_key.setdefault(e, {}).setdefault(w, {})[o] = (k, F.col("amount") if k == "sum" else None)
    d = P.beside(d, [([e, "amount"] if e == S else [e], lambda rows, e=e, windows=windows: P.rolling_many(rows, [e], windows))
                     for e, windows in by_key.items()])
    return d.select("transaction_id", *[r6(o).alias(o) if k == "sum" else o for e, w, k, o in ROLL])


@register("w_rolling_ties", li_sql("SELECT transaction_id, " + ", ".join(
    _roll_select(k, S, w, o) for w, k, o in
    [("24h", "count", "c24"), ("7d", "count", "c7d"), ("7d", "sum", "s7d")]) + " FROM txn_lineitem"))
def q_w_rolling_ties(spark, sf):
    d = _li(spark, sf, S, "amount")
    d = P.rolling_many(d, [S], {"24h": {"c24": ("count", None)}, "7d": {"c7d": ("count", None), "s7d": ("sum", F.col("amount"))}})
    return d.select("transaction_id", "c24", "c7d", r6("s7d").alias("s7d"))


def _exp_sql(e, v, pre, src, std_digits=6):
    fr = f"OVER (PARTITION BY {e} ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (f"SELECT transaction_id, round(SUM({v}) {fr}, 6) AS {pre}_sum, COUNT({v}) {fr} AS {pre}_count, "
            f"round(round(SUM({v}) {fr}, 6) / COUNT({v}) {fr}, 6) AS {pre}_mean, MAX({v}) {fr} AS {pre}_max, "
            f"round(STDDEV_POP({v}) {fr}, {std_digits}) AS {pre}_std FROM {src}")


EXP_COLS = ["sum", "count", "mean", "max", "std"]


def _canon_mean(d, pre):
    """mean from the 6-decimal sum, so a last-ulp difference in the running
    sum cannot flip a rounding tie (means of 2-decimal amounts over 2^k rows
    land exactly on ties)."""
    return d.withColumn(f"{pre}_mean", r6(f"{pre}_sum") / F.col(f"{pre}_count"))


@register("w_expanding", ev_sql(_exp_sql(S, "amount", "sender_amount", "txn_events")))
def q_w_expanding(spark, sf):
    d = P.expanding(_ev(spark, sf, S, "amount"), S, "amount", "sender_amount")
    d = _canon_mean(d, "sender_amount")
    return d.select("transaction_id", *[r6(f"sender_amount_{c}").alias(f"sender_amount_{c}")
                                        if c not in ("count", "max") else f"sender_amount_{c}"
                                        for c in EXP_COLS])


# amounts ~1e5: the std is compared at 3 decimals (1e-12 relative error of
# two different stable variance algorithms must not decide the result)
@register("w_expanding_receiver", li_sql(_exp_sql(R, "amount", "receiver_amount", "txn_lineitem", 3)))
def q_w_expanding_receiver(spark, sf):
    d = P.expanding(_li(spark, sf, R, "amount"), R, "amount", "receiver_amount")
    d = _canon_mean(d, "receiver_amount")
    d = d.withColumn("receiver_amount_std",
                     F.round(F.col("receiver_amount_std") * F.lit(1000.0)) / F.lit(1000.0))
    return d.select("transaction_id", *[r6(f"receiver_amount_{c}").alias(f"receiver_amount_{c}")
                                        if c not in ("count", "max", "std") else f"receiver_amount_{c}"
                                        for c in EXP_COLS])


MED_FR = f"OVER (PARTITION BY {S} ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register("w_expanding_median", ev_sql(f"""
SELECT transaction_id, round(quantile_cont(amount, 0.5) {MED_FR}, 6) AS sender_amount_median FROM txn_events"""))
def q_w_expanding_median(spark, sf):
    d = P.expanding_median(_ev(spark, sf, S, "amount"), S, "amount", "sender_amount_median")
    return d.select("transaction_id", r6("sender_amount_median").alias("sender_amount_median"))


DEV_COLS = ["amt_ratio_to_mean", "amt_minus_mean", "amt_zscore", "amt_ratio_to_median", "amt_is_new_max"]


@register("w_deviation", ev_sql(f"""
SELECT transaction_id, round(amount / (m + 1e-6), 6) AS amt_ratio_to_mean,
       round(amount - m, 6) AS amt_minus_mean, round((amount - m) / (sd + 1e-6), 6) AS amt_zscore,
       round(amount / (med + 1e-6), 6) AS amt_ratio_to_median,
       CAST(coalesce(amount > mx, true) AS INTEGER) AS amt_is_new_max
FROM (SELECT *, round(SUM(amount) {MED_FR}, 6) / COUNT(amount) {MED_FR} AS m, STDDEV_POP(amount) {MED_FR} AS sd,
             quantile_cont(amount, 0.5) {MED_FR} AS med, MAX(amount) {MED_FR} AS mx FROM txn_events)"""))
def q_w_deviation(spark, sf):
    d = P.expanding(_ev(spark, sf, S, "amount"), S, "amount", "e")
    d = _canon_mean(d, "e")
    d = P.expanding_median(d, S, "amount", "e_median")
    d = P.deviation(d, "amount", "e_mean", "e_std", "e_median", "e_max", "amt")
    return d.select("transaction_id", *[r6(c).alias(c) if c != "amt_is_new_max" else c for c in DEV_COLS])


HIGH = ["velocity_score", "geo_anomaly_score", "spending_deviation_score"]


@register("w_new_high", ev_sql("SELECT transaction_id, " + ", ".join(
    f"CAST(coalesce({c} > MAX({c}) {MED_FR}, true) AS INTEGER) AS is_new_high_{c}" for c in HIGH)
    + " FROM txn_events"))
def q_w_new_high(spark, sf):
    d = P.new_high(_ev(spark, sf, S, *HIGH), S, HIGH)
    return d.select("transaction_id", *[f"is_new_high_{c}" for c in HIGH])


def _pln_sql(e, cp, out, src):
    return f"""SELECT transaction_id, CAST(coalesce(SUM(nb) OVER (PARTITION BY {e} ORDER BY epoch_us(ts)
         RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {out}
FROM (SELECT *, CAST({rn(f'{e}, {cp}')} = 0 AND cpb AS INTEGER) AS nb
      FROM (SELECT *, coalesce(SUM(is_fraud) OVER (PARTITION BY {cp} ORDER BY epoch_us(ts)
                      RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0, false) AS cpb FROM {src}))"""


@register("w_past_label_neighbors", li_sql(_pln_sql(S, R, "sender_fraud_neighbors_past", "txn_lineitem")))
def q_w_past_label_neighbors(spark, sf):
    d = P.past_label_neighbors(_li(spark, sf, S, R, "is_fraud"), S, R, "sender_fraud_neighbors_past")
    return d.select("transaction_id", "sender_fraud_neighbors_past")


@register("w_past_label_neighbors_device", ev_sql(_pln_sql("device_hash", S, "device_fraud_senders_past",
                                                           "txn_events")))
def q_w_past_label_neighbors_device(spark, sf):
    d = P.past_label_neighbors(_ev(spark, sf, S, "device_hash", "is_fraud"), "device_hash", S,
                               "device_fraud_senders_past")
    return d.select("transaction_id", "device_fraud_senders_past")


GI_SQL = """gi AS (SELECT *, row_number() OVER (ORDER BY ts, transaction_id) - 1 AS global_index,
                  COUNT(*) OVER () AS _total FROM txn_events)"""
GRATE_SQL = "gr AS (SELECT avg(is_fraud) AS g FROM gi WHERE global_index < floor(_total * 0.8))"


def _te_sql(e, w, pre):
    n = _roll_sql(e, P.duration_us(w), "COUNT(*)")
    p = _roll_sql(e, P.duration_us(w), "SUM(is_fraud)")
    return (f"CAST({n} AS BIGINT) AS {pre}_count_{w}, CAST({p} AS BIGINT) AS {pre}_fraud_count_{w}, "
            f"round(({p} + 10 * g) / ({n} + 10), 6) AS {pre}_te_{w}")


TE = [(S, "7d", "sender"), (S, "30d", "sender"), ("device_hash", "30d", "device")]


@register("w_target_encode", ev_sql("SELECT transaction_id, " + ", ".join(_te_sql(*t) for t in TE)
                                    + " FROM txn_events, gr", GI_SQL, GRATE_SQL))
def q_w_target_encode(spark, sf):
    base = _ev(spark, sf, S, "device_hash", "is_fraud")
    gi = global_index(base.select("transaction_id", "ts", "is_fraud"), ["ts", "transaction_id"])
    g = gi.where(split_flag(F.col("global_index"), F.col("_total")) == 1).agg(F.avg("is_fraud")).scalar()
    d = P.beside(base, [([e, "is_fraud"], lambda rows, e=e, w=w, pre=pre: P.target_encode(rows, e, w, pre, g)) for e, w, pre in TE])
    cols = []
    for e, w, pre in TE:
        cols += [f"{pre}_count_{w}", f"{pre}_fraud_count_{w}", r6(f"{pre}_te_{w}").alias(f"{pre}_te_{w}")]
    return d.select("transaction_id", *[F.col(c).cast("bigint") if isinstance(c, str) else c for c in cols])


@register("w_lifecycle", li_sql(f"""
SELECT transaction_id,
  round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY {S}))) / {D}, 6) AS sender_days_since_first_seen,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {S} ORDER BY ts, transaction_id))) / {D}, 6)
    AS sender_days_since_last_seen,
  round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY {R}))) / {D}, 6) AS receiver_days_since_first_seen
FROM txn_lineitem"""))
def q_w_lifecycle(spark, sf):
    d = P.beside(_li(spark, sf, S, R), [([S], lambda rows: P.lifecycle(rows, S, "sender")),
                                        ([R], lambda rows: P.lifecycle(rows, R, "receiver", last_seen=False))])
    cols = ["sender_days_since_first_seen", "sender_days_since_last_seen", "receiver_days_since_first_seen"]
    return d.select("transaction_id", *[r6(c).alias(c) for c in cols])


@register("w_unusual_hour", ev_sql(f"""
SELECT transaction_id, round(mh, 6) AS sender_mean_hour_past,
       round(abs(hour(ts) - mh), 6) AS hour_deviation_from_sender_mean,
       CAST(coalesce(abs(hour(ts) - mh) > 6, false) AS INTEGER) AS is_unusual_hour_for_sender
FROM (SELECT *, SUM(hour(ts)) {MED_FR} / COUNT(hour(ts)) {MED_FR} AS mh FROM txn_events)"""))
def q_w_unusual_hour(spark, sf):
    d = _ev(spark, sf, S).withColumn("hour", F.hour("ts"))
    d = P.unusual_hour(d, S)
    return d.select("transaction_id", r6("sender_mean_hour_past").alias("sender_mean_hour_past"),
                    r6("hour_deviation_from_sender_mean").alias("hour_deviation_from_sender_mean"),
                    "is_unusual_hour_for_sender")


@register("w_global_index", ev_sql("SELECT transaction_id, global_index FROM gi", GI_SQL))
def q_w_global_index(spark, sf):
    d = global_index(_ev(spark, sf), ["ts", "transaction_id"])
    return d.select("transaction_id", "global_index")


@register("w_global_index_li", li_sql("""
SELECT transaction_id, row_number() OVER (ORDER BY ts, transaction_id) - 1 AS global_index FROM txn_lineitem"""))
def q_w_global_index_li(spark, sf):
    d = global_index(_li(spark, sf), ["ts", "transaction_id"])
    return d.select("transaction_id", "global_index")


@register("w_time_blocks", ev_sql("""
SELECT transaction_id, CAST(least(floor(global_index / greatest(floor(_total / 4), 1)), 3) AS INTEGER) AS block
FROM gi""", GI_SQL))
def q_w_time_blocks(spark, sf):
    d = global_index(_ev(spark, sf), ["ts", "transaction_id"])
    return d.select("transaction_id", time_blocks(F.col("global_index"), F.col("_total")).alias("block"))


@register("feat_ratio", li_sql(f"""
SELECT transaction_id, round(u / (idx + 1), 6) AS sender_receiver_familiarity
FROM (SELECT *, {rn(S)} AS idx,
             coalesce(SUM(f) OVER (PARTITION BY {S} ORDER BY ts, transaction_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u
      FROM (SELECT *, CAST({rn(f'{S}, {R}')} = 0 AS INTEGER) AS f FROM txn_lineitem))"""))
def q_feat_ratio(spark, sf):
    d = P.unique_so_far(_li(spark, sf, S, R), S, R, "u", ties="positional")
    d = P.seq_index(d, S, "idx")
    d = FT.feat_ratio(d, "u", "idx", "sender_receiver_familiarity")
    return d.select("transaction_id", r6("sender_receiver_familiarity").alias("sender_receiver_familiarity"))
