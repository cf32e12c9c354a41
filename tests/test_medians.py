import random
import statistics

from pyspark.sql import functions as F

from vigilo.operators.order_stats import running_median


def brute(rows):
    """id -> median of the earlier values of its key."""
    out, past = {}, {}
    for key, ts, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        seen = past.setdefault(key, [])
        out[i] = statistics.median(seen) if seen else None
        if v is not None:
            seen.append(v)
    return out


def check(spark, rows, chunks):
    df = spark.createDataFrame(rows, "k string, t long, transaction_id long, v double").withColumn("ts", F.timestamp_micros("t"))
    got = running_median(df, ["k"], "v", "m", chunks=chunks)
    assert got.columns == [*df.columns, "m"]
    found, want = got.select("transaction_id", "m").collect(), brute(rows)
    assert len(found) == len(rows)
    for r in found:
        assert r.m == want[r.transaction_id] or (r.m is not None and abs(r.m - want[r.transaction_id]) < 1e-12), r


def table(n, keys, values, seed, times=10_000, nulls=0.1):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(times) * 1_000_000, i, None if rng.random() < nulls else values(rng)) for i in range(n)]


def test_one_key_over_many_ranges(spark):
    """Even and odd counts, ties of value, ties of time, null values."""
    check(spark, table(3000, ["a"], lambda r: r.uniform(-5, 5), 1), 9)
    check(spark, table(2000, ["a"], lambda r: float(r.randrange(4)), 2, times=5), 7)
    check(spark, table(1500, ["a"], lambda r: r.gauss(0, 1), 3, nulls=0.8), 6)


def test_rising_and_falling_values(spark):
    """The median moves as far as it can within every range."""
    for sign in (1, -1):
        check(spark, [("a", i * 1000, i, float(sign * i)) for i in range(1200)], 8)
    check(spark, [("a", i * 1000, i, float(i if i < 600 else -i)) for i in range(1200)], 8)


def test_hot_null_and_small_keys(spark):
    check(spark, table(2500, ["hot"] * 6 + [None] * 4 + [f"k{i}" for i in range(8)], lambda r: round(r.gauss(0, 3), 1), 4), 8)
    check(spark, [("a", 0, i, float(i % 5)) for i in range(900)], 6)  # one time
    check(spark, [(None, 0, 1, None), ("b", 0, 2, None), ("b", 0, 3, 1.0)], 4)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, t long, transaction_id long, v double").withColumn("ts", F.timestamp_micros("t"))
    assert running_median(df, ["k"], "v", "m").count() == 0


def test_a_hot_key_is_spread(spark):
    """No range holds more than a few times its share, and is handed about as much as it holds."""
    from vigilo.operators.order_stats import values_near
    from vigilo.operators.past import placed
    rows = table(8000, ["hot"], lambda r: r.uniform(0, 1), 5, nulls=0)
    df = spark.createDataFrame(rows, "k string, t long, transaction_id long, v double").withColumn("ts", F.timestamp_micros("t"))
    d = placed(df, ["k"], "ts", 16, ["transaction_id"]).withColumn("_v", F.col("v"))
    size = {r._c: r.n for r in d.groupBy("_c").agg(F.count("*").alias("n")).collect()}
    assert len(size) == 16 and max(size.values()) < 2000
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for r in values_near(d, ["k"]).groupBy("_c").agg(F.sum("_n").alias("n")).collect():
        assert r.n <= 2 * size[r._c] + 3 * 8000 / blocks + 2
