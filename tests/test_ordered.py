import random
import statistics

from pyspark.sql import functions as F

from turnout.operators.ordered import around, batches, in_order, majority, quantiles, top_k


def _rows(n=400, seed=3):
    """Two thirds of all rows sit in one group."""
    r = random.Random(seed)
    return [("hot" if r.random() < 0.66 else f"g{i % 5}", i, r.randint(0, 50), None if r.random() < 0.1 else r.choice("abc")) for i in range(n)]


def test_in_order_equals_a_walk_per_group(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, k long, v long, t string").repartition(7)
    got = in_order(df, ["g"], ["k"], position="pos", lags={"p": "t"}, leads={"n": "t", "nv": "v"}, running={"s": "v"},
                   highest={"hi": "v"}, lowest_next={"lo": "v"}).collect()
    assert len(got) == len(rows)
    want = {}
    for g in {x[0] for x in rows}:
        part = sorted(x for x in rows if x[0] == g)
        for i, x in enumerate(part):
            nxt = part[i + 1] if i + 1 < len(part) else None
            want[(g, x[1])] = (i, part[i - 1][3] if i else None, nxt and nxt[3], nxt and nxt[2], sum(y[2] for y in part[:i]),
                               max((y[2] for y in part[:i]), default=None), min((y[2] for y in part[i + 1:]), default=None))
    assert {(x.g, x.k): (x.pos, x.p, x.n, x.nv, x.s, x.hi, x.lo) for x in got} == want


def test_hot_group_is_spread_over_partitions(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), "id").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = df.repartitionByRange("g", "id").withColumn("p", F.spark_partition_id())
        assert ranged.select("p").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_around_finds_both_neighbours(spark):
    r = random.Random(5)
    points = sorted({r.randint(0, 300) for _ in range(40)})
    asks = list(range(-5, 310, 3))
    p = spark.createDataFrame([("a", float(x)) for x in points], "g string, x double")
    q = spark.createDataFrame([("a", float(x)) for x in asks] + [("b", 1.0)], "g string, at double")
    got = {(x.g, x.at): (x.at_or_before, x.at_or_after) for x in around(q, p, ["g"], "at", "x").collect()}
    for a in asks:
        assert got[("a", float(a))] == (max((x for x in points if x <= a), default=None), min((x for x in points if x >= a), default=None))
    assert got[("b", 1.0)] == (None, None)


def test_majority_prefers_the_first_seen_on_ties(spark):
    df = spark.createDataFrame([("d", "B", 2), ("d", "A", 1), ("d", "B", 4), ("d", "A", 9), ("d", "C", 0)], "k string, v string, i long")
    assert majority(df, ["k"], ["v"], "i").first().v == "A"


def test_top_k_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame(_rows(), "g string, k long, v long, t string").repartition(4)
    plan = top_k(df, ["g"], [F.desc("v"), F.asc("k")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_batches_have_full_slots(spark):
    df = spark.createDataFrame([("a", i) for i in range(95)], "g string, k long").repartition(5)
    sizes = {x.batch_no: x.n for x in batches(df, ["g"], ["k"], 40).groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 40, 1: 40, 2: 15}


def test_quantiles_equal_percentile_and_the_inclusive_method(spark):
    r = random.Random(11)
    rows = [("hot" if r.random() < 0.7 else None if r.random() < 0.1 else f"g{i % 5}", r.choice([None, float(r.randint(0, 30)), r.random() * 100]))
            for i in range(3000)] + [("one", 4.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(9)
    got = {x.g: (x.a, x.b, x.c) for x in quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()}
    want = {x.g: tuple(x.q) for x in df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.75]).alias("q")).collect()}
    assert got == want and "none" not in got and got["one"] == (4.5, 4.5, 4.5)
    hot = [v for g, v in rows if g == "hot" and v is not None]
    for near, exact in zip(got["hot"], statistics.quantiles(hot, n=4, method="inclusive")):
        assert abs(near - exact) < 1e-9
    assert quantiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0
