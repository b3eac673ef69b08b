"""Ordered and ranked computation that does not put a hot group into one task.

``Window.partitionBy(event)`` sends a whole event to one task.  Four ways
round that are kept here:

* ``top_k``: rank <= k, which Spark prunes on the map side;
* ``majority``: counting first, then one aggregate over the distinct values;
* ``quantiles``: the values at given ranks, by running counts of folded values;
* ``in_order``: positions, neighbours and running sums over a range-sorted
  copy.  Each sorted partition is windowed on its own and the few
  partition-edge values are joined back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnout.session import settled

def attach(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join per-key results onto a large table, without a hint.

    AQE broadcasts the small side if its measured bytes are under the session's
    limit.  Beyond that the side is dealt out anew, which gives the join a
    shuffle of its own, so that AQE may split a hot key's rows on the large side.
    """
    return big.join(small.hint("rebalance"), on, how)


def spread(df: DataFrame) -> DataFrame:
    """Even out rows ahead of costly per-row work.

    The rows are few bytes but much computing, so AQE would pack them into a few
    tasks, and a hot join key would leave them all in one.  The number of tasks
    is the cluster's cores or the shuffle setting, whichever is more, and is
    kept as stated.
    """
    return df.repartition(tasks(df.sparkSession))


def tasks(spark: SparkSession) -> int:
    """Tasks for costly per-row work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; the rank filter becomes a map-side group limit."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def majority(df: DataFrame, keys: list[str], values: list[str], first: str,
             prefer: Column | None = None) -> DataFrame:
    """Most frequent value tuple per key; ties go to ``prefer`` and then to the first seen."""
    counts = df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_n"), F.min(first).alias("_first"))
    weight = [F.col("_n")] + ([prefer.cast("int")] if prefer is not None else []) + [-F.col("_first")]
    best = counts.groupBy(*keys).agg(
        F.max_by(F.struct(*values, F.col("_n").alias("votes")), F.struct(*weight)).alias("_best"))
    return best.select(*keys, "_best.*")


def in_order(df: DataFrame, groups: list[str], order: list[str], *, position: str | None = None,
             lags: dict | None = None, leads: dict | None = None, running: dict | None = None,
             highest: dict | None = None, lowest_next: dict | None = None) -> DataFrame:
    """Add order-based columns per group without collecting a group.

    ``order`` must be total within a group.  ``position`` is 0-based.  ``lags``
    and ``leads`` map new columns to existing ones (distance 1).  ``running``
    sums and ``highest`` takes the maximum over the *preceding* rows,
    ``lowest_next`` the minimum over the *following* rows.
    """
    lags, leads, running = lags or {}, leads or {}, running or {}
    highest, lowest_next = highest or {}, lowest_next or {}
    ranged = (
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in groups + order])
        .sortWithinPartitions(*groups, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    ranged = settled(ranged)
    block = groups + ["_part"]
    w = Window.partitionBy(*block).orderBy(*order)
    w_before = w.rowsBetween(Window.unboundedPreceding, -1)
    w_after = w.rowsBetween(1, Window.unboundedFollowing)
    across = Window.partitionBy(*groups).orderBy("_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)

    # per kind: (edge aggregate, edge value seen from a block, local value, how both combine)
    key = F.struct(*order)
    local_first = F.row_number().over(w) == 1
    local_last = F.lead(F.lit(1)).over(w).isNull()
    plan = []
    for out, src in lags.items():
        plan.append((out, F.max_by(F.struct(F.col(src).alias("v")), key), lambda e: F.lag(e).over(across)["v"],
                     F.lag(src).over(w), lambda near, far: F.when(F.col("_first"), far).otherwise(near)))
    for out, src in leads.items():
        plan.append((out, F.min_by(F.struct(F.col(src).alias("v")), key), lambda e: F.lead(e).over(across)["v"],
                     F.lead(src).over(w), lambda near, far: F.when(F.col("_last"), far).otherwise(near)))
    for out, src in running.items():
        plan.append((out, F.sum(src), lambda e: F.sum(e).over(before), F.sum(src).over(w_before),
                     lambda near, far: F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))))
    for out, src in highest.items():
        plan.append((out, F.max(src), lambda e: F.max(e).over(before), F.max(src).over(w_before), F.greatest))
    for out, src in lowest_next.items():
        plan.append((out, F.min(src), lambda e: F.min(e).over(after), F.min(src).over(w_after), F.least))
    if position:
        plan.append((position, F.count(F.lit(1)), lambda e: F.sum(e).over(before), F.row_number().over(w) - 1,
                     lambda near, far: near + F.coalesce(far, F.lit(0))))

    edges = ranged.groupBy(*block).agg(*[agg.alias(f"_e_{out}") for out, agg, *_ in plan])
    edges = edges.select(*[F.col(c).alias(f"_k_{c}") for c in block],
                         *[far(f"_e_{out}").alias(f"_f_{out}") for out, _, far, *_ in plan])
    local = ranged.select("*", local_first.alias("_first"), local_last.alias("_last"),
                          *[near.alias(f"_n_{out}") for out, _, _, near, _ in plan])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in block]
    return local.join(edges, same, "left").select(
        *df.columns, *[both(F.col(f"_n_{out}"), F.col(f"_f_{out}")).alias(out) for out, *_, both in plan])


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact inclusive quantiles of ``value`` per group, interpolated between neighbours, as columns named by ``shares``.

    Equal values are folded first.  Running counts over the range-sorted values then tell which one
    holds a rank, so no task has a group's values, distinct ones neither.  Nulls do not count, and
    groups that have nothing else have no row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = in_order(counts, groups, ["_v"], running={"_before": "_n"})
    totals = placed.groupBy(*[F.col(c).alias(f"_t_{c}") for c in groups]).agg(F.sum("_n").alias("_total"))
    seen = attach(placed, totals, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in groups], "inner")
    at = {name: (F.col("_total") - 1) * F.lit(float(share)) for name, share in shares.items()}
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    ends = seen.groupBy(*groups).agg(F.max("_total").alias("_total"), *[
        F.max(F.when(holds(rank(at[name])), F.col("_v").cast("double"))).alias(f"_{end}_{name}")
        for name in shares for end, rank in (("lo", F.floor), ("hi", F.ceil))])
    between = {name: F.when(F.floor(rank) == F.ceil(rank), F.col(f"_lo_{name}")).otherwise(
        (F.ceil(rank) - rank) * F.col(f"_lo_{name}") + (rank - F.floor(rank)) * F.col(f"_hi_{name}")) for name, rank in at.items()}
    return ends.select(*groups, *[x.alias(name) for name, x in between.items()])


def around(requests: DataFrame, points: DataFrame, keys: list[str], at: str, point: str) -> DataFrame:
    """As-of in both directions: the nearest point at or before and at or after each request.

    Requests and points are merged in time order; the highest point so far and
    the lowest one still to come are exactly the two neighbours.
    """
    asked = requests.select(*keys, F.col(at).cast("double").alias("_t")).distinct()
    there = points.select(*keys, F.col(point).cast("double").alias("_t")).distinct()
    # a point equal to the request has to be seen from both sides
    rows = (there.select(*keys, "_t", F.lit(0).alias("_kind"), F.col("_t").alias("_p"))
            .unionByName(asked.select(*keys, "_t", F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_p")))
            .unionByName(there.select(*keys, "_t", F.lit(2).alias("_kind"), F.col("_t").alias("_p"))))
    seen = in_order(rows, keys, ["_t", "_kind"], highest={"at_or_before": "_p"}, lowest_next={"at_or_after": "_p"})
    hits = seen.filter("_kind = 1").select(*keys, F.col("_t"), "at_or_before", "at_or_after")
    return requests.withColumn("_t", F.col(at).cast("double")).join(hits, keys + ["_t"], "left").drop("_t")


def batches(df: DataFrame, groups: list[str], order: list[str], size: int) -> DataFrame:
    """Fixed-size work batches in order: ``batch_no`` and the row's ``slot`` in it."""
    placed = in_order(df, groups, order, position="_pos")
    return placed.select(*df.columns, F.floor(F.col("_pos") / size).cast("bigint").alias("batch_no"),
                         (F.col("_pos") % size).alias("slot"))


def by_key(frames, key: list[str]):
    """Rows of one ``key`` after another from batches that come sorted by it (for ``mapInPandas``)."""
    held = []
    for frame in frames:
        for _, part in frame.groupby(key, sort=False, dropna=False):
            if held and tuple(held[-1][key].iloc[-1]) != tuple(part[key].iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)
