"""Building blocks that stay balanced when one key holds a large share of the rows.

A window partitioned by a hot key puts that key into one task.  The helpers here use partial
aggregation, key slices or salts instead, and give exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.session import through_table

ROWS_PER_RANGE = 1_000_000


def attach_groups(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Each row with aggregates of its key group, as aggregate plus null-safe equi-join.

    The aggregate combines on the map side; in the join AQE may split a skewed partition, which it
    cannot do for a window.
    """
    stats = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        *[c.alias(n) for n, c in aggs.items()]
    )
    cond = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = part if cond is None else cond & part
    return df.join(stats, cond).drop(*[f"__{k}" for k in keys])


def salted_join(big: DataFrame, other: DataFrame, on: list[str], spread: list[str],
                salts: int = 16) -> DataFrame:
    """Inner equi-join with the keys of ``big`` spread over ``salts`` sub-keys.

    The salt is a hash of the ``spread`` columns (an id of ``big``), so a recomputed task sends
    every row to the same place.
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, on + ["__salt"]).drop("__salt")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int,
             rank_name: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Spark limits each group before the shuffle (window group limit),
    so a hot key ships at most ``k`` rows per input partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).where(F.col(rank_name) <= k)


def lag_rows(df: DataFrame, keys: list[str], order: list[str], slice_by: Column,
             values: list[str], out: str = "prev") -> DataFrame:
    """``out`` = struct of the previous row's ``values`` in key order (null for the first row).

    ``slice_by`` must be monotone in ``order`` (for example the calendar day of the event time).
    The window runs per (key, slice); the last row of the preceding slice fills the slice borders.
    """
    ordered = [F.col(c) for c in order]
    rows = df.withColumn("__slice", slice_by)
    w = Window.partitionBy(*keys, "__slice").orderBy(*ordered)
    rows = rows.withColumn("__lag", F.lag(F.struct(*values)).over(w))
    ends = rows.groupBy(*keys, "__slice").agg(
        F.max_by(F.struct(*values), F.struct(*ordered)).alias("__end")
    )
    across = Window.partitionBy(*keys).orderBy("__slice")
    ends = ends.select(*keys, "__slice", F.lag("__end").over(across).alias("__before"))
    return (
        rows.join(ends, keys + ["__slice"])
        .withColumn(out, F.coalesce("__lag", "__before"))
        .drop("__slice", "__lag", "__before")
    )


def lead_rows(df: DataFrame, keys: list[str], order: list[str], slice_by: Column,
              values: list[str], out: str = "next") -> DataFrame:
    """Mirror of :func:`lag_rows`: struct of the following row's ``values``."""
    ordered = [F.col(c) for c in order]
    rows = df.withColumn("__slice", slice_by)
    w = Window.partitionBy(*keys, "__slice").orderBy(*ordered)
    rows = rows.withColumn("__lead", F.lead(F.struct(*values)).over(w))
    heads = rows.groupBy(*keys, "__slice").agg(
        F.min_by(F.struct(*values), F.struct(*ordered)).alias("__head")
    )
    across = Window.partitionBy(*keys).orderBy("__slice")
    heads = heads.select(*keys, "__slice", F.lead("__head").over(across).alias("__after"))
    return (
        rows.join(heads, keys + ["__slice"])
        .withColumn(out, F.coalesce("__lead", "__after"))
        .drop("__slice", "__lead", "__after")
    )


def number_rows(df: DataFrame, keys: list[str], order: list[str], slice_by: Column,
                out: str = "row_no") -> DataFrame:
    """Row number per key in ``order``: number inside the slice plus the size of earlier slices."""
    rows = df.withColumn("__slice", slice_by)
    w = Window.partitionBy(*keys, "__slice").orderBy(*[F.col(c) for c in order])
    rows = rows.withColumn("__no", F.row_number().over(w))
    sizes = rows.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = (
        Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = sizes.select(
        *keys, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    return (
        rows.join(sizes, keys + ["__slice"])
        .withColumn(out, F.col("__no") + F.col("__off"))
        .drop("__slice", "__no", "__off")
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str,
                      probs: dict[str, float], splits: int | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles (inclusive method) per key, without one task or one
    hash map ever holding a whole group.

    Equal values are counted first.  A bounded sketch then gives ``splits`` cut points per key,
    the counted values are ranked inside each cut range, and range totals supply the offset, so
    only ranks are exact-critical and the sketch quality does not affect the result.  The cut points are
    written once: a sketch depends on the order in which parts are merged, and ranks and range totals must
    see the same cuts.  ``splits`` follows the number of rows unless it is given, so that a range stays a
    task's worth of values.
    """
    if splits is None:
        splits = max(64, -(-df.count() // ROWS_PER_RANGE))
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    cuts = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    sketch_keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    sketch = through_table(counted.groupBy(*sketch_keys).agg(
        F.percentile_approx("__v", cuts, F.lit(max(1000, 10 * splits))).alias("__cuts"),
        F.sum("__n").alias("__total"),
    ), "percentile-cuts")
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    if keys:
        rows = counted.join(sketch, cond)
    else:
        rows = counted.withColumn("__cuts", sketch.select("__cuts").scalar()).withColumn(
            "__total", sketch.select("__total").scalar()
        )
    rows = rows.withColumn(
        "__range", F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))
    ).drop("__cuts", *[f"__k{i}" for i in range(len(keys))])
    inside = (
        Window.partitionBy(*keys, "__range").orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("__cum", F.sum("__n").over(inside))
    totals = rows.groupBy(*keys, "__range").agg(F.sum("__n").alias("__rn"))
    # at most ``splits`` rows per key reach this window
    before = (
        Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__range").alias("__r"),
        F.coalesce(F.sum("__rn").over(before), F.lit(0)).alias("__off"),
    )
    cond = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = rows.join(totals, cond).withColumn("__hi", F.col("__off") + F.col("__cum"))
    rows = rows.withColumn("__lo", F.col("__hi") - F.col("__n"))
    aggs = []
    for name, p in probs.items():
        pos = (F.col("__total") - 1) * F.lit(p)
        lo_at = F.floor(pos)
        hi_at = F.ceil(pos)
        holds_lo = (F.col("__lo") <= lo_at) & (lo_at < F.col("__hi"))
        holds_hi = (F.col("__lo") <= hi_at) & (hi_at < F.col("__hi"))
        low = F.max(F.when(holds_lo, F.col("__v").cast("double")))
        high = F.max(F.when(holds_hi, F.col("__v").cast("double")))
        frac = F.max(pos - lo_at)
        aggs.append((low + (high - low) * frac).alias(name))
    return rows.groupBy(*keys).agg(F.max("__total").alias("n"), *aggs)
