"""Column helpers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, NumericType, StructField, StructType

from driftwell.sources.shared import materialise
from driftwell.sources.shipping import ship


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def shared_numeric_columns(a: DataFrame, b: DataFrame, wanted: list[str] | None = None) -> list[str]:
    """Numeric columns of both, sorted; names in ``wanted`` that are not among them are skipped."""
    both = sorted(set(numeric_columns(a)) & set(numeric_columns(b)))
    return both if wanted is None else [c for c in wanted if c in both]


def present(column: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with NULL or NaN in any of ``columns`` go."""
    for c in columns:
        kind = df.schema[c].dataType
        df = df.where(present(c) if isinstance(kind, FloatType | DoubleType) else F.col(c).isNotNull())
    return df


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or ``default`` on zero or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def long_values(df: DataFrame, columns: list[str], **tags: Column) -> DataFrame:
    """(tags..., feature, value double) for each present value of ``columns``: one pass, no shuffle."""
    wide = df.select(*(c.alias(n) for n, c in tags.items()), *(F.col(c).cast("double").alias(c) for c in columns))
    return wide.unpivot(list(tags), columns, "feature", "value").where(present("value"))


def running_sums(df: DataFrame, group: list[str], order: str, sums: list[str]) -> DataFrame:
    """``df`` with ``cum_<c>`` for each of ``sums`` (counts, 0 or more): totals of the rows of the group up to this one, it included.

    (group, order) must be unique. A group's rows lie in ranges over many partitions: each range is summed as it is
    written, once, and the totals of the group's ranges before it are added on reading, so that no task holds a whole group.
    """
    spark = ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sums), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cum = [np.cumsum(batch.column(c).to_numpy()) + t for c, t in zip(sums, total, strict=True)]
            total = np.array([c[-1] for c in cum], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cum)], [*batch.schema.names, *(f"_p_{c}" for c in sums)])

    # A fixed number of ranges, so that they are not merged to a few.
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns({c: F.col(c).cast("long") for c in sums}).repartitionByRange(ranges, *group, order).sortWithinPartitions(*group, order).withColumn("_range", F.spark_partition_id())
    fields = StructType([*placed.schema.fields, *(StructField(f"_p_{c}", LongType()) for c in sums)])
    summed = materialise(placed.mapInArrow(run, fields))
    part = lambda c: [F.min(F.col(f"_p_{c}") - F.col(c)).alias(f"_a_{c}"), F.max(f"_p_{c}").alias(f"_b_{c}")]
    totals = summed.groupBy(*group, "_range").agg(*(x for c in sums for x in part(c)))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range and group: at most as many as partitions plus groups. Written, so that Spark knows how small they are.
    keys = [F.col(c).alias(f"_g{k}") for k, c in enumerate(group)]
    offsets = materialise(totals.select(*keys, F.col("_range").alias("_in"), *((F.coalesce(F.sum(F.col(f"_b_{c}") - F.col(f"_a_{c}")).over(before), F.lit(0)) - F.col(f"_a_{c}")).alias(f"_o_{c}") for c in sums)))
    same = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(group)]
    joined = summed.join(offsets, [F.col("_range") == F.col("_in"), *same])
    return joined.select(*df.columns, *((F.col(f"_p_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums))


def quantiles(summed: DataFrame, group: list[str], value: str, count: str, points: list[float]) -> DataFrame:
    """(group, q): exact quantiles by linear interpolation, an array in the order of ``points``; groups are few, like features.

    ``summed`` has each value of a group once, with its ``count`` and the running sum ``cum_<count>``, as
    ``running_sums`` gives them: a row knows which ranks it holds, so that no task holds a group. Groups without a count have no row.
    """
    cum = F.col(f"cum_{count}")
    rank = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ends = F.array_distinct(F.array(*(e(rank(p)).cast("long") for p in points for e in (F.floor, F.ceil))))
    needed = F.broadcast(summed.groupBy(*group).agg(F.max(cum).alias("_n")).where("_n > 0").withColumn("_ranks", ends))
    rows = summed.where(F.col(count) > 0)
    held = rows.join(needed, group) if group else rows.crossJoin(needed)  # one row on the right
    grid = next((m for m in range(1, 101) if all(abs(p * m - round(p * m)) < 1e-9 for p in points)), None)
    if grid:
        # Points i / grid: one comparison leaves few rows, those whose ranks, or the ones beside them, reach over a point.
        scale = F.try_divide(F.lit(float(grid)), F.col("_n") - 1)
        held = held.where(F.coalesce(F.ceil(cum * scale + 1e-9) - F.floor((cum - F.col(count) - 1) * scale - 1e-9) > 1, F.lit(True)))
    # Only the rows that hold a needed rank go on.
    at = held.select(*group, "_n", F.col(value).alias("_v"), F.explode(F.filter("_ranks", lambda x: (x >= cum - F.col(count)) & (x < cum))).alias("_rank"))
    found = at.groupBy(*group).agg(F.any_value("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    value_at = lambda r: F.element_at("_at", r.cast("long"))
    q = [value_at(F.floor(rank(p))) + (value_at(F.ceil(rank(p))) - value_at(F.floor(rank(p)))) * (rank(p) - F.floor(rank(p))) for p in points]
    return found.select(*group, F.array(*q).alias("q"))


#: Up to so many distinct values Spark's own percentile holds them in one task.
FEW_VALUES = 250_000


def quantiles_of(df: DataFrame, group: list[str], value: str, points: list[float]) -> DataFrame:
    """(group, q): exact quantiles of a column's present values; by ranges of them where the distinct ones, which are counted, are many."""
    ties = materialise(df.where(present(value)).groupBy(*group, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("k")))
    if ties.count() <= FEW_VALUES:
        return ties.groupBy(*group).agg(F.percentile(value, F.array(*(F.lit(float(p)) for p in points)), F.col("k")).alias("q")).where("q is not null")
    return quantiles(running_sums(ties, group, value, ["k"]), group, value, "k", points)


def kolmogorov_p(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value; 1 below 0.2, where the series doesn't converge."""
    x = statistic * F.sqrt(n * m / (n + m))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)))


def turn(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value's place in its period."""
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)
