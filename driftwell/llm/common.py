"""Helpers shared by the operators: reading tables, bounded caches, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.sources.shared import discard, materialise, written
from driftwell.sources.shipping import ship

__all__ = ["BoundedCache", "component_labels", "join_often", "materialise", "on_executors", "slices", "smallest_hashes", "table", "text_of", "with_least"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def on_executors(df: DataFrame) -> DataFrame:
    """``df`` as it is, after its session's executors have been given this package."""
    ship(df.sparkSession)
    return df


def text_of(column: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


class BoundedCache(dict):
    """Results of ``make`` by key. It starts anew at ``limit`` entries; long keys are not kept."""

    def __init__(self, make: Callable[[Any], Any], limit: int = 700_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def slices(batch, rows: int = 512) -> Iterator:
    """Parts of an Arrow batch, so that few Python strings live at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def smallest_hashes(df: DataFrame, key: str, n: int, limit: int, seed: int = 0) -> DataFrame:
    """The ``limit`` rows of a table of ``n`` with the smallest hashes of ``key``, which should be unique.

    A bound on the hash, from the count, leaves little more than ``limit`` rows to be sorted. Should it leave fewer,
    which a table of few different keys can bring about, all rows are sorted.
    """
    h = F.xxhash64(key, F.lit(seed))
    if n > 2 * limit:
        below = int(-(1 << 63) + (1 << 64) * min(1.0, (limit + 8 * limit**0.5 + 64) / n))
        few = df.where(h < below)
        if few.count() >= limit:
            df = few
    return df.orderBy(h, key).limit(limit)


def join_often(rows: DataFrame, told: DataFrame, keys: list[str], often: str, n: int, how: str = "inner") -> DataFrame:
    """``rows``, about ``n`` of them, joined with ``told``, which has each key once and in ``often`` the number of rows that it meets.

    Keys of over 1/50,000 of the rows, and of over 1,000, are at most 50,000; they come by broadcast, so that no task gathers the
    rows of a common key. The others are joined by shuffle, or as Spark decides. ``often`` is not part of the result.
    """
    most = max(1000, n // 50_000)
    columns = [*rows.columns, *(c for c in told.columns if c not in (*keys, often))]
    marked = rows.join(F.broadcast(told.where(F.col(often) > most).withColumn("_hot", F.lit(True))), keys, "left")
    others = marked.where("_hot is null").select(*rows.columns).join(told.where(F.col(often) <= most), keys, how)
    return marked.where("_hot").select(*columns).unionByName(others.select(*columns))


def with_least(rows: DataFrame, n: int, least: int = 1) -> DataFrame:
    """(u, v, m) from (u, v) of about ``n`` rows: m is the least v of each u that has ``least`` rows or more."""
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    return join_often(rows, low.where(F.col("k") >= least), ["u"], "k", n)


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, component = smallest member).

    Large-star and small-star in turn (Kiveris et al. 2014): each round leaves at most as many edges as
    before. Least neighbours are found by ``min`` with map-side combining, and given to a hub's edges by
    broadcast (``with_least``), so that no task holds a hub's neighbours. Null ends and loops are ignored; an empty table gives no rows.
    """
    spark = edges.sparkSession
    pairs, place = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    signature, n = None, pairs.count()
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, as the small star reads these edges several times. Of both tables of a round only the last is read later.
        large, large_place = written(
            with_least(both, 2 * n).where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        )
        small = (
            with_least(large, 2 * n)
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        old, (pairs, place) = place, written(small)
        discard(spark, old)
        discard(spark, large_place)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == signature:
            break
        signature, n = tuple(now), now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = pairs.groupBy("u").agg(F.min("v").alias("component"))
    roots = pairs.select(F.col("v").alias("u")).distinct().withColumn("component", F.col("u"))
    return labels.unionByName(roots).groupBy("u").agg(F.min("component").alias("component")).withColumnRenamed("u", "node")
