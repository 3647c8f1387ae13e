"""CP decomposition of cells (machine, sensor, t, value) with the factors of every mode as Spark tables.

A mode's rows follow from sums of products over its cells, by key; the driver holds rank x rank matrices only. Spark
broadcasts the factors of a mode where their table is small, and shuffles them where it isn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.sources.shared import discard, materialise, written
from driftwell.sources.shipping import ship

MODES = ("machine", "sensor", "t")


@dataclass(frozen=True)
class Factors:
    """``frame``: (mode, idx, vec) with columns of unit norm over each mode; weights; and the fit, 1 less the relative error."""

    frame: DataFrame
    weights: list[float]
    fit: float


def ready(cells: DataFrame) -> DataFrame:
    """(machine, sensor, t, value) of the cells that have all of them."""
    typed = cells.select(*(F.col(m).cast("long").alias(m) for m in MODES), F.col("value").cast("double").alias("value"))
    return typed.where(" and ".join(f"{c} is not null" for c in (*MODES, "value")))


def _columns(prefix: str, model: int, rank: int) -> list[str]:
    return [f"{prefix}{model}_{r}" for r in range(rank)]


def _with_factors(cells: DataFrame, tables: dict[str, DataFrame], modes: list[str], ranks: list[int], *more: str) -> DataFrame:
    """``cells`` with ``z0_0``...: for each model, the products of the rows of ``modes``."""
    places = [f"{k}_{r}" for k, rank in enumerate(ranks) for r in range(rank)]
    for m in modes:
        cells = cells.join(tables[m].select(F.col("idx").alias(m), *(F.col(f"x{c}").alias(f"_{m}{c}") for c in places)), m)
    return cells.select(*MODES, "value", *more, *(reduce(Column.__mul__, [F.col(f"_{m}{c}") for m in modes]).alias(f"z{c}") for c in places))


def _pairs(rank: int) -> list[tuple[int, int]]:
    return [(p, q) for p in range(rank) for q in range(p, rank)]


def _grams(table: DataFrame, ranks: list[int], sums: list[Column] | None = None) -> tuple[list[np.ndarray], list[float]]:
    """(each model's products of a factor table's columns with each other, further sums), read in one pass."""
    products = [F.sum(F.col(f"x{k}_{p}") * F.col(f"x{k}_{q}")) for k, rank in enumerate(ranks) for p, q in _pairs(rank)]
    row = list(table.agg(*(F.coalesce(c, F.lit(0.0)) for c in products + (sums or []))).first())
    grams = []
    for rank in ranks:
        gram = np.zeros((rank, rank))
        for p, q in _pairs(rank):
            gram[p, q] = gram[q, p] = row.pop(0)
        grams.append(gram)
    return grams, row


def _combined(names: list[str], matrix: np.ndarray, to: list[str]) -> list[Column]:
    """Columns ``to``: a row of ``names`` times a matrix of the driver's."""
    return [sum(F.col(c) * F.lit(float(matrix[q, r])) for q, c in enumerate(names)).alias(name) for r, name in enumerate(to)]


def cp_als(cells: DataFrame, rank: int, rounds: int = 200, tolerance: float = 1e-7, seed: int = 0) -> Factors:
    """CP factors by alternating least squares (Kolda and Bader 2009); absent cells count as 0.

    First factors come from hashes of the indices. Each factor table is written when it is worked out, and the one before deleted.
    """
    return cp_models(cells, [(rank, F.lit(True))], rounds, tolerance, seed)[0]


def cp_models(cells: DataFrame, models: list[tuple[int, Column]], rounds: int = 200, tolerance: float = 1e-7, seed: int = 0) -> list[Factors]:
    """The factors of several models, each (rank, which cells it is fitted on), side by side: one pass over the cells for
    each mode and round serves them all. Rounds end when no model's fit changes any more.

    Each model's factors are those that ``cp_als`` finds on its own cells; indices without such cells have no row.
    """
    spark = cells.sparkSession
    every, ranks = range(len(models)), [rank for rank, _ in models]
    kept = [f"k{k}" for k in every]
    own = materialise(ready(cells).select(*MODES, "value", *(F.coalesce(where, F.lit(False)).alias(f"k{k}") for k, (_, where) in enumerate(models))))
    totals = [float(v or 0.0) for v in own.agg(*(F.sum(F.when(F.col(k), F.col("value") * F.col("value"))) for k in kept)).first()]
    first = lambda m, k, r: F.when(F.col(f"k{k}"), F.pmod(F.xxhash64("idx", F.lit(m), F.lit(r), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)).otherwise(0.0)
    tables = {}
    for m in MODES:
        held = own.groupBy(F.col(m).alias("idx")).agg(*(F.max(k).alias(k) for k in kept))
        tables[m] = materialise(held.select("idx", *kept, *(first(m, k, r).alias(f"x{k}_{r}") for k in every for r in range(ranks[k]))))
    grams = {m: _grams(t, ranks)[0] for m, t in tables.items()}
    places: dict[str, str] = {}
    weights, fits = [np.ones(rank) for rank in ranks], [1.0 for _ in every]
    last = [-1.0 for _ in every]
    for _ in range(rounds if any(totals) else 0):
        inner = [0.0 for _ in every]
        for mode in MODES:
            rest = [m for m in MODES if m != mode]
            joined = _with_factors(own, tables, rest, ranks, *kept)
            summed = [F.coalesce(F.sum(F.when(F.col(f"k{k}"), F.col("value") * F.col(f"z{k}_{r}"))), F.lit(0.0)).alias(f"s{k}_{r}") for k in every for r in range(ranks[k])]
            sums = joined.groupBy(F.col(mode).alias("idx")).agg(*(F.max(k).alias(k) for k in kept), *summed)
            solved = [_combined(_columns("s", k, ranks[k]), np.linalg.pinv(grams[rest[0]][k] * grams[rest[1]][k]), _columns("x", k, ranks[k])) for k in every]
            new, place = written(sums.select("*", *(c for one in solved for c in one)))
            found, inner = _grams(new, ranks, [F.sum(sum(F.col(f"s{k}_{r}") * F.col(f"x{k}_{r}") for r in range(ranks[k]))) for k in every])
            weights = [np.sqrt(np.maximum(gram.diagonal(), 0.0)) for gram in found]
            sizes = [np.where(w > 0, w, 1.0) for w in weights]
            grams[mode] = [gram / np.outer(size, size) for gram, size in zip(found, sizes, strict=True)]
            tables[mode] = new.select("idx", *kept, *((F.col(f"x{k}_{r}") / F.lit(float(sizes[k][r]))).alias(f"x{k}_{r}") for k in every for r in range(ranks[k])))
            if mode in places:
                discard(spark, places[mode])
            places[mode] = place
        for k in every:
            square = max(0.0, totals[k] - 2 * inner[k] + float(weights[k] @ (grams["machine"][k] * grams["sensor"][k] * grams["t"][k]) @ weights[k]))
            fits[k] = 1 - (square / totals[k]) ** 0.5 if totals[k] else 1.0
        if all(abs(fit - before) < tolerance for fit, before in zip(fits, last, strict=True)):
            break
        last = list(fits)
    frame = lambda k: reduce(DataFrame.unionByName, [t.where(f"k{k}").select(F.lit(m).alias("mode"), "idx", F.array(*_columns("x", k, ranks[k])).alias("vec")) for m, t in tables.items()])
    return [Factors(frame(k), [float(w) for w in (weights[k] if totals[k] else np.ones(ranks[k]))], fits[k]) for k in every]


def _table(factors: Factors, mode: str) -> DataFrame:
    return factors.frame.where(F.col("mode") == mode).select("idx", *(F.col("vec")[r].alias(f"x0_{r}") for r in range(len(factors.weights))))


def solved_rows(cells: DataFrame, factors: Factors, mode: str = "t") -> DataFrame:
    """(mode, idx, vec): rows of one mode for all indices of ``cells``, by least squares over their present cells, the other modes fixed.

    The normal equations of each index are sums by key; their small systems are solved in Arrow batches.
    """
    rank, rest = len(factors.weights), [m for m in MODES if m != mode]
    joined = _with_factors(ready(cells), {m: _table(factors, m) for m in rest}, rest, [rank])
    z = [F.col(f"z0_{r}") * F.lit(w) for r, w in enumerate(factors.weights)]
    sums = joined.groupBy(F.col(mode).alias("idx")).agg(
        F.array(*(F.sum(F.col("value") * z[r]) for r in range(rank))).alias("right"), F.array(*(F.sum(z[p] * z[q]) for p, q in _pairs(rank))).alias("left")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.array(_pairs(rank)).T
        for batch in batches:
            n = batch.num_rows
            right = batch.column(1).flatten().to_numpy().reshape(n, rank)
            left = np.zeros((n, rank, rank))
            left[:, upper[0], upper[1]] = left[:, upper[1], upper[0]] = batch.column(2).flatten().to_numpy().reshape(n, -1)
            rows = np.einsum("nij,nj->ni", np.linalg.pinv(left, rcond=1e-9, hermitian=True), right)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["idx", "vec"])

    ship(cells.sparkSession)
    return sums.mapInArrow(run, "idx long, vec array<double>").select(F.lit(mode).alias("mode"), "idx", "vec")


def with_new_steps(factors: Factors, cells: DataFrame) -> DataFrame:
    """The factor table with rows for the time steps of ``cells`` that it lacks, solved from their readings."""
    known = factors.frame.where("mode = 't'").select(F.col("idx").alias("t"))
    return factors.frame.unionByName(solved_rows(cells.join(known, "t", "left_anti").select(*MODES, "value"), factors))


def reconstruct(cells: DataFrame, factors: DataFrame, weights: list[float]) -> DataFrame:
    """``cells`` with ``estimate``: sum over r of w_r a_ir b_jr c_kr, from factors (mode, idx, vec); null where a factor is missing.

    A factor has a row for each machine, sensor or time step, far fewer than cells; Spark
    broadcasts those that are small enough and shuffles the others.
    """
    for mode in MODES:
        own = factors.where(F.col("mode") == mode).select(F.col("idx").alias(mode), F.col("vec").alias(f"_{mode}"))
        cells = cells.join(own, mode, "left")
    terms = [F.lit(float(w)) * F.col("_machine")[r] * F.col("_sensor")[r] * F.col("_t")[r] for r, w in enumerate(weights)]
    return cells.withColumn("estimate", sum(terms[1:], terms[0])).drop(*(f"_{m}" for m in MODES))


def held_out_errors(cells: DataFrame, ranks: list[int], folds: int = 3, rounds: int = 50, seed: int = 0) -> list[tuple[int, int, float]]:
    """(rank, fold, relative error): factors are fitted without a fold's time steps, all ranks and folds side by side; the
    steps' rows are solved from one half of their cells, and the error is that of the other half."""
    own = materialise(ready(cells))
    fold = F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(folds))
    half = F.pmod(F.xxhash64(*MODES, F.lit(seed)), F.lit(2))
    tried = [(rank, k) for rank in ranks for k in range(folds)]
    out = []
    for (rank, k), fitted in zip(tried, cp_models(own, [(rank, fold != k) for rank, k in tried], rounds, seed=seed), strict=True):
        left = own.where(fold == k)
        rows = solved_rows(left.where(half == 0), fitted)
        estimated = reconstruct(left.where(half == 1), fitted.frame.where("mode <> 't'").unionByName(rows), fitted.weights).where("estimate is not null")
        r, v = F.col("value") - F.col("estimate"), F.col("value")
        out.append((rank, k, estimated.agg(F.coalesce(F.try_divide(F.sqrt(F.sum(r * r)), F.sqrt(F.sum(v * v))), F.lit(0.0))).first()[0]))
    return out


def chosen_rank(errors: list[tuple[int, int, float]], slack: float = 0.005) -> int:
    """The smallest rank whose mean held-out error is at most ``slack`` above the least."""
    means = {r: float(np.mean([e for x, _, e in errors if x == r])) for r in sorted({r for r, _, _ in errors})}
    return next(r for r, e in means.items() if e <= min(means.values()) + slack)
