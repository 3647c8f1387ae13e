"""Low-rank anomaly scores of machine x sensor x time readings in long form (machine, sensor, t, value)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.arrays import empty
from driftwell.functions.columns import quantiles_of
from driftwell.operators.decomposition import MODES, cp_als, reconstruct, with_new_steps

EPSILON = 1e-8


def marginal_factors(cells: DataFrame) -> tuple[DataFrame, list[float]]:
    """Rank-1 factors from the marginal means, with the weight that makes them a mean-preserving product."""
    mean = cells.agg(F.avg("value")).first()[0] or 0.0
    parts = [cells.groupBy(F.col(m).cast("long").alias("idx")).agg(F.array(F.avg("value")).alias("vec")).select(F.lit(m).alias("mode"), "idx", "vec") for m in MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), [1 / mean**2 if mean else 0.0]


def scores(estimated: DataFrame) -> DataFrame:
    """(machine, t, score, n_unknown): norm of the residual over the norm of the readings, for each slice.

    Readings without an estimate are counted in ``n_unknown`` and not judged; a slice of such readings only has no score.
    """
    known = F.col("estimate").isNotNull()
    r, v = F.col("value") - F.col("estimate"), F.when(known, F.col("value"))
    return estimated.groupBy("machine", "t").agg((F.sqrt(F.sum(r * r)) / (F.sqrt(F.sum(v * v)) + EPSILON)).alias("score"), F.count_if(~known).alias("n_unknown"))


def relative_error(estimated: DataFrame) -> DataFrame:
    """One row: Frobenius norm of the residual over that of the readings; 0 if that is 0."""
    r, v = F.col("value") - F.col("estimate"), F.col("value")
    return estimated.agg(F.coalesce(F.try_divide(F.sqrt(F.sum(r * r)), F.sqrt(F.sum(v * v))), F.lit(0.0)).alias("relative_error"))


def threshold(train_scores: DataFrame, percentile: float = 95.0) -> DataFrame:
    """One row: an exact percentile of the scores, over ranges of them."""
    return quantiles_of(train_scores, [], "score", [percentile / 100]).select(F.col("q")[0].alias("threshold"))


def flagged(scored: DataFrame, limit: Column | float | None) -> DataFrame:
    if limit is None:
        raise RuntimeError("no threshold has been fitted")
    return scored.withColumn("is_anomaly", F.coalesce(F.col("score") > (F.lit(limit) if isinstance(limit, float) else limit), F.lit(False)))


def machine_name(index: Column) -> Column:
    return F.concat(F.lit("machine_"), F.format_string("%02d", index))


def summary(flags: DataFrame) -> DataFrame:
    """(machine, timestep, score, is_anomaly), highest score first."""
    return flags.select(machine_name(F.col("machine")).alias("machine"), F.col("t").alias("timestep"), "score", "is_anomaly").orderBy(F.desc("score"), "machine", "timestep")


def flag_rates(flags: DataFrame) -> DataFrame:
    """One row: flag rate, mean and 95th percentile of the scores, and the machine of the highest."""
    sums = flags.agg(
        F.avg(F.col("is_anomaly").cast("double")).alias("flag_rate"), F.avg("score").alias("mean_score"),
        F.max_by("machine", F.struct(F.col("score"), -F.col("machine"), -F.col("t"))).alias("peak_machine"),
    )
    return sums.crossJoin(threshold(flags)).select("flag_rate", "mean_score", F.col("threshold").alias("p95_score"), "peak_machine")  # one row each


def rate_ratio(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: flag rates of both parts and the test's over the train's mean score; 0 where that is 0."""
    own = lambda df, name: df.agg(F.avg(F.col("is_anomaly").cast("double")).alias(f"{name}_rate"), F.avg("score").alias(f"{name}_mean"))
    return own(train, "train").crossJoin(own(test, "test")).withColumn("ratio", F.coalesce(F.try_divide("test_mean", "train_mean"), F.lit(0.0)))  # one row each


def top_flagged(flags: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` flagged slices of highest score."""
    return summary(flags.where("is_anomaly")).limit(n)


#: Bits by which the cells of one level are wider than those of the level below.
LEVEL_BITS = 3


def covering_cells(start: Column, end: Column, levels: int) -> Column:
    """The fewest cells (level, cell) that make up [start, end): at each level at most seven at either end."""
    width, kind = 1 << LEVEL_BITS, "struct<level:int,cell:bigint>"
    run = lambda level, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(level.alias("level"), x.alias("cell")))).otherwise(empty(kind))

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        # The least multiple of the width from a on, and the greatest up to b.
        inner_a, inner_b = F.shiftright(a + width - 1, LEVEL_BITS), F.shiftright(b, LEVEL_BITS)
        left_end = F.least(inner_a * width, b)
        right_start = F.greatest(inner_b * width, left_end)
        return F.struct(inner_a.alias("a"), F.greatest(inner_b, inner_a).alias("b"), F.concat(s["out"], run(level, a, left_end), run(level, right_start, b)).alias("out"))

    state = F.struct(start.alias("a"), F.greatest(start, end).alias("b"), empty(kind).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), state, step, lambda s: s["out"])


def fault_hits(flags: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window (machine, t_start, t_end, type) with its highest score and flagged slices; the end is exclusive, equal windows are one.

    Windows and scores don't meet pairwise: time is divided into cells of several widths, scores are summed up for each cell,
    and a window is made up of few cells, which it meets by an equijoin, however many windows and scores a machine has.
    """
    own = windows.select("machine", F.col("t_start").cast("long").alias("t_start"), F.col("t_end").cast("long").alias("t_end"), "type").distinct()
    longest = own.agg(F.max(F.col("t_end") - F.col("t_start"))).first()[0] or 0
    levels = 1 + max(0, -(-int(longest).bit_length() // LEVEL_BITS))
    cells = flags.select("machine", F.col("t").cast("long").alias("t"), "score", "is_anomaly").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    cells = cells.groupBy("machine", "level", F.expr(f"shiftright(t, level * {LEVEL_BITS})").alias("cell")).agg(F.max("score").alias("score"), F.count_if("is_anomaly").alias("n"))
    parts = own.withColumn("c", F.explode_outer(covering_cells(F.col("t_start"), F.col("t_end"), levels))).select("machine", "t_start", "t_end", "type", F.col("c.level").alias("level"), F.col("c.cell").alias("cell"))
    met = parts.join(cells, ["machine", "level", "cell"], "left")
    return met.groupBy("machine", "t_start", "t_end", "type").agg(F.max("score").alias("max_score"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_flagged"))


def score_matrix(scored: DataFrame, steps: list[int]) -> DataFrame:
    """A row for each machine, a column for each of ``steps``; keep the long form where time is wide."""
    return scored.groupBy("machine").pivot("t", steps).agg(F.first("score"))


def score_rows(scored: DataFrame) -> DataFrame:
    """A row for each machine: all of its time steps, and their scores in the same order."""
    rows = scored.groupBy("machine").agg(F.array_sort(F.collect_list(F.struct("t", "score"))).alias("row"))
    return rows.select("machine", F.col("row.t").alias("steps"), F.col("row.score").alias("scores"))


@dataclass(frozen=True)
class Detector:
    """A fitted model of normal readings: ``estimate`` adds estimates to cells; the threshold is a percentile of training scores."""

    estimate: Callable[[DataFrame], DataFrame]
    threshold: float

    def flag(self, cells: DataFrame) -> DataFrame:
        return flagged(scores(self.estimate(cells)), self.threshold)


def fit_detector(normal: DataFrame, rank: int = 10, percentile: float = 95.0, rounds: int = 200, seed: int = 0, decompose: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None) -> Detector:
    """A detector from normal readings, by CP or by any ``decompose`` that gives a function adding estimates.

    With CP, rows of time steps that the normal readings lack are solved from their own readings.
    """
    if decompose is None:
        found = cp_als(normal, rank, rounds, seed=seed)
        estimate = lambda cells: reconstruct(cells, with_new_steps(found, cells), found.weights)
    else:
        estimate = decompose(normal)
    limit = threshold(scores(estimate(normal)), percentile).first()[0]
    return Detector(estimate, float(limit))
