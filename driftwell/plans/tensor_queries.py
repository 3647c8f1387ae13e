"""Queries on machine x sensor x time readings: users in twenties as machines, event types as sensors, days as steps."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from driftwell.operators import decomposition, drift, tensor
from driftwell.sources.shared import materialise
from driftwell.sources.tables import read



def _cells(spark, d):
    e = read(spark, d, "events")
    code = F.pmod(F.crc32("event_type"), F.lit(97))
    return e.where("value is not null").groupBy((F.col("user_id") % 20).alias("machine"), code.alias("sensor"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("t")).agg(F.sum("value").alias("value"))


def _scores(spark, d):
    cells = materialise(_cells(spark, d))
    return tensor.scores(decomposition.reconstruct(cells, *tensor.marginal_factors(cells)))


def _flags(spark, d):
    s = materialise(_scores(spark, d))
    return tensor.flagged(s.crossJoin(tensor.threshold(s)), F.col("threshold")).drop("threshold")  # one row on the right


def tensor_score(spark, d):
    return _scores(spark, d).select("machine", "t", F.round("score", 6).alias("score"))


def tensor_error(spark, d):
    cells = materialise(_cells(spark, d))
    return tensor.relative_error(decomposition.reconstruct(cells, *tensor.marginal_factors(cells))).select(F.round("relative_error", 6).alias("relative_error"))


def tensor_flags(spark, d):
    s = tensor.summary(_flags(spark, d))
    return s.where("is_anomaly").select("machine", "timestep", F.round("score", 6).alias("score"), "is_anomaly")


def tensor_flag_rates(spark, d):
    r = tensor.flag_rates(_flags(spark, d))
    return r.select(F.round("flag_rate", 6).alias("flag_rate"), F.round("mean_score", 6).alias("mean_score"), F.round("p95_score", 6).alias("p95_score"), "peak_machine")


def fault_windows(spark, d):
    n = read(spark, d, "nation").select((F.col("n_nationkey") % 20).cast("long").alias("machine"), F.col("n_nationkey").cast("long").alias("t_start"), (F.col("n_nationkey") + 5).cast("long").alias("t_end"), F.col("n_name").alias("type"))
    return tensor.fault_hits(_flags(spark, d), n).select("machine", "t_start", "t_end", "type", F.round("max_score", 6).alias("max_score"), "n_flagged")


STEPS = range(31)


def score_matrix(spark, d):
    """The score matrix of all days of the month, a column for each."""
    m = tensor.score_matrix(_scores(spark, d), list(STEPS))
    return m.select("machine", *(F.round(F.col(str(k)), 6).alias(f"t{k}") for k in STEPS))


def tensor_rank2(spark, d):
    """Scores against given factors of rank 2."""
    cells = materialise(_cells(spark, d))
    part = lambda m, v: cells.select(F.lit(m).alias("mode"), F.col(m).cast("long").alias("idx")).distinct().withColumn("vec", v)
    idx = F.col("idx").cast("double")
    factors = part("machine", F.array(F.lit(1.0), 0.1 * idx)).unionByName(part("sensor", F.array(1.0 + 0.01 * idx, F.lit(0.5)))).unionByName(part("t", F.array(F.lit(1.0), 1.0 - 0.02 * idx)))
    return tensor.scores(decomposition.reconstruct(cells, factors, [40.0, 3.0])).select("machine", "t", F.round("score", 6).alias("score"))


def flag_rate_ratio(spark, d):
    """Flag rates before and from day 20 on, and the ratio of mean scores."""
    f = _flags(spark, d)
    r = tensor.rate_ratio(f.where("t < 20"), f.where("t >= 20"))
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


def score_histogram(spark, d):
    f = _flags(spark, d).withColumn("side", F.when(F.col("t") < 20, "train").otherwise("test"))
    return drift.score_histogram(f).select("side", "bin", "n", F.round("density", 6).alias("density"))


def tensor_top_flagged(spark, d):
    return tensor.top_flagged(_flags(spark, d), 20).select("machine", "timestep", F.round("score", 6).alias("score"), "is_anomaly")


def score_matrix_all(spark, d):
    """The score matrix of all time steps in long form, for time axes that are too wide for columns."""
    return tensor.score_rows(_scores(spark, d).withColumn("score", F.round("score", 6)))


def _planted(spark, d, zeros=False):
    """Readings of a known product of rank 2 for twenty machines, five sensors and the events' days."""
    days = read(spark, d, "events").select(F.dayofmonth("ts").cast("long").alias("t")).distinct()
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = days.withColumn("machine", upto(20)).withColumn("sensor", upto(5))
    m, j, t = F.col("machine"), F.col("sensor"), F.col("t")
    one = F.when((m < 10) & (j < 2) & (t % 2 == 0), (m + 1) * (j + 2) * (1.0 + t / 10))
    two = F.when((m >= 10) & (j >= 2) & (t % 2 == 1), (20.0 - m) * j * (t % 3 + 1))
    planted = cells.select("machine", "sensor", "t", F.coalesce(one, two).alias("value"))
    # Absent readings count as 0 when factors are fitted.
    return planted.na.fill(0.0, ["value"]) if zeros else planted.where("value is not null")


def cp_als(spark, d):
    """The error of the factors of rank 2 on planted readings of that rank, and whether it is what the fit says."""
    cells = materialise(_planted(spark, d))
    found = decomposition.cp_als(cells, rank=2, rounds=6)
    error = tensor.relative_error(decomposition.reconstruct(cells, found.frame, found.weights))
    return error.select(F.round("relative_error", 2).alias("relative_error"), (F.abs(F.col("relative_error") - F.lit(1 - found.fit)) < 1e-5).alias("as_fitted"))


def rank_choice(spark, d):
    """Held-out errors of ranks 1 to 3 on planted readings of rank 2: which fit, and which is chosen."""
    errors = decomposition.held_out_errors(_planted(spark, d, zeros=True), [1, 2, 3], folds=2, rounds=5)
    best = decomposition.chosen_rank(errors)
    return spark.createDataFrame([(r, k, e < 0.005, r == best) for r, k, e in errors], "rank int, fold int, fits boolean, chosen boolean")


def detector_cp(spark, d):
    """Planted faults on days after the ones that a CP detector was fitted on, whose rows are solved from their readings."""
    cells = materialise(_planted(spark, d))
    fitted = tensor.fit_detector(cells.where("t < 20"), rank=2, rounds=6)
    fault = (F.col("machine") == F.col("t") % 7) & (F.col("sensor") == 1)
    late = cells.where("t >= 20").withColumn("value", F.when(fault, 4 * F.col("value")).otherwise(F.col("value")))
    return fitted.flag(late).where("is_anomaly and score > 0.4").select("machine", "t")


def detector(spark, d):
    cells = materialise(_cells(spark, d))
    fitted = tensor.fit_detector(cells.where("t < 20"), decompose=lambda normal: (lambda x, f=tensor.marginal_factors(normal): decomposition.reconstruct(x, f[0].where("mode <> 't'").unionByName(x.select("t").distinct().select(F.lit("t").alias("mode"), F.col("t").alias("idx"), F.array(F.lit(1 / f[1][0] ** 0.5)).alias("vec"))), f[1])))
    return tensor.summary(fitted.flag(cells.where("t >= 20"))).select("machine", "timestep", F.round("score", 6).alias("score"), "is_anomaly")


QUERIES = {f.__name__: f for f in (tensor_score, tensor_error, tensor_flags, tensor_flag_rates, fault_windows, score_matrix, score_matrix_all, tensor_rank2, flag_rate_ratio, score_histogram, tensor_top_flagged, cp_als, rank_choice, detector_cp, detector)}

_BASE = """c as (select user_id % 20 as machine, event_type as sensor, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as t, sum(value) as value from events where value is not null group by 1, 2, 3),
g as (select avg(value) as m from c), a as (select machine, avg(value) as a from c group by 1), b as (select sensor, avg(value) as b from c group by 1), k as (select t, avg(value) as k from c group by 1),
r as (select machine, sensor, t, value, value - a * b * k / (m * m) as e from c join a using (machine) join b using (sensor) join k using (t), g),
s as (select machine, t, sqrt(sum(e * e)) / (sqrt(sum(value * value)) + 1e-8) as score from r group by 1, 2)"""
#: The event types.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
#: Event types and the numbers that stand for them as sensors.
_CODES = "codes as (select * from (values {}) as v(event_type, crc))".format(", ".join(f"('{k}', {zlib.crc32(k.encode()) % 97})" for k in EVENT_TYPES))
_FLAG = _BASE + ", f as (select machine, t, score, score > (select quantile_cont(score, 0.95) from s) as is_anomaly from s)"

_PLANTED = """x as (select m as machine, j as sensor, t, case when m < 10 and j < 2 and t % 2 = 0 then (m + 1) * (j + 2) * (1.0 + t / 10.0) when m >= 10 and j >= 2 and t % 2 = 1 then (20.0 - m) * j * (t % 3 + 1) end as value
from (select distinct day(ts) as t from events), range(20) as r(m), range(5) as s(j))"""

ORACLE_SQL = {
    "cp_als": f"with {_PLANTED} select round(sqrt(sum((value - value) ** 2)) / sqrt(sum(value ** 2)), 2) as relative_error, true as as_fitted from x",
    "rank_choice": "select rank::int as rank, fold::int as fold, rank >= 2 as fits, rank = 2 as chosen from range(1, 4) as r(rank), range(2) as f(fold)",
    "detector_cp": f"with {_PLANTED} select distinct machine, t from x where t >= 20 and machine = t % 7 and value is not null",
    "tensor_score": f"with {_BASE} select machine, t, round(score, 6) as score from s",
    "tensor_error": f"with {_BASE} select round(sqrt(sum(e * e)) / sqrt(sum(value * value)), 6) as relative_error from r",
    "tensor_flags": f"with {_FLAG} select 'machine_' || lpad(cast(machine as varchar), 2, '0') as machine, t as timestep, round(score, 6) as score, is_anomaly from f where is_anomaly",
    "tensor_flag_rates": f"with {_FLAG} select round(avg(cast(is_anomaly as double)), 6) as flag_rate, round(avg(score), 6) as mean_score, round(quantile_cont(score, 0.95), 6) as p95_score, (select machine from f order by score desc, machine, t limit 1) as peak_machine from f",
    "fault_windows": f"with {_FLAG}, w as (select n_nationkey % 20 as machine, n_nationkey as t_start, n_nationkey + 5 as t_end, n_name as type from nation) select cast(w.machine as bigint) as machine, cast(t_start as bigint) as t_start, cast(t_end as bigint) as t_end, type, round(max(score), 6) as max_score, count(*) filter (where is_anomaly) as n_flagged from w left join f on w.machine = f.machine and f.t >= t_start and f.t < t_end group by 1, 2, 3, 4",
    "score_matrix": f"with {_BASE} select machine, " + ", ".join(f"round(max(score) filter (where t = {k}), 6) as t{k}" for k in STEPS) + " from s group by machine",
    "tensor_rank2": f"""with {_CODES}, c as (select user_id % 20 as machine, event_type as sensor, crc as j, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as t, sum(value) as value from events join codes using (event_type) where value is not null group by 1, 2, 3, 4),
r as (select machine, t, value, value - (40.0 * (1.0 + 0.01 * j) + 3.0 * (0.1 * machine) * 0.5 * (1.0 - 0.02 * t)) as e from c)
select machine, t, round(sqrt(sum(e * e)) / (sqrt(sum(value * value)) + 1e-8), 6) as score from r group by 1, 2""",
    "flag_rate_ratio": f"with {_FLAG} select round(avg(cast(is_anomaly as double)) filter (where t < 20), 6) as train_rate, round(avg(score) filter (where t < 20), 6) as train_mean, round(avg(cast(is_anomaly as double)) filter (where t >= 20), 6) as test_rate, round(avg(score) filter (where t >= 20), 6) as test_mean, round(coalesce((avg(score) filter (where t >= 20)) / nullif(avg(score) filter (where t < 20), 0), 0.0), 6) as ratio from f",
    "score_histogram": f"with {_BASE}, h as (select max(score) * 1.05 / 50 as w from s), x as (select case when t < 20 then 'train' else 'test' end as side, least(cast(floor(score / w) as int), 49) as bin, w from s, h), n as (select side, count(*) as total from x group by 1) select side, bin, count(*) as n, round(count(*) / (any_value(total) * any_value(w)), 6) as density from x join n using (side) group by 1, 2",
    "tensor_top_flagged": f"with {_FLAG} select 'machine_' || lpad(cast(machine as varchar), 2, '0') as machine, t as timestep, round(score, 6) as score, is_anomaly from f where is_anomaly order by f.score desc, f.machine, t limit 20",
    "score_matrix_all": f"with {_BASE} select machine, list(t order by t) as steps, list(round(score, 6) order by t) as scores from s group by machine",
    "detector": """with c as (select user_id % 20 as machine, event_type as sensor, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as t, sum(value) as value from events where value is not null group by 1, 2, 3),
o as (select * from c where t < 20), g as (select avg(value) as m from o), a as (select machine, avg(value) as a from o group by 1), b as (select sensor, avg(value) as b from o group by 1),
r as (select machine, t, value, value - a * b / m as e from c join a using (machine) join b using (sensor), g),
s as (select machine, t, sqrt(sum(e * e)) / (sqrt(sum(value * value)) + 1e-8) as score from r group by 1, 2)
select 'machine_' || lpad(cast(machine as varchar), 2, '0') as machine, t as timestep, round(score, 6) as score, score > (select quantile_cont(score, 0.95) from s where t < 20) as is_anomaly from s where t >= 20""",
}
