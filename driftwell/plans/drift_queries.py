"""Queries on features and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.columns import long_values
from driftwell.operators import drift, features, metrics
from driftwell.operators.summaries import ReferenceSummary
from driftwell.sources.shared import materialise, shared_path
from driftwell.sources.tables import Snapshots, read
from driftwell.streaming import monitor

COLUMNS = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
CUT = "1999-01-01"


def _halves(spark: SparkSession, d: str, shifted: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "lineitem").select("l_shipdate", *COLUMNS)
    current = rows.where(F.col("l_shipdate") >= F.to_timestamp(F.lit(CUT)))
    if shifted:
        current = drift.what_if(current, "l_shipdate", "2000-01-01", price="l_extendedprice")
    return rows.where(F.col("l_shipdate") < F.to_timestamp(F.lit(CUT))), current


def drift_psi(spark, d):
    return drift.psi(drift.sides(*_halves(spark, d, True), COLUMNS)).select("feature", F.round("psi", 6).alias("psi"))


def drift_ks(spark, d):
    return drift.ks(drift.sides(*_halves(spark, d, True), COLUMNS)).select("feature", "n_ref", "n_cur", F.round("ks", 6).alias("ks"), F.round("p", 6).alias("p"))


def feature_drift(spark, d):
    return drift.feature_drift(*_halves(spark, d, True), COLUMNS)


def drift_report(spark, d):
    return drift.report(*_halves(spark, d, True), COLUMNS).select(
        "n_reference_samples", "n_current_samples", F.size("feature_drift").cast("long").alias("n_rows"), "overall_drift_detected", "retraining_recommended", "summary"
    )


def drift_report_label(spark, d):
    """The report with a label: its KS row, and what it says of retraining."""
    r = drift.report(*_halves(spark, d, True), COLUMNS[:1] + COLUMNS[2:], "l_extendedprice")
    return r.select("n_reference_samples", "n_current_samples", F.size("feature_drift").cast("long").alias("n_rows"), F.col("label_drift.statistic").alias("label_ks"), F.col("label_drift.mean_shift_pct").alias("label_shift"), "overall_drift_detected", "retraining_recommended", "summary")


def top_psi(spark, d):
    """The three features of highest PSI."""
    return drift.top_drift(drift.feature_drift(*_halves(spark, d, True), COLUMNS), 3).select("feature", "statistic", "severity")


def label_drift(spark, d):
    rows = read(spark, d, "orders").select("o_orderdate", "o_totalprice")
    cut = F.to_timestamp(F.lit("1998-06-01"))
    return drift.label_drift(rows.where(F.col("o_orderdate") < cut), rows.where(F.col("o_orderdate") >= cut), "o_totalprice")


def column_stats(spark, d):
    s = drift.column_stats(read(spark, d, "lineitem"), COLUMNS)
    return s.select("feature", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75")))


def paired_histogram(spark, d):
    a, b = _halves(spark, d)
    h = drift.paired_histogram(drift.sides(a, b, ["l_extendedprice", "l_quantity"]))
    return h.select("feature", "side", "bin", "n", F.round("density", 8).alias("density"))


def whatif_shift(spark, d):
    rows = drift.what_if(read(spark, d, "lineitem"), "l_shipdate", "1998-01-01", "l_extendedprice", "l_quantity")
    out = metrics.before_after(rows, "l_shipdate", "1998-01-01", ["l_extendedprice", "l_quantity"])
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


def _daily(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("date")).agg(F.sum("value").alias("demand"))


def lag_rolling(spark, d):
    out = features.lags(_daily(spark, d), ["event_type"], "date")
    return out.select("event_type", "date", *(F.round(c, 4).alias(c) for c in ("demand", "lag_1_demand", "lag_7_demand", "lag_14_demand", "rolling_7_mean", "rolling_14_mean")))


def calendar_cyclical(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    out = features.cyclical(features.calendar(o, "date"))
    cyc = ("day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos")
    return out.select("o_orderkey", "day_of_week", "month", "is_weekend", "is_holiday", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in cyc))


PRIORITIES = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2}


def ordinal_encode(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy(features.ordinal(F.col("o_orderpriority"), PRIORITIES).alias("code")).agg(F.count("*").alias("n"))


def age_bins(spark, d):
    p = read(spark, d, "part")
    return p.groupBy(features.binned(F.col("p_size"), [0, 10, 20, 35, 50], ["tiny", "small", "medium", "large"]).alias("size_group")).agg(F.count("*").alias("n"))


def label_codes(spark, d):
    c = features.label_codes(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code")
    return c.groupBy("c_mktsegment", "code").agg(F.count("*").alias("n"))


def date_split(spark, d):
    o = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice")
    a, b = features.date_range(o, "date", "1995-01-01", "1997-12-31"), features.date_range(o, "date", "1998-01-01", "1998-12-31")
    part = lambda df, name: df.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")).select(F.lit(name).alias("part"), "n", "mean")
    return part(a, "train").unionByName(part(b, "validation"))


def serving_rows(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("store_id"), F.col("o_orderkey").alias("product_id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), (F.col("o_totalprice") / 2).alias("lag_7_demand"))
    return features.serving_rows(o).select("product_id", F.round("price", 4).alias("price"), F.round("lag_14_demand", 4).alias("lag_14_demand"), "lag_1_demand", "store_size_encoded", (F.round("month_cos", 6) + F.lit(0.0)).alias("month_cos"))


def _series(spark, d):
    e = read(spark, d, "events").where("value is not null")
    s = e.groupBy(F.col("event_type").alias("store_id"), (F.col("user_id") % 4).alias("product_id"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("demand"), F.avg("value").alias("price"))
    return s.withColumns({"store_size": F.when(F.col("product_id") == 1, "medium").when(F.col("product_id") == 2, "large").otherwise("kiosk"), "product_category": F.when(F.col("product_id") == 3, "C").otherwise("A")})


def prepared_features(spark, d):
    """The model's features of daily series in canonical order, rows that miss one left out."""
    series = features.calendar(_series(spark, d), "date")
    ready = features.FeaturePipeline(keys=["store_id", "product_id"]).fit(series).transform(series)
    out = features.feature_columns(ready, "store_id", "product_id", "date")
    return out.select("store_id", "product_id", "date", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in features.FEATURES))


def ordered_series(spark, d):
    """All rows with their places in the order of series and in that of dates."""
    rows = materialise(_series(spark, d).select("store_id", "product_id", "date"))
    placed = lambda by: features.numbered(rows, by).withColumn("by", F.lit(by))
    return placed("series").unionByName(placed("date"))


def snapshot_round_trip(spark, d):
    store = Snapshots(spark, shared_path(spark, "snapshots"))
    store.save("daily", _daily(spark, d))
    first = store.load("daily")
    store.save("daily", _daily(spark, d).where(F.dayofmonth("date") > 15))
    # The first version is read after the second was saved.
    sums = lambda df, version: df.groupBy("event_type").agg(F.count("*").alias("days"), F.round(F.sum("demand"), 4).alias("demand")).withColumn("version", F.lit(version))
    return sums(first, 1).unionByName(sums(store.load("daily"), 2))


def _replayed(spark, d, start, max_files):
    root = shared_path(spark, "stream")
    events = read(spark, d, "events").select("ts", "value")
    events.where(F.dayofmonth("ts") >= 16).write.mode("overwrite").json(f"{root}/in")
    edges, counts = monitor.reference_counts(events.where(F.dayofmonth("ts") < 16), ["value"])
    stream = monitor.observations(spark, f"{root}/in", "ts timestamp, value double", max_files)
    start(stream, edges, ["value"], f"{root}/out", f"{root}/checkpoint").awaitTermination()
    windows = spark.read.schema("window_start timestamp, feature string, bin int, n_cur long").parquet(f"{root}/out")
    return monitor.window_psi(windows, counts)


def stream_window_psi(spark, d):
    """Observations read as a stream of JSON files, counted in daily windows, and compared with the first half of the month.

    All files are one batch, so that the watermark drops no row; windows that it hasn't passed are left out.
    """
    return _replayed(spark, d, monitor.start_windows, None)


def stream_window_psi_all(spark, d):
    """The same of all windows, the last ones too."""
    return _replayed(spark, d, monitor.start_all_windows, 100)


def stream_reports(spark, d):
    """Drift rows of micro-batches of five days each against the stored summary of the first half of the month."""
    root = shared_path(spark, "reports")
    events = read(spark, d, "events").select("ts", "value", F.col("user_id").cast("double").alias("user"))
    summary = ReferenceSummary.build(events.where(F.dayofmonth("ts") < 16), ["value", "user"], f"{root}/summary")
    late = events.where(F.dayofmonth("ts") >= 16).withColumn("part", F.floor((F.dayofmonth("ts") - 16) / 5).cast("int"))
    # One file for each five days, and one file for each batch.
    late.repartition("part").write.mode("overwrite").partitionBy("part").json(f"{root}/in")
    stream = monitor.observations(spark, f"{root}/in", "ts timestamp, value double, user double, part int", 1)
    monitor.start_reports(stream, summary, f"{root}/out", f"{root}/checkpoint", part=F.min("part")).awaitTermination()
    return spark.read.parquet(f"{root}/out/rows").select("part", "feature", "method", "statistic", "p_value", "is_drift", "severity", "reference_mean", "current_mean", "mean_shift_pct")


QUERIES = {f.__name__: f for f in (drift_psi, drift_ks, feature_drift, drift_report, drift_report_label, top_psi, prepared_features, ordered_series, label_drift, column_stats, paired_histogram, whatif_shift, lag_rolling, calendar_cyclical, ordinal_encode, age_bins, label_codes, date_split, serving_rows, snapshot_round_trip, stream_window_psi, stream_window_psi_all, stream_reports)}


def _long(columns: list[str]) -> str:
    shifted = "case when l_shipdate >= timestamp '2000-01-01' then l_extendedprice * 1.30 + 2.0 else l_extendedprice end"
    parts = [
        f"select case when l_shipdate < timestamp '{CUT}' then 'reference' else 'current' end as side, '{c}' as feature, "
        f"cast({shifted if c == 'l_extendedprice' else c} as double) as value from lineitem"
        for c in columns
    ]
    return " union all ".join(parts)


def _psi(long: str) -> str:
    tenths = ", ".join(f"{k / 10}" for k in range(11))
    return f"""v as ({long}),
e as (select feature, list_sort(list_distinct(quantile_cont(value, [{tenths}]))) as edges from v where side = 'reference' group by feature),
b as (select feature, side, least(len(list_filter(edges, lambda x: x <= greatest(value, edges[1]))), len(edges) - 1) as bin from v join e using (feature) where len(edges) >= 2),
c as (select feature, bin, count(*) filter (where side = 'reference') as r, count(*) filter (where side = 'current') as c from b group by feature, bin),
t as (select feature, r, c, sum(r) over (partition by feature) as tr, sum(c) over (partition by feature) as tc from c),
psi as (select feature, sum((a - x) * ln(a / x)) as psi from (select feature, case when r > 0 then r / tr else 1e-6 end as x, case when c > 0 then c / tc else 1e-6 end as a from t) group by feature)"""


def _ks(long: str, prefix: str = "") -> str:
    return f"""kv as ({long}),
kt as (select feature, value, count(*) filter (where side = 'reference') as r, count(*) filter (where side = 'current') as c from kv group by feature, value),
kn as (select feature, sum(r) as n, sum(c) as m from kt group by feature),
kc as (select feature, abs(sum(r) over w / n - sum(c) over w / m) as gap from kt join kn using (feature) window w as (partition by feature order by value rows unbounded preceding)),
kd as (select feature, n, m, max(gap) as ks from kc join kn using (feature) group by feature, n, m),
kx as (select *, ks * sqrt(n * m / (n + m)) as x from kd),
ks as (select feature, n, m, ks, case when x < 0.2 then 1.0 else least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 2.0 else -2.0 end) * exp(-2.0 * k * k * x * x))))) end as p from kx)"""


_MEANS = "ms as (select feature, avg(value) filter (where side = 'reference') as a, avg(value) filter (where side = 'current') as b from {v} group by feature)"
_SHIFT = "round(a, 4) as reference_mean, round(b, 4) as current_mean, round((b - a) / (case when abs(a) > 1e-9 then abs(a) else 1.0 end) * 100, 2) as mean_shift_pct"
_ROWS = f"""rows as (
select feature, 'PSI' as method, round(psi, 6) as statistic, cast(null as double) as p_value, psi >= 0.10 as is_drift, case when psi >= 0.20 then 'critical' when psi >= 0.10 then 'warning' else 'none' end as severity, {_SHIFT} from psi join ms using (feature)
union all select feature, 'KS', round(ks, 6), round(p, 6), p < 0.05, case when p < 0.05 then 'critical' else 'none' end, {_SHIFT} from ks join ms using (feature))"""
_ORDERS = "select case when o_orderdate < timestamp '1998-06-01' then 'reference' else 'current' end as side, 'o_totalprice' as feature, o_totalprice as value from orders"
_PART = "cast(floor((day(ts) - 16) / 5) as int)"
_BATCHES = " union all ".join(
    f"select 'reference' as side, p || '|{f}' as feature, {c}::double as value from events, (select distinct {_PART} as p from events where day(ts) >= 16) where day(ts) < 16 and {c} is not null "
    f"union all select 'current', {_PART} || '|{f}', {c}::double from events where day(ts) >= 16 and {c} is not null" for f, c in (("value", "value"), ("user", "user_id")))
_SERIES = "select event_type as store_id, user_id % 4 as product_id, cast(ts as date) as date, sum(value) as demand, avg(value) as price from events where value is not null group by 1, 2, 3"
_DAILY = "select event_type, cast(ts as date) as date, sum(value) as demand from events group by 1, 2"


def _hist() -> str:
    long = " union all ".join(f"select case when l_shipdate < timestamp '{CUT}' then 'reference' else 'current' end as side, '{c}' as feature, {c} as value from lineitem" for c in ("l_extendedprice", "l_quantity"))
    return f"""with v as ({long}), s as (select feature, min(value) as lo, (max(value) - min(value)) / 30 as w from v group by 1), n as (select feature, side, count(*) as total from v group by 1, 2)
select feature, side, cast(least(floor((value - lo) / w), 29) as int) as bin, count(*) as n, round(count(*) / (any_value(total) * any_value(w)), 8) as density from v join s using (feature) join n using (feature, side) group by 1, 2, 3"""


def _whatif() -> str:
    cols = {"l_extendedprice": "case when l_shipdate >= timestamp '1998-01-01' then l_extendedprice * 1.30 + 2.0 else l_extendedprice end", "l_quantity": "case when l_shipdate >= timestamp '1998-01-01' then l_quantity * 0.60 else l_quantity end"}
    inner = ", ".join(f"{e} as {c}" for c, e in cols.items())
    outs = ", ".join(f"round(min({c}), 4) as {c}_min, round(max({c}), 4) as {c}_max, round(avg({c}) filter (where not late), 4) as {c}_before, round(avg({c}) filter (where late), 4) as {c}_after" for c in cols)
    return f"select {outs} from (select l_shipdate >= timestamp '1998-01-01' as late, {inner} from lineitem)"


_STREAM = """with e as (select list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as edges from events where day(ts) < 16),
x as (select ts, least(len(list_filter(edges, lambda v: v <= greatest(value, edges[1]))), len(edges) - 1) - 1 as bin from events, e where value is not null),
r as (select bin, count(*) as n from x where day(ts) < 16 group by bin), c as (select date_trunc('day', ts) as w, bin, count(*) as n from x where day(ts) >= 16 group by 1, 2),
f as (select w, bin, r.n as rn, coalesce(c.n, 0) as cn from (select distinct w from c) cross join r left join c using (w, bin)),
g as (select w, rn / sum(rn) over (partition by w) as x, case when cn > 0 then cn / sum(cn) over (partition by w) else 1e-6 end as a from f),
p as (select w, sum((a - x) * ln(a / x)) as psi from g group by w)
select w as window_start, 'value' as feature, round(psi, 6) as psi, case when psi >= 0.20 then 'critical' when psi >= 0.10 then 'warning' else 'none' end as severity from p where w + interval 1 day <= (select max(ts) from events) - interval 1 day"""

ORACLE_SQL = {
    "drift_psi": f"with {_psi(_long(COLUMNS))} select feature, round(psi, 6) as psi from psi",
    "drift_ks": f"with {_ks(_long(COLUMNS))} select feature, cast(n as bigint) as n_ref, cast(m as bigint) as n_cur, round(ks, 6) as ks, round(p, 6) as p from ks",
    "feature_drift": f"with {_psi(_long(COLUMNS))}, {_ks(_long(COLUMNS))}, {_MEANS.format(v='v')}, {_ROWS} select * from rows",
    "drift_report": f"""with {_psi(_long(COLUMNS))}, {_ks(_long(COLUMNS))}, {_MEANS.format(v='v')}, {_ROWS},
a as (select count(*) as n, bool_or(is_drift) as d, coalesce(bool_or(method = 'PSI' and severity = 'critical'), false) as r,
 string_agg(case when method = 'PSI' and severity = 'critical' then feature end, ', ' order by feature) as c, string_agg(case when method = 'PSI' and severity = 'warning' then feature end, ', ' order by feature) as w from rows)
select (select count(*) from lineitem where l_shipdate < timestamp '{CUT}') as n_reference_samples, (select count(*) from lineitem where l_shipdate >= timestamp '{CUT}') as n_current_samples, n as n_rows, d as overall_drift_detected, r as retraining_recommended,
case when not d then 'No significant drift detected. Model distributions appear stable.' else concat_ws(' ', 'CRITICAL drift (PSI >= 0.20) in: ' || c || '.', 'WARNING drift (0.10 <= PSI < 0.20) in: ' || w || '.', case when r then 'Retraining is recommended.' end) end as summary from a""",
    "drift_report_label": f"""with {_psi(_long(COLUMNS[:1] + COLUMNS[2:]))}, {_ks(_long(COLUMNS))}, {_MEANS.format(v='kv')}, {_ROWS},
l as (select * from rows where feature = 'l_extendedprice' and method = 'KS'), o as (select * from rows where feature <> 'l_extendedprice'),
a as (select count(*) as n, bool_or(is_drift) as d, coalesce(bool_or(method = 'PSI' and severity = 'critical'), false) as r, string_agg(case when method = 'PSI' and severity = 'critical' then feature end, ', ' order by feature) as c, string_agg(case when method = 'PSI' and severity = 'warning' then feature end, ', ' order by feature) as w from o)
select (select count(*) from lineitem where l_shipdate < timestamp '{CUT}') as n_reference_samples, (select count(*) from lineitem where l_shipdate >= timestamp '{CUT}') as n_current_samples, n as n_rows, l.statistic as label_ks, l.mean_shift_pct as label_shift, d or l.is_drift as overall_drift_detected, r or l.is_drift as retraining_recommended,
case when not (d or l.is_drift) then 'No significant drift detected. Model distributions appear stable.' else concat_ws(' ', 'CRITICAL drift (PSI >= 0.20) in: ' || c || '.', 'WARNING drift (0.10 <= PSI < 0.20) in: ' || w || '.', case when l.is_drift then printf('Label drift detected (KS p=%.4f); mean shifted %+.1f%%.', l.p_value, l.mean_shift_pct) end, case when r or l.is_drift then 'Retraining is recommended.' end) end as summary from a, l""",
    "top_psi": f"with {_psi(_long(COLUMNS))} select feature, round(psi, 6) as statistic, case when psi >= 0.20 then 'critical' when psi >= 0.10 then 'warning' else 'none' end as severity from psi order by round(psi.psi, 6) desc, feature limit 3",
    "prepared_features": f"""with s as ({_SERIES}), l as (select *, lag(demand, 1) over w as l1, lag(demand, 7) over w as l7, lag(demand, 14) over w as l14, case when count(demand) over w7 = 7 then avg(demand) over w7 end as r7, case when count(demand) over w14 = 14 then avg(demand) over w14 end as r14 from s
window w as (partition by store_id, product_id order by date), w7 as (partition by store_id, product_id order by date rows between 7 preceding and 1 preceding), w14 as (partition by store_id, product_id order by date rows between 14 preceding and 1 preceding))
select store_id, product_id, date, round(price, 4) as price, round(sin((isodow(date) - 1) * (2 * pi() / 7)), 4) + 0.0 as day_of_week_sin, round(cos((isodow(date) - 1) * (2 * pi() / 7)), 4) + 0.0 as day_of_week_cos, round(sin((month(date) - 1) * (2 * pi() / 12)), 4) + 0.0 as month_sin, round(cos((month(date) - 1) * (2 * pi() / 12)), 4) + 0.0 as month_cos,
cast(isodow(date) >= 6 as double) as is_weekend, cast((month(date), day(date)) in ((1, 1), (1, 18), (7, 4), (11, 11), (11, 27), (12, 24), (12, 25)) as double) as is_holiday, round(l1, 4) as lag_1_demand, round(l7, 4) as lag_7_demand, round(l14, 4) as lag_14_demand, round(r7, 4) as rolling_7_mean, round(r14, 4) as rolling_14_mean,
case product_id when 1 then 1.0::double when 2 then 2.0 else 0.0 end as store_size_encoded, case product_id when 3 then 2.0::double else 0.0 end as product_category_encoded from l where l14 is not null and l7 is not null and l1 is not null and r7 is not null and r14 is not null and price is not null""",
    "ordered_series": f"with s as ({_SERIES}) select store_id, product_id, date, 'series' as by, row_number() over (order by store_id, product_id, date) as place from s union all select store_id, product_id, date, 'date', row_number() over (order by date, store_id, product_id) from s",
    "label_drift": f"with {_ks(_ORDERS)}, {_MEANS.format(v='kv')} select feature, 'KS' as method, round(ks, 6) as statistic, round(p, 6) as p_value, p < 0.05 as is_drift, case when p < 0.05 then 'critical' else 'none' end as severity, {_SHIFT} from ks join ms using (feature)",
    "column_stats": " union all ".join(f"select '{c}' as feature, count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75 from lineitem" for c in COLUMNS),
    "paired_histogram": _hist(),
    "whatif_shift": _whatif(),
    "lag_rolling": f"""with d as ({_DAILY}) select event_type, date, round(demand, 4) as demand, round(lag(demand, 1) over w, 4) as lag_1_demand, round(lag(demand, 7) over w, 4) as lag_7_demand, round(lag(demand, 14) over w, 4) as lag_14_demand,
case when count(demand) over w7 = 7 then round(avg(demand) over w7, 4) end as rolling_7_mean, case when count(demand) over w14 = 14 then round(avg(demand) over w14, 4) end as rolling_14_mean from d
window w as (partition by event_type order by date), w7 as (partition by event_type order by date rows between 7 preceding and 1 preceding), w14 as (partition by event_type order by date rows between 14 preceding and 1 preceding)""",
    "calendar_cyclical": """select o_orderkey, cast(isodow(o_orderdate) - 1 as int) as day_of_week, cast(month(o_orderdate) as int) as month, cast(isodow(o_orderdate) >= 6 as int) as is_weekend,
cast((month(o_orderdate), day(o_orderdate)) in ((1, 1), (1, 18), (7, 4), (11, 11), (11, 27), (12, 24), (12, 25)) as int) as is_holiday,
round(sin((isodow(o_orderdate) - 1) * (2 * pi() / 7)), 6) + 0.0 as day_of_week_sin, round(cos((isodow(o_orderdate) - 1) * (2 * pi() / 7)), 6) + 0.0 as day_of_week_cos,
round(sin((month(o_orderdate) - 1) * (2 * pi() / 12)), 6) + 0.0 as month_sin, round(cos((month(o_orderdate) - 1) * (2 * pi() / 12)), 6) + 0.0 as month_cos from orders""",
    "ordinal_encode": "select case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 when '3-MEDIUM' then 2 else 0 end as code, count(*) as n from orders group by 1",
    "age_bins": "select case when p_size > 0 and p_size <= 10 then 'tiny' when p_size > 10 and p_size <= 20 then 'small' when p_size > 20 and p_size <= 35 then 'medium' when p_size > 35 and p_size <= 50 then 'large' end as size_group, count(*) as n from part group by 1",
    "label_codes": "with n as (select c_mktsegment, row_number() over (order by c_mktsegment) - 1 as code from (select distinct c_mktsegment from customer where c_mktsegment is not null)) select c_mktsegment, cast(code as int) as code, count(*) as n from customer left join n using (c_mktsegment) group by 1, 2",
    "date_split": "select 'train' as part, count(*) as n, round(avg(o_totalprice), 4) as mean from orders where cast(o_orderdate as date) between date '1995-01-01' and date '1997-12-31' union all select 'validation', count(*), round(avg(o_totalprice), 4) from orders where cast(o_orderdate as date) between date '1998-01-01' and date '1998-12-31'",
    "serving_rows": "select o_orderkey as product_id, round(o_totalprice, 4) as price, round(o_totalprice / 2, 4) as lag_14_demand, 0.0::double as lag_1_demand, cast(o_custkey % 3 as double) as store_size_encoded, round(cos((month(o_orderdate) - 1) * (2 * pi() / 12)), 6) + 0.0 as month_cos from orders",
    "snapshot_round_trip": f"select event_type, count(*) as days, round(sum(demand), 4) as demand, 1 as version from ({_DAILY}) group by 1 union all select event_type, count(*), round(sum(demand), 4), 2 from ({_DAILY}) where day(date) > 15 group by 1",
    "stream_reports": f"with {_psi(_BATCHES)}, {_ks(_BATCHES)}, {_MEANS.format(v='v')}, {_ROWS} select cast(split_part(feature, '|', 1) as int) as part, split_part(feature, '|', 2) as feature, * exclude (feature) from rows",
    "stream_window_psi": _STREAM,
    "stream_window_psi_all": _STREAM.rsplit(" where ", 1)[0],
}
