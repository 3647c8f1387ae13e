"""Time-series and categorical features."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.columns import drop_missing, running_sums, turn

#: Holidays as (month, day), ordinal codes, and the model's features in order.
HOLIDAYS = ((1, 1), (1, 18), (7, 4), (11, 11), (11, 27), (12, 24), (12, 25))
STORE_SIZES = {"small": 0, "medium": 1, "large": 2}
CATEGORIES = {"A": 0, "B": 1, "C": 2}
FEATURES = (
    "price", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos", "is_weekend", "is_holiday",
    "lag_1_demand", "lag_7_demand", "lag_14_demand", "rolling_7_mean", "rolling_14_mean",
    "store_size_encoded", "product_category_encoded",
)


def date_range(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both included."""
    return df.where(F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


#: Rows of a series up to which one task may hold it.
SERIES_ROWS = 1 << 16


def lags(df: DataFrame, keys: list[str], order: str, value: str = "demand", steps: tuple[int, ...] = (1, 7, 14), windows: tuple[int, ...] = (7, 14), keep: bool = True, series_rows: int = SERIES_ROWS) -> DataFrame:
    """``lag_<k>_<value>`` and ``rolling_<w>_mean`` of each series, by rows.

    A mean needs all its ``w`` earlier rows. With ``keep``, columns that exist already stay. Where a series has more than
    ``series_rows`` rows, which are counted, it is cut into stretches of so many, each of which gets the last rows of the one
    before as its halo, so that no task holds a series; the result is the same. Shorter series take one shuffle by their keys.
    """
    halo = max((*steps, *windows), default=0)
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= max(series_rows, halo):
        return _lagged(df, keys, order, value, steps, windows, keep)
    size = max(series_rows, halo)
    placed = running_sums(df.withColumn("_one", F.lit(1)), keys, order, ["_one"]).withColumn("_at", F.col("cum__one") - 1).drop("_one", "cum__one")
    stretch, place = F.expr(f"_at div {size}"), F.col("_at") % size
    both = placed.withColumn("_own", stretch).withColumn("_stretch", F.explode(F.when(place >= size - halo, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))
    found = _lagged(both, [*keys, "_stretch"], "_at", value, steps, windows, keep)
    return found.where("_stretch = _own").drop("_at", "_own", "_stretch")


def _lagged(df: DataFrame, keys: list[str], order: str, value: str, steps: tuple[int, ...], windows: tuple[int, ...], keep: bool) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    new: dict[str, Column] = {f"lag_{k}_{value}": F.lag(value, k).over(w) for k in steps}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        new[f"rolling_{n}_mean"] = F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))
    return df.withColumns({k: c for k, c in new.items() if not keep or k not in df.columns})


def calendar(df: DataFrame, date: str) -> DataFrame:
    """day_of_week (Monday 0), month, is_weekend, is_holiday."""
    day = F.weekday(date)
    holiday = F.struct(F.month(date).alias("m"), F.dayofmonth(date).alias("d")).isin(*(F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in HOLIDAYS))
    return df.withColumns({"day_of_week": day, "month": F.month(date), "is_weekend": (day >= 5).cast("int"), "is_holiday": holiday.cast("int")})


def cyclical(df: DataFrame) -> DataFrame:
    """Sine and cosine of day_of_week over 7 and of month - 1 over 12, for those that exist."""
    new: dict[str, Column] = {}
    if "day_of_week" in df.columns:
        new["day_of_week_sin"], new["day_of_week_cos"] = turn(F.col("day_of_week"), 7)
    if "month" in df.columns:
        new["month_sin"], new["month_cos"] = turn(F.col("month") - 1, 12)
    return df.withColumns(new) if new else df


def ordinal(column: Column, codes: dict[str, int]) -> Column:
    """The code of a category, 0 if it has none."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(0))


def encode_categories(df: DataFrame) -> DataFrame:
    known = {"store_size": ("store_size_encoded", STORE_SIZES), "product_category": ("product_category_encoded", CATEGORIES)}
    return df.withColumns({new: ordinal(F.col(c), codes) for c, (new, codes) in known.items() if c in df.columns} or {})


def binned(column: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the right-closed bin (edges[k], edges[k + 1]]; NULL outside."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True):
        out = out.when((column > lo) & (column <= hi), label)
    return out


def label_codes(df: DataFrame, column: str, to: str) -> DataFrame:
    """``to``: the place of a string among the sorted distinct ones, from 0."""
    names = df.select(column).where(F.col(column).isNotNull()).distinct()
    places = running_sums(names.withColumns({"_g": F.lit(0), "_one": F.lit(1)}), ["_g"], column, ["_one"])
    return df.join(places.select(column, (F.col("cum__one") - 1).cast("int").alias(to)), column, "left")


def prepare(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Lags, cyclical and ordinal features, without the rows that miss any feature."""
    ready = df.transform(lags, keys, date).transform(cyclical).transform(encode_categories)
    return drop_missing(ready, [c for c in FEATURES if c in ready.columns])


def feature_columns(df: DataFrame, *more: str) -> DataFrame:
    """The model's features that exist, in canonical order, and ``more``."""
    return df.select(*(c for c in (*FEATURES, *more) if c in df.columns))


def serving_rows(requests: DataFrame) -> DataFrame:
    """Model features of prediction requests: calendar from the date, short lags in place of long ones, 0 for what is absent."""
    r = requests.withColumns({"day_of_week": F.weekday("date"), "month": F.month("date")}).transform(cyclical)
    has = lambda c: F.col(c) if c in requests.columns else F.lit(None).cast("double")
    r = r.withColumns({
        "lag_14_demand": F.coalesce(has("lag_14_demand"), has("lag_7_demand")),
        "rolling_14_mean": F.coalesce(has("rolling_14_mean"), has("rolling_7_mean")),
        "store_size_encoded": F.pmod("store_id", F.lit(3)),
        "product_category_encoded": F.pmod("product_id", F.lit(3)),
    })
    return r.select("store_id", "product_id", "date", *(F.coalesce(F.col(c).cast("double") if c in r.columns else F.lit(None).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES))


def clamped(prediction: Column) -> Column:
    return F.greatest(F.lit(0.0), F.bround(prediction, 2))


def in_order(df: DataFrame, by: str = "series") -> DataFrame:
    """Rows by (store, product, date), or with ``by`` of "date" by (date, store, product)."""
    keys = ["store_id", "product_id", "date"] if by == "series" else ["date", "store_id", "product_id"]
    return df.orderBy(*keys)


def numbered(df: DataFrame, by: str = "series", to: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in the order of ``in_order``: running counts over ranges, so that no task sorts all rows."""
    keys = ["store_id", "product_id", "date"] if by == "series" else ["date", "store_id", "product_id"]
    placed = running_sums(df.withColumns({"_order": F.struct(*keys), "_one": F.lit(1)}), [], "_order", ["_one"])
    return placed.withColumn(to, F.col("cum__one")).drop("_order", "_one", "cum__one")


class FeaturePipeline(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Lags, cyclical and ordinal features as a transformer that is saved with a model; ``fit`` learns nothing and returns the pipeline itself."""

    keys = Param(Params._dummy(), "keys", "columns that tell series apart", TypeConverters.toListString)
    date = Param(Params._dummy(), "date", "column that orders a series", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, keys: list[str] | None = None, date: str = "date"):
        super().__init__()
        self._setDefault(keys=[], date="date")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def fit(self, df: DataFrame) -> FeaturePipeline:
        return self

    def _transform(self, df: DataFrame) -> DataFrame:
        return prepare(df, self.getOrDefault(self.keys), self.getOrDefault(self.date))


class ServingFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``serving_rows`` as a transformer, so that one saved model takes raw requests."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return serving_rows(df)
