"""Analysis of count-indexed series: rows (series_id, idx, value), idx from 0 without gaps."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import STYLE

S = "series_id"


def to_series(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Number the rows of each key in order; null values are no points."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(value).isNotNull()).select(F.col(key).alias(S), (F.row_number().over(w) - 1).alias("idx"), F.col(value).cast("double").alias("value"))


def smooth(series: DataFrame, width: int = 3) -> DataFrame:
    """Centred moving average of ``width // 2`` points each way, fewer at the ends."""
    if width <= 1:
        return series
    h = width // 2
    return series.withColumn("value", F.avg("value").over(Window.partitionBy(S).orderBy("idx").rowsBetween(-h, h)))


def rolling(series: DataFrame) -> DataFrame:
    """Adds ``width`` = min(5, n // 4) and ``moving_avg`` and ``moving_std`` (sample) of the centred
    window, null unless it is full; for widths under 2 the value itself and 0."""
    whole, order = Window.partitionBy(S), Window.partitionBy(S).orderBy("idx")
    out = series.withColumn("width", F.least(F.lit(5), F.floor(F.count("*").over(whole) / 4)).cast("int"))
    mean, dev = F.when(F.col("width") <= 1, F.col("value")), F.when(F.col("width") <= 1, F.lit(0.0))
    for w in range(2, 6):
        frame = order.rowsBetween(-(w // 2), (w - 1) // 2)
        full = (F.col("width") == w) & (F.count("*").over(frame) == w)
        mean, dev = mean.when(full, F.avg("value").over(frame)), dev.when(full, F.stddev_samp("value").over(frame))
    return out.withColumns({"moving_avg": mean, "moving_std": dev})


def stats(series: DataFrame) -> DataFrame:
    """Mean, median, population deviation, extremes, range, variation (0 for mean 0), count."""
    mean, std = F.avg("value"), F.stddev_pop("value")
    return series.groupBy(S).agg(mean.alias("mean"), F.median("value").alias("median"), std.alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
                                 (F.max("value") - F.min("value")).alias("range"), F.when(mean != 0, std / mean).otherwise(F.lit(0.0)).alias("cv"), F.count("*").alias("num_blocks"))


def trend(series: DataFrame) -> DataFrame:
    """Least-squares slope and absolute correlation with the index; only of two points and more. A
    constant series has correlation 0."""
    x = F.col("idx").cast("double")
    slope = F.try_divide(F.covar_pop("value", x), F.var_pop(x))
    r = F.abs(F.try_divide(F.covar_pop("value", x), F.stddev_pop("value") * F.stddev_pop(x)))
    out = series.groupBy(S).agg(slope.alias("slope"), F.coalesce(r, F.lit(0.0)).alias("strength"), F.count("*").alias("n"))
    return out.where("n >= 2")


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))
    swap = x >= (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    c, d = 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    area = front * f / a
    return 1 - area if swap else area


def trend_p(series: DataFrame) -> DataFrame:
    """``trend`` with the slope's two-sided p-value (1 for two points)."""
    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        out = [1.0 if k <= 2 else student_p(v * math.sqrt((k - 2) / max(1 - v * v, 1e-300)), k - 2) if v is not None and not math.isnan(v) else math.nan for v, k in zip(r, n)]
        return pd.Series(out)

    return trend(series).withColumn("p_value", p("strength", "n"))


def turning(series: DataFrame) -> DataFrame:
    """Sign changes of neighbouring differences, and the mean absolute difference (0 for one point)."""
    w = Window.partitionBy(S).orderBy("idx")
    d = series.withColumn("d", F.col("value") - F.lag("value").over(w)).withColumn("e", F.lag("d").over(w))
    return d.groupBy(S).agg(F.count_if(F.col("d") * F.col("e") < 0).alias("turning_points"), F.coalesce(F.avg(F.abs("d")), F.lit(0.0)).alias("volatility"))


def _list(mask: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(mask, F.col("idx")))), lambda i: i.cast("string")), ",")


def zscore_anomalies(series: DataFrame, limit: float = 2.0) -> DataFrame:
    """Indices further from the mean than ``limit`` population deviations; none of under 3 points."""
    facts = series.groupBy(S).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n"))
    far = (F.col("n") >= 3) & (F.col("s") > 0) & (F.abs(F.col("value") - F.col("m")) / F.col("s") > limit)
    return series.join(facts, S).groupBy(S).agg(_list(far).alias("anomalies"), F.count_if(far).alias("anomaly_count"))


def iqr_anomalies(series: DataFrame) -> DataFrame:
    """Indices outside the quartiles by more than 1.5 ranges between them; series of 3 points and more."""
    q = series.groupBy(S).agg(F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"), F.count("*").alias("n")).where("n >= 3")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    out = (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
    return series.join(q, S).groupBy(S).agg(_list(out).alias("iqr_anomalies"), F.count_if(out).alias("iqr_anomaly_count"))


def box(series: DataFrame) -> DataFrame:
    """Quartiles and whiskers: the extreme points within 1.5 quartile ranges."""
    q = series.groupBy(S).agg(*[F.percentile("value", F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return series.join(q, S).groupBy(S, "q1", "med", "q3").agg(F.min(F.when(inside, F.col("value"))).alias("whislo"), F.max(F.when(inside, F.col("value"))).alias("whishi"))


def positions(series: DataFrame) -> DataFrame:
    """Each point's place from 0 to 1, of series with more than one point."""
    n = F.count("*").over(Window.partitionBy(S))
    return series.withColumn("_n", n).where("_n > 1").select(S, "idx", (F.col("idx") / (F.col("_n") - 1)).alias("position"), "value")


def grid(series: DataFrame) -> DataFrame:
    """Row and column of each point in a grid as wide as the root of the series' length."""
    cols = F.ceil(F.sqrt(F.count("*").over(Window.partitionBy(S)))).cast("int")
    return series.withColumn("grid_cols", cols).withColumns({"grid_row": F.floor(F.col("idx") / F.col("grid_cols")).cast("int"), "grid_col": (F.col("idx") % F.col("grid_cols")).cast("int")})


def style(metric: Column, mean: Column, cv: Column) -> Column:
    """Style class and steadiness by the metric's name, joined by a bar. Limits are told from 9 places: the last digits
    of a mean hang on the order of its sum, and would decide where it is a limit."""
    mean, cv = F.round(mean, 9), F.round(cv, 9)
    low = lambda a, b, names: F.when(mean < a, names[0]).when(mean < b, names[1]).otherwise(names[2])
    kind = (F.when(metric.contains("Sentence Length"), low(15, 25, STYLE["sentence"]))
            .when(metric.contains("Simpson") | metric.contains("Vocabulary"), low(0.1, 0.2, STYLE["simpson"]))
            .when(metric.contains("Hapax") | metric.contains("Uniqueness"), low(50, 100, STYLE["hapax"]))
            .when(metric.contains("PCA") | metric.contains("Function"), F.when(mean < 0, STYLE["function"][0]).otherwise(STYLE["function"][1]))
            .otherwise(STYLE["other"][0]))
    steady = F.when(cv > 0.3, STYLE["steady"][0]).when(cv > 0.15, STYLE["steady"][1]).otherwise(STYLE["steady"][2])
    return F.concat_ws(" | ", kind, steady)


def primary_style(style_class: Column) -> Column:
    return F.trim(F.substring_index(style_class, "|", 1))


def trend_word(slope: Column, up: str = "上升", down: str = "下降", flat: str = "平稳") -> Column:
    return F.when(slope > 0.01, up).when(slope < -0.01, down).otherwise(flat)
