"""Factor exposures, benchmark regressions and return attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ordered, simple_return, sma


def returns(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "ts", "close", "volume", simple_return().alias("ret")).where("ret is not null")


def exposures(bars: DataFrame) -> DataFrame:
    """One row per symbol; windows count from the last return backwards."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    rows = returns(bars).withColumn("k", back)

    def product(low: int, high: int) -> Column:
        inside = (F.col("k") >= low) & (F.col("k") <= high)
        return F.when(F.count(F.when(inside, 1)) == high - low + 1, F.product(F.when(inside, 1 + F.col("ret"))) - 1)

    last60 = F.when(F.col("k") <= 60, F.col("ret"))
    n = F.count("ret")
    skew, kurt = F.skewness("ret"), F.kurtosis("ret")
    return rows.groupBy("symbol").agg(
        F.when(n >= 273, product(22, 252)).alias("momentum_12_1"),
        product(22, 126).alias("momentum_6_1"),
        product(1, 21).alias("reversal"),
        (F.stddev_samp(last60) * F.sqrt(F.lit(252.0))).alias("realized_vol"),
        F.when(n >= 60, skew * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n >= 60, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)).alias("kurtosis"),
        F.corr(F.when(F.col("k") <= 60, F.col("volume")), F.when(F.col("k") <= 60, F.col("close"))).alias("volume_price_corr"),
        F.try_divide(F.avg(F.when(F.col("k") <= 20, F.col("volume"))), F.avg(F.when(F.col("k") <= 60, F.col("volume")))).alias("volume_activity"),
    )


def trend_strength(bars: DataFrame, n: int = 250) -> DataFrame:
    """Share of closes above their long mean, without the first full one."""
    rows = bars.select("symbol", "close", sma(F.col("close"), n).alias("ma"), F.row_number().over(ordered()).alias("i"))
    return rows.where(F.col("i") > n).groupBy("symbol").agg(F.avg((F.col("close") > F.col("ma")).cast("int")).alias("trend_strength"))


def with_benchmark(bars: DataFrame) -> DataFrame:
    """Each symbol's returns beside the mean return of all symbols at that time."""
    rows = returns(bars)
    mean = rows.groupBy("ts").agg(F.avg("ret").alias("bench"))
    return rows.join(mean, "ts").select("symbol", "ts", "ret", "bench")


def beta(bars: DataFrame) -> DataFrame:
    """One-factor regression on the benchmark."""
    return with_benchmark(bars).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("ret", "bench").alias("beta"), F.regr_intercept("ret", "bench").alias("alpha"), F.regr_r2("ret", "bench").alias("r2")).withColumn("r2_level", F.when(F.col("r2") < 0.15, "low").when(F.col("r2") < 0.5, "medium").otherwise("high"))


def attribution(bars: DataFrame, window: int = 63) -> DataFrame:
    """The return of the last bars split into benchmark part, alpha and residual, with ranks by size."""
    rows = with_benchmark(bars)
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    recent = rows.withColumn("k", back).where(F.col("k") <= window).groupBy("symbol").agg(F.sum("ret").alias("total"), F.sum("bench").alias("bench"), F.count(F.lit(1)).alias("n"))
    joined = recent.join(beta(bars).select("symbol", "beta", "alpha"), "symbol")
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), v.alias("contribution")) for k, v in (("benchmark", F.col("beta") * F.col("bench")), ("alpha", F.col("alpha") * F.col("n")), ("residual", F.col("total") - F.col("beta") * F.col("bench") - F.col("alpha") * F.col("n")))]))
    long = joined.select("symbol", parts.alias("p")).select("symbol", "p.factor", "p.contribution")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.abs("contribution").desc(), "factor"))
    return long.withColumn("rank", rank)


def residual_momentum(bars: DataFrame) -> DataFrame:
    """(symbol, residual_momentum): the 12-1 momentum less beta times that of the benchmark over the same bars; null under 273 returns."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    rows = with_benchmark(bars).withColumn("k", back)
    grown = lambda c: F.product(F.when(F.col("k").between(22, 252), 1 + F.col(c))) - 1
    rest = grown("ret") - F.regr_slope("ret", "bench") * grown("bench")
    return rows.groupBy("symbol").agg(F.when(F.count(F.lit(1)) >= 273, rest).alias("residual_momentum"))


def peers(bars: DataFrame) -> DataFrame:
    """Each symbol's returns beside the benchmark and its own return of the bar before."""
    return with_benchmark(bars).withColumn("before", F.lag("ret").over(ordered()))


def solve(rows: DataFrame, y: str, xs: list[str], by: str = "symbol") -> DataFrame:
    """Least squares with intercept: the moments are one aggregate, the small system is solved per key."""
    import numpy as np
    import pandas as pd

    terms = [F.lit(1.0), *[F.col(x) for x in xs]]
    size = len(terms)
    moments = [F.sum(a * b) for a in terms for b in terms] + [F.sum(a * F.col(y)) for a in terms]
    packed = rows.dropna(subset=[y, *xs]).groupBy(by).agg(F.array(*moments).alias("m"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n"))
    names = ["intercept", *xs]

    def run(batches):
        for batch in batches:
            out = []
            for key, m, yy, n in batch.itertuples(index=False):
                m = np.asarray(m)
                a, b = m[: size * size].reshape(size, size), m[size * size :]
                w = np.linalg.lstsq(a, b, rcond=None)[0]
                total = yy - b[0] ** 2 / n
                out.append((key, *w.tolist(), float(1 - (yy - w @ b) / total) if total > 0 else None))
            yield pd.DataFrame(out, columns=[by, *names, "r2"])

    return packed.mapInPandas(run, f"{by} string, " + ", ".join(f"{c} double" for c in [*names, "r2"]))
