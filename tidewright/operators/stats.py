"""Latency percentiles in their several definitions, and tail statistics.

An exact percentile is an order statistic. Values are counted in buckets of about 1.5 % width, a few thousand a group at most; the
running sum over these says in which bucket the statistic lies, and only that bucket's values are ranked. No task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Index, from 0, of the order statistic for n values and quantile q.
RANKS = {
    "nearest": lambda n, q: F.greatest(F.ceil(n * F.lit(round(q * 1000)) / F.lit(1000)) - 1, F.lit(0)),
    "rounded": lambda n, q: F.least(F.floor((n - 1) * F.lit(q) + 0.5), n - 1),
    "truncated": lambda n, q: F.floor((n - 1) * F.lit(q)),
    "upper_median": lambda n, q: F.floor(n / 2),
}


def _bits(value: Column) -> Column:
    """Binary digits of a positive long."""
    return F.length(F.bin(value))


def _bucket(value: Column) -> Column:
    """A number that does not fall as the value rises: its exponent and six leading digits."""
    size = F.abs(value)
    drop = F.greatest(_bits(size) - 6, F.lit(0))
    return F.signum(value.cast("double")).cast("long") * (drop * 64 + F.call_function("shiftright", size, drop))


def percentile(df: DataFrame, by: str, value: str, q: float, kind: str, name: str) -> DataFrame:
    """(by, name): for each group the order statistic of `kind` (see RANKS) of whole numbers."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n")).withColumn("bucket", _bucket(F.col(value).cast("long")))
    upto = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cells = counts.groupBy(by, "bucket").agg(F.sum("n").alias("n"))
    cells = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    index = RANKS[kind](F.col("all"), q).cast("long")
    cells = cells.withColumn("at", index - (F.col("upto") - F.col("n"))).filter("at >= 0 and at < n").select(by, "bucket", "at")
    inside = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(cells, [by, "bucket"]).withColumn("upto", F.sum("n").over(inside))
    return ranked.filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select(by, F.col(value).alias(name))


def quantile_sketch(df: DataFrame, by: str, value: str, qs: list[float], digits: int = 11) -> DataFrame:
    """(by, q, value) from counts of values cut to their `digits` leading binary digits (11: three decimal ones); values below 1 count as 1.

    The largest value of the first bucket up to which a share q of the values lies. Counts of parts add up, and a group has
    64 * 2**digits buckets at most, whatever its size.
    """
    v = F.greatest(F.col(value).cast("long"), F.lit(1))
    drop = F.greatest(_bits(v) - digits, F.lit(0))
    top = (F.call_function("shiftright", v, drop) + 1) * F.call_function("shiftleft", F.lit(1).cast("long"), drop) - 1
    counts = df.groupBy(by, top.alias("value")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    ranked = ranked.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    rank = F.greatest(F.ceil(F.col("q") * F.col("all")), F.lit(1)).cast("long")
    return ranked.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select(by, "q", "value")


def sliding(df: DataFrame, by: str, order: str, last: int) -> DataFrame:
    """The last `last` rows of each group by arrival."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("_r") <= last).drop("_r")


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, stddev): the population deviation."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))


def exceedance(df: DataFrame, by: str, value: str, limits: dict[str, float]) -> DataFrame:
    """Share of values above each limit."""
    return df.groupBy(by).agg(*[F.avg((F.col(value) > x).cast("double")).alias(name) for name, x in limits.items()])


def gpd_fit(df: DataFrame, by: str, value: str, threshold: DataFrame, least: int = 50) -> DataFrame:
    """(by, u, n, n_u, xi, beta): generalised Pareto fit by moments of the excesses over the threshold `u` (threshold: by, u).

    xi = (1 - m**2 / v) / 2 and beta = m (m**2 / v + 1) / 2 for mean m and population variance v; null with fewer than `least` excesses or without spread.
    """
    over = F.when(F.col(value) > F.col("u"), F.col(value) - F.col("u")).cast("double")
    seen = df.join(threshold, by).groupBy(by, "u").agg(F.count("*").alias("n"), F.count(over).alias("n_u"), F.avg(over).alias("m"), F.var_pop(over).alias("v"))
    ratio = F.col("m") * F.col("m") / F.col("v")
    fits = (F.col("n_u") >= least) & (F.col("m") > 0) & (F.col("v") > 0)
    return seen.select(by, "u", "n", "n_u", F.when(fits, (1 - ratio) * 0.5).alias("xi"), F.when(fits, F.col("m") * 0.5 * (ratio + 1)).alias("beta"))


def return_level(fit_n: Column, n: Column, n_u: Column, u: Column, xi: Column, beta: Column) -> Column:
    """The level that one of `fit_n` values exceeds on average; the threshold itself where none is expected above it."""
    ratio = fit_n * n_u / n
    tail = F.when(F.abs(xi) < 1e-9, u + beta * F.log(ratio)).otherwise(u + beta / xi * (F.pow(ratio, xi) - 1))
    return F.when(n_u > 0, F.when(ratio <= 1, u.cast("double")).otherwise(tail))
