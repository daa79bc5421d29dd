"""Hierarchy facts, histograms, scale reports and lattice aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONSTANTS, TARGETS, ORIGINS = 8, 64, 8


def hierarchy(files: DataFrame, district: str, path: str, facts: dict[str, Column]) -> DataFrame:
    """Additive facts at three levels (total, district, file) in one pass; level tells them apart."""
    level = F.grouping_id().alias("level")
    return files.rollup(district, path).agg(*[F.sum(c).alias(k) for k, c in facts.items()], level)


def level_sums(rows: DataFrame, facts: list[str]) -> DataFrame:
    """Sums of each level: equal, if the hierarchy is additive."""
    return rows.groupBy("level").agg(*[F.sum(f).alias(f) for f in facts])


#: Fixed values of the column scale: linear up to FREE, then GAIN for each doubling up to CAP; a stub for nothing; the radius is full at RADIUS_AT.
FREE, GAIN, CAP, STUB, RADIUS_GAIN, RADIUS_AT = 8, 3.0, 80.0, 0.45, 0.35, 1024
TIERS = ((0, "flat"), (FREE, "linear"), (20, "thin"), (50, "group"))


def height(n: Column) -> Column:
    """Column height of a count."""
    return F.when(n <= 0, F.lit(STUB)).when(n <= FREE, n.cast("double")).otherwise(F.least(F.lit(CAP), FREE + GAIN * F.log2(n / FREE)))


def tier(n: Column) -> Column:
    out = F.when(n <= TIERS[0][0], TIERS[0][1])
    for upto, name in TIERS[1:]:
        out = out.when(n <= upto, name)
    return out.otherwise("compressed")


def radius(n: Column) -> Column:
    """A second channel that grows weakly with a count and stops growing."""
    return 1 + RADIUS_GAIN * F.least(F.lit(1.0), F.log1p(F.greatest(n, F.lit(0)).cast("double")) / F.log1p(F.lit(float(RADIUS_AT))))


def scale_report(values: DataFrame, column: str) -> DataFrame:
    """How readable the columns of the counts are: files, empty ones, and of those that are not the greatest, median and p90 height (lower index), how many are
    under 1 % and 10 % of the greatest, and whether heights rise with counts. Order statistics are picked by running counts over the
    distinct values, so that no task sorts all rows."""
    per = values.groupBy(F.greatest(F.col(column), F.lit(0)).alias("v")).agg(F.count("*").alias("n"))
    some = per.where("v > 0").withColumn("h", height(F.col("v")))
    run = some.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).withColumn("falls", F.col("h") < F.lag("h").over(Window.orderBy("v")))
    total = per.agg(F.sum("n").alias("files"), F.sum(F.when(F.col("v") == 0, F.col("n")).otherwise(0)).alias("empty"))
    of = some.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("of"), F.max("h").alias("top"))
    rows = run.crossJoin(F.broadcast(of))  # one row on the right
    pick = lambda at: F.min(F.when(F.col("upto") > at, F.col("h")))
    got = rows.agg(
        F.max("h").alias("max"),
        pick(F.floor((F.col("of") - 1) / 2)).alias("median"),
        pick(F.least(F.floor(F.col("of") * 9 / 10), F.col("of") - 1)).alias("p90"),
        F.coalesce(F.sum(F.when(F.col("h") * 100 < F.col("top"), F.col("n")).otherwise(0)), F.lit(0)).alias("under_1pct"),
        F.coalesce(F.sum(F.when(F.col("h") * 10 < F.col("top"), F.col("n")).otherwise(0)), F.lit(0)).alias("under_10pct"),
        (~F.coalesce(F.bool_or("falls"), F.lit(False))).alias("monotone"),
    )
    milli = lambda c: F.round(1000 * F.coalesce(c, F.lit(0.0))).cast("long").alias(c)
    return total.crossJoin(F.broadcast(got)).select("files", "empty", milli("max"), milli("median"), milli("p90"), "under_1pct", "under_10pct", "monotone")


def capped_union(values: Column, limit: int) -> tuple[Column, Column]:
    """(sorted set as text, overflowed): a set union that is given up, not cut, when it outgrows its cap."""
    found = F.array_sort(F.collect_set(values))
    over = F.size(found) > limit
    return F.when(over, "").otherwise(F.array_join(found, ",")), over


def capped_unions(rows: DataFrame, keys: list[str], value: Column, limit: int) -> DataFrame:
    """(keys, constants, overflow): ``capped_union`` of every group, of which no more than one value above the cap are brought together. Nulls are no values."""
    first = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("value"))
    few = rows.select(*keys, value.alias("value")).distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit + 1)
    constants, over = capped_union(F.col("value"), limit)
    return few.groupBy(*keys).agg(constants.alias("constants"), over.alias("overflow"))


def initialised(state: Column) -> Column:
    """Join of the initialisation lattice: equal states stay, different ones are maybe."""
    return F.when(F.min(state) == F.max(state), F.min(state)).otherwise("maybe")


def ruler(values: DataFrame, column: str) -> DataFrame:
    """(stop, height, tier) of a scale ruler: the tiers' borders, one, and the maximum if it is above them."""
    top = values.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("m"))
    last = TIERS[-1][0]
    stops = F.array(*[F.lit(s).cast("long") for s in sorted({0, 1, *(t for t, _ in TIERS)})])
    every = F.array_distinct(F.concat(stops, F.when(F.col("m") > last, F.array("m")).otherwise(F.array().cast("array<bigint>"))))
    return top.select(F.explode(every).alias("stop")).select("stop", F.round(1000 * height(F.col("stop"))).cast("long").alias("height"), tier(F.col("stop")).alias("tier"))
