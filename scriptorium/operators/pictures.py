"""Pictures as rows of pixels: a threshold from all pixels of a picture, and a white frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Standard deviations below the mean that black begins at, and the width of the frame.
BELOW, BORDER = 0.5, 10
WHITE = 255


def thresholds(pixels: DataFrame, picture: str, value: str) -> DataFrame:
    """picture, threshold: an aggregate with partial sums, so a picture of any size is told by many tasks. Null values do not count."""
    return pixels.groupBy(picture).agg((F.avg(value) - F.stddev_pop(value) * BELOW).alias("threshold"))


def ordered_thresholds(pixels: DataFrame, picture: str, value: str, order: list[str]) -> DataFrame:
    """The same by a running mean and running squares in an order of pixels, so that even rounding does not depend on how rows are dealt.

    A picture's pixels are in one row here.
    """
    def step(s: Column, x: Column) -> Column:
        mean = s.mean + (x.v - s.mean) / (s.n + 1)
        return F.struct((s.n + 1).alias("n"), mean.alias("mean"), (s.squares + (x.v - mean) * (x.v - s.mean)).alias("squares"))

    each = F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).cast("double").alias("v")))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "squares")])
    told = pixels.groupBy(picture).agg(F.avg(value).alias("_mean"), F.aggregate(F.array_sort(F.collect_list(each)), start, step).alias("_s"))
    return told.select(picture, (F.col("_mean") - F.sqrt(F.try_divide("_s.squares", "_s.n")) * BELOW).alias("threshold"))


def binarised(pixels: DataFrame, picture: str, value: str, out: str, order: list[str] | None = None) -> DataFrame:
    """pixels with `out`: white over the picture's threshold, else black; null where the value is null.

    A whole number may be the threshold itself (four equal pixels and a lighter one), and rounding, which depends on how
    rows are dealt, would decide; so whole numbers are compared by sums: 2 (sum - n value) < sqrt(n squares - sum ** 2). With an order of
    pixels the threshold is a floating number, rounded in that order.
    """
    v = F.col(value)
    if order:
        limit, white = ordered_thresholds(pixels, picture, value, order), v > F.col("threshold")
    elif isinstance(pixels.schema[value].dataType, IntegralType):
        n, whole, squares = (F.col(c).cast("decimal(38,0)") for c in ("_n", "_sum", "_squares"))
        limit = pixels.groupBy(picture).agg(F.count(value).alias("_n"), F.sum(v.cast("decimal(19,0)")).alias("_sum"), F.sum((v * v.cast("decimal(19,0)")).cast("decimal(28,0)")).alias("_squares"))
        below = whole - n * v
        white = (below < 0) | (below * below * 4 < n * squares - whole * whole)
    else:
        limit, white = thresholds(pixels, picture, value), v > F.col("threshold")
    limit = limit.withColumnRenamed(picture, "_picture")
    joined = pixels.join(limit, F.col(picture).eqNullSafe(F.col("_picture")), "left")
    return joined.withColumn(out, F.when(white, WHITE).when(v.isNotNull(), 0)).drop(*limit.columns)


def framed(pixels: DataFrame, picture: str, x: str, y: str, value: str, border: int = BORDER) -> DataFrame:
    """picture, x, y, value: the pixels moved by `border`, and white ones around them (places count from 0)."""
    moved = pixels.select(picture, (F.col(x) + border).alias(x), (F.col(y) + border).alias(y), value)
    size = pixels.groupBy(picture).agg((F.max(x) + 1 + 2 * border).alias("_w"), (F.max(y) + 1 + 2 * border).alias("_h"))
    rows = size.select(picture, "_w", "_h", F.explode(F.sequence(F.lit(0), (F.col("_h") - 1).cast("int"))).alias(y))
    inside = (F.col(y) >= border) & (F.col(y) < F.col("_h") - border)
    sides = F.concat(F.sequence(F.lit(0), F.lit(border - 1)), F.sequence((F.col("_w") - border).cast("int"), (F.col("_w") - 1).cast("int")))
    whole = F.sequence(F.lit(0), (F.col("_w") - 1).cast("int"))
    frame = rows.select(picture, F.explode(F.when(inside, sides).otherwise(whole)).alias(x), y, F.lit(WHITE).alias(value))
    return moved.unionByName(frame.select(picture, F.col(x).cast("long").alias(x), F.col(y).cast("long").alias(y), value))
