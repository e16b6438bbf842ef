"""Functions on vectors, boxes and ordered values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; of vectors of different lengths, null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def upper_median(values: Column) -> Column:
    """Aggregate: the element at half the count, rounded down, in ascending order; of [1, 2, 3, 4] it is 3.

    A discrete percentile gives the lower one. The values of a group are held together: use it for groups of
    bounded size, such as the glyphs of a line, and upper_median_of() otherwise.
    """
    return F.get(F.sort_array(F.collect_list(values)), F.floor(F.count(values) / 2).cast("int"))


def upper_median_of(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by..., name) for groups of any size: values are counted before the shuffle, and the running count of the
    distinct ones finds the element. Nulls don't count; a group of nulls only gives no row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    return run.where(F.col("_to") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias(name))


def overlap_area(a: Column, b: Column) -> Column:
    """Common area of two boxes, struct<x0, y0, x1, y1>."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    return side("x0", "x1") * side("y0", "y1")


def half_up(x: Column) -> Column:
    """Rounding with halves toward positive infinity."""
    return F.floor(x + 0.5)


def otsu(histogram: DataFrame, by: list[str], level: str = "level", n: str = "n") -> DataFrame:
    """(by..., threshold): the level that separates a histogram with most variance between classes, the lowest at ties.

    histogram: one row for each level that occurs. The highest level can't be chosen; a histogram of one level has
    none and gives no row.
    """
    w = Window.partitionBy(*by).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    count, value = F.col(n).cast("double"), F.col(level).cast("double")
    h = histogram.select(*by, F.col(level), F.sum(count).over(w).alias("nb"), F.sum(count * value).over(w).alias("sb"), F.sum(count).over(whole).alias("nt"), F.sum(count * value).over(whole).alias("st"))
    nf = F.col("nt") - F.col("nb")
    between = F.col("nb") * nf * F.pow(F.col("sb") / F.col("nb") - (F.col("st") - F.col("sb")) / nf, F.lit(2))
    best = F.max_by(F.col(level), F.struct(between.alias("v"), (-F.col(level)).alias("l")))
    return h.where("nb < nt and nb > 0").groupBy(*by).agg(best.alias("threshold"))


def collapse(best: Column, blank: int = 0) -> Column:
    """Places of a path of classes that stay when blanks and repeats of the step before go."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(best) - 1, F.lit(0))), lambda i: (i < F.size(best)) & (F.get(best, i) != blank) & ((i == 0) | (F.get(best, i) != F.get(best, i - 1))))


def ctc_decode(best: Column, probability: Column, classes: Column) -> Column:
    """struct<raw, score>: text of a path of classes, and the mean probability of what stays, 0 if nothing does.

    classes is an array of strings, class 0 the blank. A class beyond it adds no text.
    """
    kept = collapse(best)
    chances = F.transform(kept, lambda i: F.get(probability, i))
    score = F.aggregate(chances, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(kept), F.lit(1))
    return F.struct(F.array_join(F.transform(kept, lambda i: F.coalesce(F.get(classes, F.get(best, i)), F.lit(""))), "").alias("raw"), score.alias("score"))
