"""Intervals of time: overlap joins, the largest value at each time, and look-ups, with rows in proportion to the intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the narrowest bins of overlaps(), how much wider a level's bins are than those of the level below, and levels at most.
NARROWEST, WIDER, LEVELS = 64.0, 8.0, 20


def levels_of(rows: DataFrame) -> Column:
    """The levels that rows have: one array of LEVELS numbers at most, read by a subquery."""
    return rows.agg(F.collect_set("level").alias("levels")).scalar()


def overlaps(left: DataFrame, right: DataFrame, key: str, l_ends: tuple[str, str], r_ends: tuple[str, str]) -> DataFrame:
    """Pairs of rows of one key whose intervals (start, end) overlap in more than a point, with the columns of both.

    An interval's level is that of the narrowest bins that are as wide as it, of which it touches two at most. Two intervals meet at
    the higher one's level: each has rows for its own level, and for those above it that the other side has at all. So an
    interval of any length has a few rows, and a pair is made once, in the bin where its overlap begins.
    """
    wide = lambda level: F.lit(NARROWEST) * F.pow(F.lit(WIDER), level)

    def levelled(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        over = F.greatest((F.col(ends[1]) - F.col(ends[0])) / NARROWEST, F.lit(1.0))
        return df.where(F.col(ends[1]) > F.col(ends[0])).withColumn("level", F.least(F.ceil(F.log2(over) / math.log2(WIDER)), F.lit(LEVELS)).cast("int"))

    def binned(df: DataFrame, ends: tuple[str, str], others: Column, own: str) -> DataFrame:
        levels = F.array_union(F.array("level"), F.filter(F.coalesce(F.col("_others"), F.array().cast("array<int>")), lambda k: k > F.col("level")))
        bins = F.transform(levels, lambda k: F.transform(F.sequence(F.floor(F.col(ends[0]) / wide(k)), F.floor(F.col(ends[1]) / wide(k))), lambda b: F.struct(k.alias("k"), b.alias("b"))))
        rows = df.withColumn("_others", others).withColumn("_at", F.explode(F.flatten(bins)))
        return rows.withColumnRenamed("level", own).withColumns({"_k": F.col("_at.k"), "_b": F.col("_at.b")}).drop("_others", "_at")

    a, b = levelled(left, l_ends), levelled(right, r_ends)
    met = binned(a, l_ends, levels_of(b), "_l").join(binned(b, r_ends, levels_of(a), "_r"), [key, "_k", "_b"])
    begins = F.greatest(l_ends[0], r_ends[0])
    once = (F.col("_k") == F.greatest("_l", "_r")) & (F.col("_b") == F.floor(begins / wide(F.col("_k"))))
    return met.where(once & (F.col(l_ends[1]) > F.col(r_ends[0])) & (F.col(r_ends[1]) > F.col(l_ends[0]))).drop("_k", "_b", "_l", "_r")


def halves(a: Column, b: Column) -> Column:
    """The whole numbers from a up to b, without b, as the fewest bins: an array of (level, bin), two of a level at most."""
    at = lambda k: F.struct(F.ceil(a / F.pow(F.lit(2.0), k)).alias("lo"), F.floor(b / F.pow(F.lit(2.0), k)).alias("hi"))
    odd = lambda x: F.pmod(x, F.lit(2)) == 1

    def of_level(k: Column) -> Column:
        first = F.transform(F.filter(F.array(at(k)), lambda s: (s["lo"] < s["hi"]) & odd(s["lo"])), lambda s: F.struct(k.alias("level"), s["lo"].alias("bin")))
        last = F.transform(F.filter(F.array(at(k)), lambda s: (s["lo"] + F.pmod(s["lo"], F.lit(2)) < s["hi"]) & odd(s["hi"])), lambda s: F.struct(k.alias("level"), (s["hi"] - 1).alias("bin")))
        return F.concat(first, last)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(b - a, F.lit(1)) + F.lit(1))).cast("int")), of_level))


def largest(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """rows (keys, a, b, value) to keys, from_, to, value: stretches of whole numbers, from a up to b without b, with the largest value that covers them.

    A stretch lies between two neighbouring ends of intervals; stretches without an interval are left out. Each interval is put
    into the fewest bins that make it up, a bin keeps its largest value, and an end looks up the bins that hold it: n
    intervals of any length and overlap make some n log n rows.
    """
    known = rows.where("b > a")
    nodes = known.withColumn("node", F.explode(halves(F.col("a"), F.col("b")))).select(*keys, "node.*", value).groupBy(*keys, "level", "bin").agg(F.max(value).alias(value))
    ends = known.select(*keys, F.explode(F.array("a", "b")).alias("from_")).distinct()
    ends = ends.withColumn("to", F.lead("from_").over(Window.partitionBy(*keys).orderBy("from_"))).where("to is not null")
    probes = ends.withColumn("_levels", levels_of(nodes)).withColumn("level", F.explode("_levels")).drop("_levels").withColumn("bin", F.floor(F.col("from_") / F.pow(F.lit(2.0), "level")))
    return probes.join(nodes, [*keys, "level", "bin"]).groupBy(*keys, "from_", "to").agg(F.max(value).alias(value))


def look_up(rows: DataFrame, at: str, stretches: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """rows with the value of the stretch (from_, to) of their keys that holds `at`, else null; stretches don't overlap.

    Rows and stretches are put in one order, in which each row sees the last stretch that began.
    """
    own = rows.columns
    a = rows.select(*keys, F.col(at).cast("long").alias("_at"), F.struct(*own).alias("_row"))
    b = stretches.select(*keys, F.col("from_").alias("_at"), F.struct(F.col("to").alias("to"), F.col(value).alias("value")).alias("_held"))
    order = Window.partitionBy(*keys).orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = a.unionByName(b, allowMissingColumns=True).withColumn("_held", F.last("_held", ignorenulls=True).over(order))
    return held.where("_row is not null").select("_row.*", F.when(F.col("_held.to") > F.col("_at"), F.col("_held.value")).alias(value))
