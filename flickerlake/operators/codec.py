"""The source model of compressed streams: units of time, blocks of pixels, residuals and their cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.events import D_EMPTY, long, whole

BLOCK = 16
# Residuals from here on are coded whole; symbol 15 of the shift says so.
T_RESIDUAL_MAX = 127
SHIFT_WHOLE = 15
D_SHIFT_MAX = 14
# 256 says that no event follows, 257 skips a block.
NO_EVENT, SKIP = 256, 257


def unit(t: Column, length: int) -> Column:
    """Index of the unit (n * length, (n + 1) * length] that holds a time; 0 belongs to the first."""
    return whole(F.greatest(t - 1, F.lit(0)), length)


def placed(events: DataFrame, length: int, of: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Adds adu, by, bx and the event's number k within its pixel and unit.

    From its third event on, a pixel's event that isn't later than the one before is dropped.
    """
    e = events.withColumn("adu", unit(F.col("t"), length)).withColumn("by", whole(F.col("y"), BLOCK)).withColumn("bx", whole(F.col("x"), BLOCK))
    return numbered(e, (*of, "adu"))


def numbered(events: DataFrame, of: tuple[str, ...]) -> DataFrame:
    """Adds k to events whose pixel and unit the columns ``of`` name, and drops those that ``placed`` drops."""
    pixel = Window.partitionBy(*of).orderBy("t", "seq")
    number, before = long(F.row_number().over(pixel)) - 1, F.lag("t").over(pixel)
    kept = events.withColumn("k", number).withColumn("before", before).where((F.col("k") < 2) | (F.col("t") > F.col("before")))
    return kept.withColumn("k", number).drop("before")


def intra(events: DataFrame, length: int) -> DataFrame:
    """First events of pixels against the first event of the pixel before, in row order of their block."""
    block = Window.partitionBy("adu", "by", "bx").orderBy("y", "x")
    first = placed(events, length).where("k = 0")
    d_before, t_before = F.lag("d").over(block), F.lag("t").over(block)
    return first.withColumn("d_residual", F.col("d") - F.coalesce(d_before, F.lit(0))).withColumn("t_residual", F.col("t") - F.coalesce(t_before, F.col("adu") * length))


def shift_symbol(residual: Column) -> Column:
    """0 for short residuals, else SHIFT_WHOLE.

    A shift that is searched for until the rest is short, and then taken back by one step, leaves a rest
    that is too long again; so between the two no symbol is ever coded, whatever loss is allowed.
    """
    return long(F.when(F.abs(residual) < T_RESIDUAL_MAX, 0).otherwise(SHIFT_WHOLE))


def inter(events: DataFrame, length: int) -> DataFrame:
    """Later events of a pixel in a unit: prediction from the last interval, scaled by the change of d."""
    pixel = Window.partitionBy("x", "y", "adu").orderBy("t", "seq")
    e = placed(events, length)
    d1, t1, t2 = F.lag("d").over(pixel), F.lag("t").over(pixel), F.lag("t", 2).over(pixel)
    e = e.withColumn("d1", d1).withColumn("t1", t1).withColumn("last_dt", F.col("t1") - t2).where("k >= 1")
    change = F.col("d") - F.col("d1")
    scale = F.when(F.col("d1") == D_EMPTY, -1).when(F.abs(change) > D_SHIFT_MAX, 0).otherwise(change)
    moved = F.when(F.col("scale") < 0, F.floor(F.col("last_dt") / F.pow(F.lit(2.0), -F.col("scale")))).otherwise(F.col("last_dt") * F.pow(F.lit(2.0), F.col("scale")))
    e = e.withColumn("d_residual", change).withColumn("scale", scale)
    predicted = F.when(F.col("k") == 1, F.col("adu") * length).otherwise(F.col("t1") + F.least(long(moved), F.lit(length)))
    return e.withColumn("t_predicted", long(predicted)).withColumn("t_residual", F.col("t") - F.col("t_predicted"))


def symbols(events: DataFrame, length: int, width: Column, height: Column) -> DataFrame:
    """(adu, kind, symbol, n): all symbols that a unit's coder would be given, counted.

    Kinds are d (residuals of the exponent, the marks for no further event and for pixels without one,
    and for blocks that are skipped), shift and t (bytes of the residuals of time). ``width`` and
    ``height`` may be scalar subqueries.
    """
    first, later = intra(events, length), inter(events, length)
    residuals = first.select("adu", "d_residual", "t_residual").unionByName(later.select("adu", "d_residual", "t_residual"))
    t, small = F.col("t_residual"), F.abs(F.col("t_residual")) < T_RESIDUAL_MAX
    byte = lambda k: F.shiftright(t, 8 * k).bitwiseAND(F.lit(255))
    spelled = F.when(small, F.array(byte(1), byte(0))).otherwise(F.array(*(byte(k) for k in range(7, -1, -1))))
    given = F.array(F.struct(F.lit("d").alias("kind"), F.col("d_residual").alias("symbol")), F.struct(F.lit("shift").alias("kind"), shift_symbol(t).alias("symbol")))
    given = F.concat(given, F.transform(spelled, lambda b: F.struct(F.lit("t").alias("kind"), b.alias("symbol"))))
    coded = residuals.select("adu", F.explode(given).alias("s")).groupBy("adu", "s.kind", "s.symbol").agg(F.count("*").alias("n"))
    # each pixel's list ends with one mark; in a block that has events, a pixel without any has one too
    blocks = first.groupBy("adu", "by", "bx").agg(F.count("*").alias("pixels"))
    size = lambda i, side: F.least(F.lit(BLOCK), side - F.col(i) * BLOCK)
    touched = blocks.groupBy("adu").agg(F.count("*").alias("blocks"), F.sum("pixels").alias("pixels"), F.sum(size("bx", width) * size("by", height)).alias("area"))
    every = F.ceil(width / BLOCK) * F.ceil(height / BLOCK)
    marks = F.array(F.struct(F.lit(NO_EVENT).alias("symbol"), long(F.col("area")).alias("n")), F.struct(F.lit(SKIP).alias("symbol"), long(every - F.col("blocks")).alias("n")))
    ends = touched.select("adu", F.explode(marks).alias("m")).where("m.n > 0").select("adu", F.lit("d").alias("kind"), long(F.col("m.symbol")).alias("symbol"), "m.n")
    return coded.unionByName(ends)
