"""Queries of the compressed stream's source model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import events as E
from ..operators import codec as O
from ..sources import tables as T
from ..sources.tables import pixel_events
from .catalogue import query

LENGTH = T.REF * T.ADU

PLACED = """, placed AS (
    SELECT *, greatest(t - 1, 0) // 86400 AS adu, y // 16 AS by_, x // 16 AS bx FROM px
), arrived AS (SELECT *, row_number() OVER p - 1 AS arrival, lag(t) OVER p AS before FROM placed WINDOW p AS (PARTITION BY x, y, adu ORDER BY t, seq)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY x, y, adu ORDER BY t, seq) - 1 AS k FROM arrived WHERE arrival < 2 OR t > before)"""
INTRA = PLACED + """, intra AS (
    SELECT adu, by_, bx, x, y, d, t, d - coalesce(lag(d) OVER b, 0) AS d_residual, t - coalesce(lag(t) OVER b, adu * 86400) AS t_residual
    FROM numbered WHERE k = 0 WINDOW b AS (PARTITION BY adu, by_, bx ORDER BY y, x)
)"""
INTER = PLACED + """, lagged AS (
    SELECT *, lag(d) OVER p AS d1, lag(t) OVER p AS t1, lag(t) OVER p - lag(t, 2) OVER p AS last_dt FROM numbered WINDOW p AS (PARTITION BY x, y, adu ORDER BY t, seq)
), scaled AS (SELECT *, d - d1 AS d_residual, CASE WHEN d1 = 255 THEN -1 WHEN abs(d - d1) > 14 THEN 0 ELSE d - d1 END AS scale FROM lagged WHERE k >= 1),
inter AS (SELECT *, CASE WHEN k = 1 THEN adu * 86400 ELSE t1 + least(CASE WHEN scale < 0 THEN last_dt >> -scale ELSE last_dt << scale END, 86400) END AS t_predicted FROM scaled)"""


@query("adu_window", PLACED + " SELECT adu, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM placed GROUP BY adu")
def adu_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pixel_events(spark, sf_dir).withColumn("adu", O.unit(F.col("t"), LENGTH))
    return e.groupBy("adu").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("block_histogram", PLACED + " SELECT adu, by_, bx, count(*) AS n, count(DISTINCT (x, y)) AS pixels FROM numbered GROUP BY ALL")
def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and pixels by block; pixels are counted from their first events, which needs no distinct."""
    e = O.placed(pixel_events(spark, sf_dir), LENGTH)
    return e.groupBy("adu", F.col("by").alias("by_"), "bx").agg(F.count("*").alias("n"), F.count(F.when(F.col("k") == 0, 1)).alias("pixels"))


@query("intra_residuals", INTRA + " SELECT adu, x, y, d_residual, t_residual FROM intra")
def intra_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.intra(pixel_events(spark, sf_dir), LENGTH).select("adu", "x", "y", "d_residual", "t_residual")


@query("intra_t_residual", INTRA + " SELECT adu, (CASE WHEN abs(t_residual) < 127 THEN 0 ELSE 15 END)::BIGINT AS shift, count(*) AS n FROM intra GROUP BY ALL")
def intra_t_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = O.intra(pixel_events(spark, sf_dir), LENGTH)
    return e.groupBy("adu", O.shift_symbol(F.col("t_residual")).alias("shift")).agg(F.count("*").alias("n"))


@query("inter_t_prediction", INTER + " SELECT x, y, seq, k, t_predicted FROM inter")
def inter_t_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.inter(pixel_events(spark, sf_dir), LENGTH).select("x", "y", "seq", "k", "t_predicted")


@query("inter_residuals", INTER + " SELECT x, y, seq, d_residual, t - t_predicted AS t_residual FROM inter")
def inter_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.inter(pixel_events(spark, sf_dir), LENGTH).select("x", "y", "seq", "d_residual", "t_residual")


@query("residual_roundtrip", INTRA + " SELECT adu, x, y, d, t FROM intra")
def residual_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First events decoded again from residuals alone, by prefix sums in block order."""
    coded = O.intra(pixel_events(spark, sf_dir), LENGTH).select("adu", "by", "bx", "x", "y", "d_residual", "t_residual")
    w = Window.partitionBy("adu", "by", "bx").orderBy("y", "x").rowsBetween(Window.unboundedPreceding, 0)
    return coded.select("adu", "x", "y", F.sum("d_residual").over(w).alias("d"), (F.col("adu") * LENGTH + F.sum("t_residual").over(w)).alias("t"))


_SYMBOLS = INTRA + ", sym AS (SELECT adu, d_residual AS symbol, count(*) AS n FROM intra GROUP BY ALL)"


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.intra(pixel_events(spark, sf_dir), LENGTH).groupBy("adu", F.col("d_residual").alias("symbol")).agg(F.count("*").alias("n"))


@query("symbol_histogram", _SYMBOLS + " SELECT adu, symbol, n FROM sym")
def symbol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir)


@query("symbol_cdf", _SYMBOLS + " SELECT adu, symbol, (sum(n) OVER (PARTITION BY adu ORDER BY symbol) - n)::BIGINT AS low, (sum(n) OVER (PARTITION BY adu ORDER BY symbol))::BIGINT AS high FROM sym")
def symbol_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range that each symbol takes of its unit's counts."""
    high = F.sum("n").over(Window.partitionBy("adu").orderBy("symbol"))
    return _symbols(spark, sf_dir).select("adu", "symbol", (high - F.col("n")).alias("low"), high.alias("high"))


_BITS = _SYMBOLS + ", tot AS (SELECT adu, sum(n) AS all_n FROM sym GROUP BY adu), bits AS (SELECT adu, sum(n * -log2(n / all_n::DOUBLE)) AS bits, max(all_n)::BIGINT AS symbols FROM sym JOIN tot USING (adu) GROUP BY adu)"


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of the entropy of each unit's symbols, from sums of n and n log n in one aggregation."""
    nlog = F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    sums = _symbols(spark, sf_dir).groupBy("adu").agg(F.sum("n").alias("symbols"), nlog.alias("nlog"))
    return sums.select("adu", "symbols", (F.col("symbols") * F.log2(F.col("symbols").cast("double")) - F.col("nlog")).alias("bits"))


@query("entropy_estimate", _BITS + " SELECT adu, symbols, round(bits, 6) AS bits FROM bits")
def entropy_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bits(spark, sf_dir).select("adu", "symbols", F.round(F.col("bits") + 0.0, 6).alias("bits"))


_ALL = INTRA + INTER.removeprefix(PLACED) + """, residual AS (SELECT adu, d_residual, t_residual FROM intra UNION ALL SELECT adu, d_residual, t - t_predicted FROM inter),
    coded AS (SELECT adu, 'd' AS kind, d_residual AS symbol FROM residual
        UNION ALL SELECT adu, 'shift', CASE WHEN abs(t_residual) < 127 THEN 0 ELSE 15 END FROM residual
        UNION ALL SELECT adu, 't', (t_residual >> (8 * b)) & 255 FROM residual, range(0, 8) AS r(b) WHERE b < 2 OR abs(t_residual) >= 127),
    touched AS (SELECT adu, count(*) AS blocks, sum(least(16, w - bx * 16) * least(16, h - by_ * 16)) AS area, (w + 15) // 16 * ((h + 15) // 16) AS every FROM (SELECT DISTINCT adu, by_, bx FROM intra), plane GROUP BY adu, w, h),
    sym AS (SELECT adu, kind, symbol::BIGINT AS symbol, count(*) AS n FROM coded GROUP BY ALL UNION ALL SELECT adu, 'd', 256, area FROM touched UNION ALL SELECT adu, 'd', 257, every - blocks FROM touched WHERE every > blocks)"""


def _all_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pixel_events(spark, sf_dir)
    return O.symbols(e, LENGTH, *T.plane(e))


@query("coded_symbols", _ALL + " SELECT adu, kind, count(*) AS symbols, sum(n)::BIGINT AS n FROM sym GROUP BY adu, kind")
def coded_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols of each kind a unit is coded in, and how many of them differ."""
    return _all_symbols(spark, sf_dir).groupBy("adu", "kind").agg(F.count("*").alias("symbols"), F.sum("n").alias("n"))


@query("adu_sizes", _ALL + """, tot AS (SELECT adu, kind, sum(n) AS all_n FROM sym GROUP BY ALL), bits AS (SELECT adu, sum(n * -log2(n / all_n::DOUBLE)) AS bits FROM sym JOIN tot USING (adu, kind) GROUP BY adu),
    raw AS (SELECT adu, count(*) * 9 AS raw_bytes FROM placed GROUP BY adu) SELECT adu, raw_bytes, ceil(round(bits, 6) / 8)::BIGINT AS coded_bytes FROM bits JOIN raw USING (adu)""")
def adu_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bytes of a unit beside its coded bytes: the entropy of all its symbols, by kind."""
    nlog = F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    kinds = _all_symbols(spark, sf_dir).groupBy("adu", "kind").agg(F.sum("n").alias("n"), nlog.alias("nlog"))
    bits = kinds.groupBy("adu").agg(F.sum(F.col("n") * F.log2(F.col("n").cast("double")) - F.col("nlog")).alias("bits"))
    raw = pixel_events(spark, sf_dir).groupBy(O.unit(F.col("t"), LENGTH).alias("adu")).agg((F.count("*") * 9).alias("raw_bytes"))
    return bits.join(raw, "adu").select("adu", "raw_bytes", E.long(F.ceil(F.round("bits", 6) / 8)).alias("coded_bytes"))
